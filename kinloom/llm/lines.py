"""Line deduplication by site-relative frequency.

Pages are grouped by host. A line is boilerplate of its host if the share of the host's pages that
contain it exceeds ``ratio`` and more than one page has it; boilerplate lines are dropped from the host's pages.
Lines on a smaller share of a large host stay, however many pages that is. ``prior`` adds that many pages without the line to the total, for sites where a few pages
that repeat each other are no boilerplate: :func:`clean_documents`, whose sites are the sources of documents, uses 20. Only DataFrame functions are used.

Only line hashes are shuffled, once for each page that has the line, with partial sums before the shuffle,
so a line that a third of all pages share, or a host with a third of all pages, adds one row for each map task. A host has at most
(mean distinct lines of a page) / ratio boilerplate lines, which bounds its list. Pages never move: the lists are
written first, so their measured size decides between a broadcast and a join that splits hot hosts.

Defined cases: lines are compared without outer white space, as exact text by a 64-bit hash; blank lines
are never dropped. A null text stays null. Pages without a host are one site. A page repeated as a
row counts as often as it occurs. A page whose lines all go keeps an empty text. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, settle

BLANKS = " \t\v\f\r"


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def _rows(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _solid(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) > 0


def boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = 0.1, prior: int = 0) -> DataFrame:
    """``site`` and ``banned``, the hashes of its boilerplate lines; sites without any are absent."""
    own = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("site"), F.col(text).alias("body"))
    lines = own.select(
        "site", F.explode(F.array_distinct(F.transform(F.filter(_rows(F.col("body")), _solid), _key))).alias("line")
    )
    seen = lines.groupBy("site", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1.0, ratio * prior))
    total = own.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    common = seen.join(total, "site").where(F.col("n") > F.lit(ratio) * (F.col("pages") + prior))
    return settle(common.groupBy("site").agg(F.collect_list("line").alias("banned")), "boilerplate")


def drop_boilerplate(pages: DataFrame, host: str, text: str = "text", ratio: float = 0.1, prior: int = 0, counts: tuple[str, str] | None = None) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``; if ``counts`` names two more columns, non-blank lines before and dropped."""
    own = fresh(pages)
    site, banned, left = (F.col(own + x) for x in ("site", "banned", "left"))
    lists = boilerplate(pages, host, text, ratio, prior).toDF(own + "site", own + "banned")
    joined = pages.join(lists, F.coalesce(F.col(host).cast("string"), F.lit("")) == site, "left")
    rows = _rows(F.col(text))
    some = banned.isNotNull() & F.col(text).isNotNull()
    # A site's list may be long and a page has few lines of it: the page's own share is found by one hash look-up a line.
    joined = joined.withColumn(own + "hit", F.when(some, F.array_intersect(F.transform(rows, _key), banned)))
    hit = F.col(own + "hit")
    joined = joined.withColumn(own + "left", F.when(F.size(hit) > 0, F.filter(rows, lambda x: ~(F.array_contains(hit, _key(x)) & _solid(x)))).when(some, rows))
    if counts:
        count = lambda c: F.coalesce(F.size(F.filter(c, _solid)), F.lit(0)).cast("long")
        joined = joined.withColumn(counts[0], F.when(F.col(text).isNull(), F.lit(0)).otherwise(count(rows)))
        joined = joined.withColumn(counts[1], F.when(some, F.col(counts[0]) - count(left)).otherwise(F.lit(0)))
    return joined.withColumn(text, F.when(some, F.array_join(left, "\n")).otherwise(F.col(text))).drop(own + "site", own + "banned", own + "hit", own + "left")


#: Tags that end a line of text.
BLOCK = "p|div|li|ul|ol|nav|h1|h2|h3|h4|h5|h6|br|hr|article|section|aside|main|footer|header|title|table|tr|td|th|head|body|html|form|pre|blockquote"
SKIPPED = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
BREAK = rf"(?i)</?({BLOCK})([ \t\n\r/][^>]*)?>"
TAG = r"<[^>]*>"
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 2))


def html_lines(html: Column) -> Column:
    """Visible text of a page, one line for each block, without blank lines and runs of blanks."""
    out = F.regexp_replace(html, SKIPPED, "\n")
    out = F.regexp_replace(out, BREAK, "\n")
    out = F.regexp_replace(out, TAG, "")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    out = F.regexp_replace(out, r"[ \t\r]+", " ")
    return F.btrim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def line_dedup_pages(pages: DataFrame, ratio: float = 0.1, prior: int = 0) -> DataFrame:
    """For every page its host, its counts of lines and dropped lines, and the text that is left."""
    text = settle(pages.select("page_id", host_of(F.col("url")).alias("host"), html_lines(F.col("html")).alias("text")), "page_text")
    return drop_boilerplate(text, "host", "text", ratio, prior, ("n_lines", "n_dropped")).select("page_id", "host", "n_lines", "n_dropped", "text")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle(ratio: float = 0.1, prior: int = 0) -> str:
    """The same over ``pages`` in DuckDB SQL."""
    body = f"regexp_replace(html, {_sql_text(SKIPPED)}, chr(10), 'g')"
    body = f"regexp_replace({body}, {_sql_text(BREAK)}, chr(10), 'g')"
    body = f"regexp_replace({body}, {_sql_text(TAG)}, '', 'g')"
    for name, char in ENTITIES:
        body = f"replace({body}, {_sql_text(name)}, {_sql_text(char)})"
    body = rf"regexp_replace({body}, '[ \t\r]+', ' ', 'g')"
    body = rf"trim(regexp_replace({body}, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    blanks = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, page_id, lower(regexp_extract(coalesce(url, ''), {_sql_text(HOST)}, 2)) AS host, {body} AS text FROM pages),
l AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM t),
s AS (SELECT *, trim(line, {blanks}) AS bare FROM l),
n AS (SELECT host, bare, count(DISTINCT rid) AS n FROM s WHERE bare <> '' GROUP BY host, bare),
h AS (SELECT host, count(*) AS pages FROM t GROUP BY host),
b AS (SELECT n.host, n.bare FROM n JOIN h ON n.host = h.host WHERE n.n > 1 AND n.n > {ratio}::DOUBLE * (h.pages + {prior})),
r AS (SELECT s.rid, count(*) FILTER (WHERE s.bare <> '') AS n_lines, count(b.bare) AS n_dropped,
      coalesce(string_agg(s.line, chr(10) ORDER BY s.k) FILTER (WHERE b.bare IS NULL), '') AS text
      FROM s LEFT JOIN b ON s.host = b.host AND s.bare = b.bare GROUP BY s.rid)
SELECT t.page_id, t.host, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped,
       CASE WHEN t.text IS NULL THEN NULL ELSE r.text END AS text
FROM t LEFT JOIN r ON t.rid = r.rid"""


def clean_documents(docs: DataFrame, ratio: float = 0.1, prior: int = 20) -> DataFrame:
    """``documents`` without the boilerplate lines of their source; same columns, ``n_chars`` as in the new text, no row dropped."""
    out = drop_boilerplate(docs, "source", "text", ratio, prior)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
