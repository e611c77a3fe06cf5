"""Named queries that run every operator over the generated tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import names as N
from ..operators import evaluate as E
from ..operators import extract as X
from ..operators import family, filters, graph, household, kinship, linkage
from ..session import scratch, settle
from ..sources import ingest, sinks, tabular
from ..sources import documents as D
from ..sources.documents import corpus_words
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL fragments ---------------------------------------------------------------------------------

_PAIRS = ", ".join(f"'{p}'" for x in N.FREE_PAIRS for p in (x, x[::-1]))


def _dist(a: str, b: str) -> str:
    """Weighted edit distance in DuckDB SQL."""
    cell = (
        f"list_append(acc, least(acc[-1] + 1, prev[jj[1] + 1] + 1, prev[jj[1]] + CASE WHEN substr({a}, ii[1], 1) = substr({b}, jj[1], 1) "
        f"OR substr({a}, ii[1], 1) || substr({b}, jj[1], 1) IN ({_PAIRS}) THEN 0 ELSE 1 END))"
    )
    inner = f"list_reduce(list_prepend([ii[1]], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, jj: {cell})"
    return f"(list_reduce(list_prepend(range(0, length({b}) + 1), list_transform(range(1, length({a}) + 1), lambda i: [i])), lambda prev, ii: {inner}))[-1]"


def _digraph_dist(a: str, b: str) -> str:
    """The distance that looks two letters back, in DuckDB SQL: the state is the row before the last one and the last one."""
    heard = lambda x, n: f"length(replace(substr({x}, 1, {n}), '{N.SILENT}', ''))"
    one = lambda x: f"CASE WHEN {x} = '{N.SILENT}' THEN 0 ELSE 1 END"
    stands = ", ".join(f"'{p}:{x}'" for p, x in N.DIGRAPHS)
    i, j = "ii[1][1]", "jj[1]"
    x, y = f"substr({a}, {i}, 1)", f"substr({b}, {j}, 1)"
    cell = (
        f"list_append(acc, least(acc[-1] + {one(y)}, st[2][{j} + 1] + {one(x)}, st[2][{j}] + CASE WHEN {x} = {y} OR {x} || {y} IN ({_PAIRS}) THEN 0 ELSE 1 END, "
        f"CASE WHEN {i} > 1 AND substr({a}, {i} - 1, 2) || ':' || {y} IN ({stands}) THEN st[1][{j}] END, CASE WHEN {j} > 1 AND substr({b}, {j} - 1, 2) || ':' || {x} IN ({stands}) THEN st[2][{j} - 1] END))"
    )
    inner = f"list_reduce(list_prepend([{heard(a, i)}], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, jj: {cell})"
    first = f"list_transform(range(0, length({b}) + 1), lambda n: {heard(b, 'n')})"
    return f"(list_reduce(list_prepend([[]::BIGINT[], {first}], list_transform(range(1, length({a}) + 1), lambda i: [[i]])), lambda st, ii: [st[2], {inner}]))[2][-1]"


def _canon(x: str) -> str:
    return f"translate({x}, '{N.CLASS_FROM}', '{N.CLASS_TO}')"


def _most(a: str, b: str) -> str:
    n = f"greatest(length({a}), length({b}))"
    return f"(CASE WHEN {n} <= 8 THEN 5.0::DOUBLE ELSE 5.0::DOUBLE + 0.2::DOUBLE * ({n} - 8) END)"


def _prob(d: str, m: str) -> str:
    return f"(CASE WHEN {d} > {m} THEN 0.0::DOUBLE ELSE ({m} - {d}) / {m} END)"


_NAMES = "n AS (SELECT p_name, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l, count(*) AS n FROM part GROUP BY p_name)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).withColumns({"f": F.split_part("p_name", F.lit(" "), F.lit(1)), "l": F.split_part("p_name", F.lit(" "), F.lit(2))})


# ---- linkage -----------------------------------------------------------------------------------------


def _people(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Distinct persons on either side: names from part names, gender from the type, age from the size."""
    p = _t(spark, sf_dir, "part")
    one = p.groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("id"), F.min("p_size").alias("age"))
    first, last = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    census = one.select(F.col("id").alias("ecpp_id"), first.alias("First"), last.alias("Last"), F.col("p_type").alias("Gender"), F.col("age").alias("Age"))
    baptisms = one.select(
        F.col("id").alias("#ID"), first.alias("SpanishName"), last.alias("Surname"), last.alias("MSpanishName"), first.alias("MSurname"), first.alias("FSpanishName"), F.reverse(last).alias("FSurname"),
        F.col("p_type").alias("Sex"), (F.col("age") + 1).alias("Age"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("Date"), F.lit("San Juan").alias("Mission"), F.lit("Place [1]").alias("Place"),
        F.lit("note").alias("Notes"), F.lit("indio, de").alias("Ethnicity"), F.lit("mulata").alias("MEthnicity"), F.lit("pardo").alias("FEthnicity"),
    )
    return census, baptisms


_PEOPLE = """
o AS (SELECT p_name, p_type, min(p_partkey) AS id, min(p_size) AS age FROM part GROUP BY p_name, p_type),
c AS (SELECT id AS ecpp_id, split_part(p_name, ' ', 1) AS cf, split_part(p_name, ' ', 2) AS cl, p_type AS gender, age FROM o),
b0 AS (SELECT id AS bid, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l, p_type AS sex, age + 1 AS bage FROM o),
b AS (SELECT 'direct' AS role, bid, f AS bf, l AS bl, sex, bage FROM b0 UNION ALL SELECT 'mother', bid, l, f, sex, bage FROM b0
      UNION ALL SELECT 'father', bid, f, reverse(l), sex, bage FROM b0)"""


def _sql_candidates(most: int | None) -> str:
    limit = str(most) if most is not None else "floor({})".format(_most("x", "y"))
    names = "SELECT cf AS x FROM c UNION SELECT cl FROM c"
    other = "SELECT bf AS y FROM b UNION SELECT bl FROM b"
    return f"""{_PEOPLE},
d0 AS (SELECT x, y, {_dist("x", "y")} AS d FROM ({names}), ({other})),
d AS (SELECT * FROM d0 WHERE d <= {limit}),
k AS (SELECT c.*, b.*, d1.d AS fd, d2.d AS ld FROM c JOIN d d1 ON c.cf = d1.x JOIN b ON b.bf = d1.y JOIN d d2 ON d2.x = c.cl AND d2.y = b.bl)"""


def _all_roles(spark: SparkSession, sf_dir: str, most: int | None) -> DataFrame:
    census, baptisms = _people(spark, sf_dir)
    out = None
    for role in linkage.ROLES:
        one = linkage.candidates(census, baptisms, role, most=most)
        out = one if out is None else out.unionByName(one)
    return out


_GENDER = "CASE WHEN lower(trim(gender)) = lower(trim(sex)) THEN 1 ELSE 0 END"


@query(f"""
WITH {_NAMES},
d AS (SELECT a.p_name AS name, b.p_name AS match, {_dist("a.f", "b.f")} AS fd, {_dist("a.l", "b.l")} AS ld, a.f AS af, a.l AS al, b.f AS bf, b.l AS bl FROM n a JOIN n b ON a.p_name <> b.p_name),
s AS (SELECT name, match, 0.0::DOUBLE + (1.0::DOUBLE - exp(-{_prob("fd", _most("af", "bf"))})) * 0.45::DOUBLE + (1.0::DOUBLE - exp(-{_prob("ld", _most("al", "bl"))})) * 0.45::DOUBLE + 1.0::DOUBLE * 0.1::DOUBLE AS score FROM d)
SELECT name, match, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY round(score, 9) DESC, match) AS r FROM s WHERE score > 0.4) WHERE r = 1""")
def linkage_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best other part name for every part name, by the v0 score."""
    n = _names(spark, sf_dir).withColumns({"First": F.col("f"), "Last": F.col("l"), "Gender": F.lit("x")})
    side = n.select("p_name", "First", "Last", "Gender")
    b = side.toDF("p_name", "SpanishName", "Surname", "Sex")
    pairs = linkage.candidates(side, b, "direct").where("c_p_name <> b_p_name")
    scored = filters.above(linkage.v0_scores(pairs, "c_Gender", "b_Sex"), "score", linkage.V0_CUT).withColumn("score", F.round("score", 9))
    return linkage.best_per(scored, "c_p_name", [F.desc("score"), F.col("b_p_name")]).select(F.col("c_p_name").alias("name"), F.col("b_p_name").alias("match"), "score")


@query(f"""
WITH {_NAMES}
SELECT a.p_name AS a, b.p_name AS b, {_dist("a.p_name", "b.p_name")}::INT AS distance, levenshtein({_canon("a.p_name")}, {_canon("b.p_name")})::INT AS low, levenshtein(a.p_name, b.p_name)::INT AS high,
       {_most("a.p_name", "b.p_name")} AS most, {_prob(_dist("a.p_name", "b.p_name"), _most("a.p_name", "b.p_name"))} AS probability FROM n a JOIN n b ON a.f = b.f OR a.l = b.l""")
def name_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance, bounds and probability of distinct part names that share a word."""
    n = _names(spark, sf_dir)
    by = lambda w: n.select(F.col("p_name").alias("a"), w).join(n.select(F.col("p_name").alias("b"), w), w)
    pairs = by("f").select("a", "b").unionByName(by("l").select("a", "b")).distinct().withColumn("distance", N.weighted_distance(F.col("a"), F.col("b")))
    most = N.dynamic_max_distance(F.col("a"), F.col("b"))
    return pairs.select("a", "b", "distance", F.levenshtein(N.canon(F.col("a")), N.canon(F.col("b"))).alias("low"), F.levenshtein("a", "b").alias("high"), most.alias("most"), N.match_probability(F.col("distance"), most).alias("probability"))


@query(f"WITH {_NAMES} SELECT a.p_name AS l, b.p_name AS r, {_dist('a.p_name', 'b.p_name')}::INT AS distance FROM n a, n b WHERE {_dist('a.p_name', 'b.p_name')} <= 2")
def bounded_name_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _names(spark, sf_dir)
    return linkage.name_pairs(n, n, "p_name", "p_name", 2)


@query(f"""
WITH {_sql_candidates(None)}
SELECT role, ecpp_id, bid, round(0.0::DOUBLE + (1.0::DOUBLE - exp(-{_prob("fd", _most("cf", "bf"))})) * 0.45::DOUBLE + (1.0::DOUBLE - exp(-{_prob("ld", _most("cl", "bl"))})) * 0.45::DOUBLE + ({_GENDER}) * 0.1::DOUBLE, 9) AS score
FROM k WHERE 0.0::DOUBLE + (1.0::DOUBLE - exp(-{_prob("fd", _most("cf", "bf"))})) * 0.45::DOUBLE + (1.0::DOUBLE - exp(-{_prob("ld", _most("cl", "bl"))})) * 0.45::DOUBLE + ({_GENDER}) * 0.1::DOUBLE > 0.4""")
def linkage_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = linkage.v0_scores(_all_roles(spark, sf_dir, None), "c_Gender", "b_Sex")
    return filters.above(scored, "score", 0.4).select("role", F.col("c_ecpp_id").alias("ecpp_id"), F.col("`b_#ID`").alias("bid"), F.round("score", 9).alias("score"))


_V1 = f"""{_sql_candidates(2)},
v AS (SELECT *, 1 AS f1, 1 AS f2, {_GENDER} AS f3, CASE WHEN abs(age - bage) <= 2 THEN 1 ELSE 0 END AS f4 FROM k),
w AS (SELECT role, ecpp_id, bid, (f1 + f2 + f3 + f4)::DOUBLE AS score, concat_ws(', ', 'First Name', 'Last Name', CASE WHEN f3 = 1 THEN 'Gender' END, CASE WHEN f4 = 1 THEN 'Age' END) AS criteria FROM v)"""


def _v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = linkage.v1_scores(_all_roles(spark, sf_dir, 2), "c_Gender", "b_Sex", "c_Age", "b_Age")
    return scored.select("role", F.col("c_ecpp_id").alias("ecpp_id"), F.col("`b_#ID`").alias("bid"), "score", "criteria")


@query(f"WITH {_V1} SELECT * FROM w")
def linkage_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _v1(spark, sf_dir)


_MERGED = f"""{_V1},
m AS (SELECT ecpp_id, bid, max(score) AS score, coalesce(max(CASE WHEN role = 'direct' THEN criteria END), max(CASE WHEN role = 'mother' THEN criteria END), max(CASE WHEN role = 'father' THEN criteria END)) AS criteria,
      CASE WHEN bool_or(role = 'direct') THEN 'direct' WHEN bool_or(role = 'mother') AND bool_or(role = 'father') THEN 'mother_father' WHEN bool_or(role = 'mother') THEN 'mother' ELSE 'father' END AS match_type
      FROM w WHERE score >= 3 GROUP BY ecpp_id, bid)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _v1(spark, sf_dir).groupBy("ecpp_id", "bid").agg(*[F.max(F.when(F.col("role") == r, F.struct("score", "criteria"))).alias(r) for r in linkage.ROLES])
    wide = wide.select("ecpp_id", "bid", *[F.col(f"{r}.score").alias(f"s_{r}") for r in linkage.ROLES], *[F.col(f"{r}.criteria").alias(f"t_{r}") for r in linkage.ROLES])
    hits = linkage.filter_matched(wide, {r: f"s_{r}" for r in linkage.ROLES}, linkage.V1_CUT, "afro_1790_census")
    kind = F.col("match_type")
    pick = lambda p: F.when(kind == "direct", F.col(f"{p}_direct")).when(kind == "mother", F.col(f"{p}_mother")).otherwise(F.col(f"{p}_father"))
    rows = hits.select("ecpp_id", "bid", "match_type", pick("s").alias("score"), pick("t").alias("criteria"))
    return linkage.combine_matches(rows, ["ecpp_id", "bid"], ["score"])


@query(f"WITH {_MERGED} SELECT * FROM m")
def linkage_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of three points or more in any role, merged to one row for each pair."""
    return _merged(spark, sf_dir)


@query(f"""
WITH {_MERGED}
SELECT m.bid AS "#ID", m.ecpp_id, m.score AS "Direct_Total_Match_Score", m.score AS "Mother_Total_Match_Score", m.score AS "Father_Total_Match_Score", m.criteria AS "Matched_Criteria", m.match_type, 'afro_1790_census' AS dataset_key,
       b0.f AS first_name, b0.l AS last_name,
       CASE WHEN match_type IN ('direct', 'father', 'mother_father') THEN b0.f END AS father_first_name, CASE WHEN match_type IN ('direct', 'father', 'mother_father') THEN reverse(b0.l) END AS father_last_name,
       NULL::VARCHAR AS father_military_status, NULL::VARCHAR AS father_origin,
       CASE WHEN match_type IN ('direct', 'mother', 'mother_father') THEN b0.l END AS mother_first_name, CASE WHEN match_type IN ('direct', 'mother', 'mother_father') THEN b0.f END AS mother_last_name,
       NULL::VARCHAR AS mother_origin, b0.sex, o.p_type AS race_1790, NULL::VARCHAR AS race_1781, NULL::VARCHAR AS race_1785, NULL::VARCHAR AS race_1821, NULL::VARCHAR AS race_267, o.p_type AS race_aggregated,
       CASE WHEN match_type = 'direct' THEN 'indio  de' WHEN match_type IN ('mother', 'mother_father') THEN 'mulata' ELSE 'pardo' END AS ethnicity,
       'Place  1 ' AS origin_parish_1790_census, 'd' || b0.bid AS baptismal_date, 'San Juan' AS location_ecpp_baptism, 'note' AS notes_url_1790_census
FROM m JOIN b0 ON m.bid = b0.bid JOIN o ON o.id = m.ecpp_id""")
def linkage_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    census, baptisms = _people(spark, sf_dir)
    m = _merged(spark, sf_dir).select(
        F.col("bid").alias("#ID"), "ecpp_id", *[F.col("score").alias(f"{r}_Total_Match_Score") for r in ("Direct", "Mother", "Father")], F.col("criteria").alias("Matched_Criteria"), "match_type", F.lit("afro_1790_census").alias("dataset_key")
    )
    races = census.select(F.lit("afro_1790_census").alias("dataset_key"), "ecpp_id", F.col("Gender").alias("Race"))
    return linkage.enrich(m, baptisms, races)


@query(f"""
WITH {_sql_candidates(2)}
SELECT gender, count(*) AS pairs, count(*) FILTER (WHERE 0.55 + (CASE WHEN abs(age - bage) <= 3 THEN 0.30 ELSE 0 END) + ({_GENDER}) * 0.15 >= 0.8) AS accepted FROM k WHERE role = 'direct' GROUP BY gender""")
def linkage_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary-feature profile: pairs and accepted pairs for each gender."""
    census, baptisms = _people(spark, sf_dir)
    scored = linkage.analysis_scores(linkage.candidates(census, baptisms, "direct", most=2), "c_Gender", "b_Sex", "c_Age", "b_Age")
    return scored.groupBy(F.col("c_Gender").alias("gender")).agg(F.count(F.lit(1)).alias("pairs"), F.count_if("accepted").alias("accepted"))


# ---- fields and sources --------------------------------------------------------------------------------


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS normal FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accent-free lower case of every text. (The SQL knows fewer letters than it: beyond Latin-1 they may differ.)"""
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(N.normalize(F.col("text")).cast("binary")).alias("normal"))


@query("SELECT doc_id, md5(trim(lower(strip_accents(replace(replace(replace(replace(replace(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 'de ', ''), 'del ', ''), 'de la ', ''), 'y ', ''), 'los ', ''))))) AS normal FROM documents")
def normalize_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(N.normalize_particles(F.col("text")).cast("binary")).alias("normal"))


@query("""
WITH t AS (SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events),
u AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN ' ' || k || ' ' WHEN event_id % 5 = 1 THEN event_type WHEN event_id % 5 = 2 THEN '' WHEN event_id % 5 = 3 THEN NULL ELSE k END AS a FROM t)
SELECT event_id, CASE WHEN a IS NULL THEN NULL ELSE coalesce(TRY_CAST(trim(a) AS DOUBLE), 0) END AS age, CASE WHEN regexp_matches(trim(a), '^[0-9]+$') THEN trim(a)::INT END AS whole,
       nullif(TRY_CAST(trim(a) AS DOUBLE), 0) AS sane, lower(trim(a)) AS field, nullif(trim(a), '') AS ref FROM u""")
def field_cleaners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages and references from JSON properties: padded, textual, empty and null by turns."""
    k, turn = F.get_json_object("props", "$.k"), F.col("event_id") % 5
    a = F.when(turn == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(turn == 1, F.col("event_type")).when(turn == 2, "").when(turn == 3, F.lit(None).cast("string")).otherwise(k)
    e = _t(spark, sf_dir, "events").select("event_id", a.alias("a"))
    a = F.col("a")
    return e.select("event_id", N.convert_age(a).alias("age"), N.safe_int(a).alias("whole"), N.sanitize_age(F.trim(a)).alias("sane"), N.normalize_field(a).alias("field"), N.blank_to_null(a).alias("ref"))


@query("SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS ecpp_id FROM customer")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tabular.add_identifiers(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "ecpp_id", ("c_nationkey", "c_custkey"))


@query("SELECT nullif(trim(concat_ws(' ', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2))), '') AS name, p_brand AS race, lower(p_type) AS gender, p_size AS age, p_partkey AS ordinal FROM part")
def canonical_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drifting header, a schema mapping and canonical fields."""
    p = _t(spark, sf_dir, "part")
    raw = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("﻿Ego_First Name"), F.concat(F.lit(" "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("Ego_ Paternal Last Name"), F.col("p_brand").alias("Race "), F.lower("p_type").alias("SEX"), F.concat(F.col("p_size").cast("string"), F.lit(" ")).alias("Age "), F.col("p_partkey").alias("ordinal"))
    mapping = {"name": ["ego_first name", "ego_ paternal last name "], "race": "race", "gender": "sex", "age": "age "}
    return tabular.to_persons(tabular.drop_blank_rows(tabular.standardize(raw)), mapping).select("name", "race", "gender", "age", "ordinal")


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RED|blue')")
def term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.any_term(_t(spark, sf_dir, "part"), "p_name", ("RED", "blue")).select("p_partkey", "p_name")


@query("SELECT c_custkey, trim(c_mktsegment || ' ' || c_name) AS last_name, regexp_replace('[' || c_name || ', x]', '[,\\s\\[\\]]', ' ', 'g') AS plain, regexp_replace('[' || c_name || ']', '^\\[(.*)\\]$', '\\1') AS bare, c_mktsegment || ', ' || c_name AS spaced, CASE WHEN c_nationkey <> 0 THEN c_nationkey::VARCHAR ELSE c_name END AS truthy FROM customer")
def field_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tabular.last_name(_t(spark, sf_dir, "customer"), "c_mktsegment", "c_name", "last_name")
    bracketed = F.concat(F.lit("["), F.col("c_name"), F.lit("]"))
    return c.select(
        "c_custkey", "last_name", N.plain_list(F.concat(F.lit("["), F.col("c_name"), F.lit(", x]"))).alias("plain"), N.outer_brackets(bracketed).alias("bare"),
        N.space_commas(F.concat("c_mktsegment", F.lit(","), "c_name", F.lit(","))).alias("spaced"), N.first_truthy(F.col("c_nationkey").cast("string"), F.col("c_name")).alias("truthy"),
    )


@query("SELECT sum(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))) AS words FROM documents")
def corpus_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_words(_t(spark, sf_dir, "documents"))


# ---- households, graph, trees ---------------------------------------------------------------------------

_HOUSE = """r AS (SELECT user_id AS list, event_id AS ordinal, CASE WHEN event_id % 11 = 0 THEN 'solo' ELSE 'ana ' || event_type END AS name, CASE WHEN value < 10 THEN NULL ELSE 'p' END AS father FROM events),
k AS (SELECT *, split_part(name, ' ', 2) AS surname, row_number() OVER (PARTITION BY list ORDER BY ordinal) AS rn FROM r WHERE name LIKE '% %'),
c AS (SELECT *, father IS NULL AND rn > 1 AS cand FROM k),
p AS (SELECT *, last_value(CASE WHEN cand THEN surname END IGNORE NULLS) OVER (PARTITION BY list ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c)"""


@query(f"WITH {_HOUSE} SELECT list, ordinal, surname, sum(CASE WHEN cand AND (before IS NULL OR before <> surname) THEN 1 ELSE 0 END) OVER (PARTITION BY list ORDER BY ordinal)::BIGINT AS household FROM p")
def households(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as record lists of one user each."""
    e = _t(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 11 == 0, "solo").otherwise(F.concat(F.lit("ana "), F.col("event_type")))
    rows = e.select(F.col("user_id").alias("list"), F.col("event_id").alias("ordinal"), name.alias("name"), F.when(F.col("value") >= 10, "p").alias("father"), F.lit(None).cast("string").alias("mother"))
    return household.group_households(rows, ["ordinal"], ["list"]).select("list", "ordinal", "surname", "household")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of three censuses; race, spouse and birth year are known for some."""
    p = _t(spark, sf_dir, "part")
    n = p.groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("gender"), F.col("p_size").cast("int").alias("size")).agg(F.min("p_partkey").alias("id"))
    size, turned = F.col("size"), F.concat_ws(" ", F.split_part("name", F.lit(" "), F.lit(2)), F.split_part("name", F.lit(" "), F.lit(1)))
    return n.select(
        "id", "name", "gender", F.when(size % 4 == 1, "indio").when(size % 4 == 2, "indio; mulato").when(size % 4 == 3, "mulato").alias("race"), F.when(size % 7 > 0, (size * 4).cast("double")).alias("birth_year"),
        F.when(size % 3 == 1, turned).when(size % 3 == 2, F.concat(turned, F.lit("xxx"))).alias("spouse"), F.lit(None).cast("string").alias("father"), F.lit(None).cast("string").alias("mother"),
        (1750 + size % 3 * 10).alias("census_year"), size.cast("double").alias("age"),
    )


def _agree(a: str, b: str) -> str:
    d = _dist(f"{a}.spouse", f"{b}.spouse")
    return (
        f"(({a}.gender IS NULL OR {b}.gender IS NULL OR {a}.gender = {b}.gender) AND ({a}.birth_year IS NULL OR {b}.birth_year IS NULL OR abs({a}.birth_year - {b}.birth_year) <= 5) "
        f"AND ({a}.race IS NULL OR {b}.race IS NULL OR contains({a}.race, ';') OR contains({b}.race, ';') OR {a}.race = {b}.race) AND ({a}.spouse IS NULL OR {b}.spouse IS NULL OR {d} <= 3))"
    )


_NODES = """
g AS (SELECT p_name AS name, p_type AS gender, p_size::INT AS size, min(p_partkey) AS id FROM part GROUP BY p_name, p_type, p_size),
h AS (SELECT *, split_part(name, ' ', 2) || ' ' || split_part(name, ' ', 1) AS turned FROM g),
n AS (SELECT id, name, gender, CASE size % 4 WHEN 1 THEN 'indio' WHEN 2 THEN 'indio; mulato' WHEN 3 THEN 'mulato' END AS race, CASE WHEN size % 7 > 0 THEN size * 4.0::DOUBLE END AS birth_year,
      CASE size % 3 WHEN 1 THEN turned WHEN 2 THEN turned || 'xxx' END AS spouse, 1750 + size % 3 * 10 AS census_year, size AS age FROM h)"""
_NEAR = f"""
k AS (SELECT DISTINCT name FROM n),
d0 AS (SELECT * FROM (SELECT x.name AS l, y.name AS r, {_dist("x.name", "y.name")} AS d FROM k x, k y) WHERE d <= 2)"""
_ENTITY = f"""{_NODES}, {_NEAR},
e AS (SELECT a.id AS u, b.id AS v FROM n a JOIN d0 ON a.name = d0.l JOIN n b ON b.name = d0.r WHERE a.id <> b.id AND {_agree("a", "b")}),
reach AS (SELECT id AS node, id AS root FROM n UNION SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.node WHERE e.v > reach.root),
q0 AS (SELECT node AS id, min(root) AS low FROM reach GROUP BY node),
q AS (SELECT id, low AS entity FROM q0)"""


@query(f"WITH RECURSIVE {_ENTITY} SELECT id, entity FROM q")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of near names that agree in what is known, as connected components."""
    return graph.resolve(_nodes(spark, sf_dir))


_MERGE = """
j AS (SELECT n.*, q.entity FROM n JOIN q ON n.id = q.id),
y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, census_year ORDER BY id) AS r FROM j) WHERE r = 1),
t AS (SELECT entity, string_agg(census_year::VARCHAR, '|' ORDER BY census_year) AS years, string_agg(age::VARCHAR, '|' ORDER BY census_year) AS ages, avg(census_year - age) AS mean_birth FROM y GROUP BY entity),
s AS (SELECT entity, string_agg(DISTINCT name, '|' ORDER BY name) AS names, coalesce(string_agg(DISTINCT race, '|' ORDER BY race), '') AS races, coalesce(string_agg(DISTINCT spouse, '|' ORDER BY spouse), '') AS spouses FROM j GROUP BY entity)
SELECT s.entity, names, races, spouses, years, ages, round(mean_birth, 6) AS birth_year FROM s JOIN t ON s.entity = t.entity"""


def _merged_table(spark: SparkSession, sf_dir: str, entities: DataFrame) -> DataFrame:
    m = graph.merge_nodes(_nodes(spark, sf_dir), entities)
    text = lambda c: F.array_join(c, "|")
    return m.select(
        "entity", text("name").alias("names"), text("race").alias("races"), text("spouse").alias("spouses"), text(F.transform(F.map_keys("timeline"), lambda y: y.cast("string"))).alias("years"),
        text(F.transform(F.map_values("timeline"), lambda v: v["age"].cast("int").cast("string"))).alias("ages"), F.round("birth_year", 6).alias("birth_year"),
    )


@query(f"WITH RECURSIVE {_ENTITY}, {_MERGE}")
def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives of every attribute of an entity, and its timeline."""
    return _merged_table(spark, sf_dir, graph.resolve(_nodes(spark, sf_dir)))


def _step(base: str, year: int, out: str) -> str:
    """One census joined to the entities so far, in SQL."""
    fields = ", ".join(f"coalesce(b.{c}, w.{c}) AS {c}" for c in ("gender", "race", "birth_year", "spouse"))
    gains = ", ".join(f"arg_min({c}, id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("gender", "race", "birth_year", "spouse"))
    return f"""
p{out} AS (SELECT a.id, b.id AS entity, d0.d FROM n a JOIN d0 ON a.name = d0.l JOIN {base} b ON b.name = d0.r WHERE a.census_year = {year} AND {_agree("a", "b")}),
m{out} AS (SELECT id, entity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, entity) AS r FROM p{out}) WHERE r = 1),
f{out} AS (SELECT a.*, m.entity FROM n a LEFT JOIN m{out} m ON m.id = a.id WHERE a.census_year = {year}),
w{out} AS (SELECT entity, {gains} FROM f{out} WHERE entity IS NOT NULL GROUP BY entity),
{out} AS (SELECT b.id, b.name, {fields} FROM {base} b LEFT JOIN w{out} w ON w.entity = b.id UNION ALL SELECT id, name, gender, race, birth_year, spouse FROM f{out} WHERE entity IS NULL)"""


_INTEGRATED = f"""{_NODES}, {_NEAR},
b0 AS (SELECT id, name, gender, race, birth_year, spouse FROM n WHERE census_year = 1750),{_step("b0", 1760, "b1")},{_step("b1", 1770, "b2")},
q AS (SELECT id, id AS entity FROM b0 UNION ALL SELECT id, coalesce(entity, id) FROM fb1 UNION ALL SELECT id, coalesce(entity, id) FROM fb2)"""


@query(f"WITH {_INTEGRATED}, {_MERGE}")
def integrated_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three censuses joined in order of year, and what is known of every entity."""
    n = _nodes(spark, sf_dir)
    return _merged_table(spark, sf_dir, graph.integrate([(y, n.where(F.col("census_year") == y)) for y in (1770, 1750, 1760)]))


# ---- families of integrated people -------------------------------------------------------------------------

# Columns of a person that both dialects derive alike.
_KIN_COLUMNS = {
    "race": "CASE size % 4 WHEN 1 THEN 'indio' WHEN 2 THEN 'indio; mulato' WHEN 3 THEN 'mulato' END",
    "birth_year": "CASE WHEN size % 7 > 0 THEN CAST(1750 + size % 3 * 10 - size AS DOUBLE) END",
    "father": "f || ' ' || CASE id % 4 WHEN 0 THEN 'bolt' WHEN 1 THEN 'bolts' WHEN 2 THEN 'gear' END",
    "mother": "CASE f WHEN 'old' THEN 'new ' WHEN 'hot' THEN 'cold ' ELSE 'red ' END || l",
    "spouse": "CASE WHEN size % 3 > 0 THEN CASE f WHEN 'small' THEN 'large ' WHEN 'large' THEN 'small ' ELSE 'red ' END || l END",
    "census_year": "CAST(1750 + size % 3 * 10 AS INT)",
    "age": "CASE WHEN size % 11 > 0 THEN CAST(size AS DOUBLE) END",
}


def _kin(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Persons of three censuses with parents and spouses by name, and their entities."""
    p = _t(spark, sf_dir, "part")
    g = p.groupBy(F.col("p_name").alias("name"), F.col("p_type").alias("gender"), F.col("p_size").cast("int").alias("size")).agg(F.min("p_partkey").alias("id"))
    g = g.withColumns({"f": F.split_part("name", F.lit(" "), F.lit(1)), "l": F.split_part("name", F.lit(" "), F.lit(2))})
    persons = g.select("id", "name", "gender", *[F.expr(e).alias(c) for c, e in _KIN_COLUMNS.items()])
    entities = graph.integrate([(y, persons.where(F.col("census_year") == y)) for y in (1750, 1760, 1770)])
    return persons, settle(entities, "entities")


_KIN = f"""
g AS (SELECT p_name AS name, p_type AS gender, p_size::INT AS size, min(p_partkey) AS id, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l FROM part GROUP BY p_name, p_type, p_size),
n AS (SELECT id, name, gender, {", ".join(f"{e} AS {c}" for c, e in _KIN_COLUMNS.items())} FROM g), {_NEAR},
b0 AS (SELECT id, name, gender, race, birth_year, spouse FROM n WHERE census_year = 1750),{_step("b0", 1760, "b1")},{_step("b1", 1770, "b2")},
q AS (SELECT id, id AS entity FROM b0 UNION ALL SELECT id, coalesce(entity, id) FROM fb1 UNION ALL SELECT id, coalesce(entity, id) FROM fb2),
r AS (SELECT * FROM (SELECT census_year, id, name, unnest(['father', 'mother', 'spouse']) AS rel, unnest([father, mother, spouse]) AS ref FROM n) WHERE ref IS NOT NULL AND ref <> name),
o AS (SELECT census_year, name, min(id) AS target FROM n GROUP BY ALL),
x AS (SELECT x.*, o.target, row_number() OVER (PARTITION BY x.census_year, x.ref ORDER BY o.name <> x.ref, {_dist("x.ref", "o.name")}, o.target) AS k
      FROM (SELECT DISTINCT census_year, ref FROM r) x JOIN o ON x.census_year = o.census_year AND {_dist("x.ref", "o.name")} <= 2),
pairs AS (SELECT r.census_year, r.rel, me.id AS me, ot.id AS other, me.name <> ot.name AS named, me.birth_year - ot.birth_year AS gap, ot.age - me.age AS older, me.gender <> ot.gender AS mixed
      FROM r JOIN x ON x.k = 1 AND r.census_year = x.census_year AND r.ref = x.ref JOIN n me ON me.id = r.id JOIN n ot ON ot.id = x.target WHERE me.id <> ot.id),
ok AS (SELECT * FROM pairs WHERE CASE WHEN rel = 'spouse' THEN coalesce(mixed, true) AND coalesce(abs(gap) <= 25, true) ELSE named AND coalesce(gap BETWEEN 13 AND 60, older >= 13, true) END),
e AS (SELECT DISTINCT census_year, other AS src, me AS dst, rel FROM ok UNION SELECT census_year, me, other, rel FROM ok WHERE rel = 'spouse'),
cv AS (SELECT census_year, a.entity AS src, b.entity AS dst, rel, count(*) AS votes FROM e JOIN q a ON a.id = e.src JOIN q b ON b.id = e.dst WHERE a.entity <> b.entity GROUP BY ALL),
jn AS (SELECT n.*, q.entity, row_number() OVER (PARTITION BY entity, census_year ORDER BY n.id) AS turn FROM n JOIN q ON n.id = q.id)"""
_FAMILY = f"""{_KIN},
ab AS (SELECT entity AS id, any_value(name) FILTER (id = entity) AS name, first(gender ORDER BY census_year, id) AS gender, coalesce(avg(CASE WHEN turn = 1 THEN census_year - age END), avg(birth_year)) AS birth_year,
      arg_max(age, census_year) FILTER (turn = 1 AND age IS NOT NULL) AS age FROM jn GROUP BY entity),
vt AS (SELECT src, dst, rel, sum(votes)::BIGINT AS votes, min(census_year) AS first_year FROM cv GROUP BY ALL),
vv AS (SELECT vt.*, c.birth_year - p.birth_year AS gap, p.age - c.age AS older, p.name <> c.name AS named, p.gender <> c.gender AS mixed FROM vt JOIN ab p ON p.id = src JOIN ab c ON c.id = dst),
vw AS (SELECT * FROM vv WHERE CASE WHEN rel = 'spouse' THEN coalesce(mixed, true) AND coalesce(abs(gap) <= 25, true) ELSE named AND coalesce(gap BETWEEN 13 AND 60, older >= 13, true) END),
vb AS (SELECT src, dst, rel, votes, count(*) OVER (PARTITION BY dst, rel) - 1 AS rivals, first_year, row_number() OVER (PARTITION BY dst, rel ORDER BY votes DESC, first_year, src) AS place FROM vw),
fam AS (SELECT src, dst, rel, votes, rivals, first_year FROM vb b WHERE place = 1 AND (rel <> 'spouse' OR EXISTS (SELECT 1 FROM vb z WHERE z.place = 1 AND z.rel = 'spouse' AND z.src = b.dst AND z.dst = b.src)))"""


@query(f"WITH {_FAMILY} SELECT * FROM fam")
def integrated_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One father, mother and spouse at most for each entity of three censuses, by votes of its members."""
    return kinship.integrated_family(*_kin(spark, sf_dir))


@query(f"""WITH RECURSIVE {_FAMILY},
up AS (SELECT DISTINCT src, dst FROM fam WHERE rel <> 'spouse'),
t AS (SELECT id AS root, id AS node, NULL::BIGINT AS parent, 1 AS depth, [id] AS path, false AS circular FROM ab WHERE id NOT IN (SELECT dst FROM up)
      UNION ALL SELECT t.root, up.dst, up.src, t.depth + 1, list_append(t.path, up.dst), list_contains(t.path, up.dst) FROM t JOIN up ON up.src = t.node WHERE NOT t.circular)
SELECT root, r.name AS root_name, node, c.name AS name, round(c.birth_year, 6) AS birth_year, parent, depth, array_to_string(path, '/') AS path, circular FROM t JOIN ab r ON r.id = root JOIN ab c ON c.id = node""")
def integrated_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family trees of the people that three censuses were integrated into, from those without parents down."""
    persons, entities = _kin(spark, sf_dir)
    about = settle(kinship.about_entities(persons, entities), "about")
    edges = settle(kinship.contract(kinship.link_censuses(persons), entities, about).where("rel <> 'spouse'"), "family")
    tree = graph.closure(edges, graph.roots_of(about, edges))
    named = tree.join(about.select(F.col("id").alias("root"), F.col("name").alias("root_name")), "root").join(about.select(F.col("id").alias("node"), "name", F.round("birth_year", 6).alias("birth_year")), "node")
    return named.select("root", "root_name", "node", "name", "birth_year", "parent", "depth", F.array_join("path", "/").alias("path"), "circular")


_TIMELINE = f"""{_KIN},
rw AS (SELECT dst AS entity, census_year, rel, src AS other, votes FROM cv UNION ALL SELECT src, census_year, 'child', dst, sum(votes)::BIGINT FROM cv WHERE rel <> 'spouse' GROUP BY src, census_year, dst),
ch AS (SELECT entity, census_year, rel, other FROM (SELECT *, row_number() OVER (PARTITION BY entity, census_year, rel ORDER BY votes DESC, other) AS k FROM rw WHERE rel <> 'child') WHERE k = 1),
fr AS (SELECT entity, census_year, count(*) AS fresh FROM (SELECT entity, other, min(census_year) AS census_year FROM rw WHERE rel = 'child' GROUP BY entity, other) GROUP BY ALL),
ln AS (SELECT entity, census_year, age, race FROM jn WHERE turn = 1),
kn AS (SELECT ln.*, f.other AS father, m.other AS mother, s.other AS spouse, (SELECT count(*) FROM rw WHERE rw.rel = 'child' AND rw.entity = ln.entity AND rw.census_year = ln.census_year) AS n_children, coalesce(fr.fresh, 0) AS fresh,
      (SELECT array_to_string(list(other ORDER BY other), '+') FROM rw WHERE rw.rel = 'child' AND rw.entity = ln.entity AND rw.census_year = ln.census_year) AS kids
      FROM ln LEFT JOIN fr USING (entity, census_year) LEFT JOIN ch f ON f.rel = 'father' AND f.entity = ln.entity AND f.census_year = ln.census_year
      LEFT JOIN ch m ON m.rel = 'mother' AND m.entity = ln.entity AND m.census_year = ln.census_year LEFT JOIN ch s ON s.rel = 'spouse' AND s.entity = ln.entity AND s.census_year = ln.census_year)"""


@query(f"""WITH {_TIMELINE}
SELECT entity, census_year, age, race, father, mother, spouse, n_children, {", ".join(f"first_value({r} IGNORE NULLS) OVER w AS known_{r}" for r in ("father", "mother", "spouse"))}, (sum(fresh) OVER w)::BIGINT AS all_children
FROM kn WINDOW w AS (PARTITION BY entity ORDER BY census_year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def relation_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age, race, parents, spouse and children of every entity in each census, and what was known by then."""
    persons, entities = _kin(spark, sf_dir)
    relations = settle(kinship.relation_rows(kinship.link_censuses(persons), entities), "relations")
    return kinship.timeline(persons, entities, relations)


@query(f"""WITH {_TIMELINE}
SELECT entity, string_agg(census_year || ':' || concat_ws('/', coalesce(age::INT::VARCHAR, '-'), coalesce(race, '-'), coalesce(father::VARCHAR, '-'), coalesce(mother::VARCHAR, '-'), coalesce(spouse::VARCHAR, '-'), coalesce(kids, '')), '|' ORDER BY census_year) AS timeline,
       coalesce((SELECT array_to_string(list(DISTINCT other ORDER BY other), '+') FROM rw WHERE rw.rel = 'child' AND rw.entity = kn.entity), '') AS children FROM kn GROUP BY entity""")
def nested_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one nested document for each entity, here flattened to text."""
    persons, entities = _kin(spark, sf_dir)
    relations = settle(kinship.relation_rows(kinship.link_censuses(persons), entities), "relations")
    nested = kinship.nested_timeline(kinship.timeline(persons, entities, relations), relations)
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    record = lambda e: F.concat_ws("/", text(e["value"]["age"].cast("int")), text(e["value"]["race"]), *[text(e["value"][r]) for r in kinship.RELATIONS], F.array_join(e["value"]["children"].cast("array<string>"), "+"))
    line = F.transform(F.map_entries("timeline"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), record(e)))
    return nested.select("entity", F.array_join(line, "|").alias("timeline"), F.array_join(F.col("children").cast("array<string>"), "+").alias("children"))


_PERSONS = """
n AS (SELECT p_name AS name, split_part(p_name, ' ', 1) AS f, split_part(p_name, ' ', 2) AS l, min(p_partkey) AS id FROM part GROUP BY p_name),
p AS (SELECT id, name, f || ' bolt' AS father, f || 's gear' AS mother, CASE WHEN l = 'anvil' THEN f || ' ring' WHEN l = 'rod' THEN 'nobody at all' END AS spouse, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 'm' ELSE 'f' END AS gender,
      CASE WHEN id % 5 > 0 THEN 1700.0::DOUBLE + id * 7 % 61 END AS birth_year, CASE WHEN id % 7 > 0 THEN (id * 3 % 50)::DOUBLE END AS age FROM n)"""
_EDGES = f"""{_PERSONS},
r AS (SELECT id, 'father' AS rel, father AS ref FROM p WHERE father <> name UNION ALL SELECT id, 'mother', mother FROM p WHERE mother <> name UNION ALL SELECT id, 'spouse', spouse FROM p WHERE spouse <> name),
t AS (SELECT ref, id AS target FROM (SELECT x.ref, p.id, row_number() OVER (PARTITION BY x.ref ORDER BY p.name <> x.ref, {_dist("x.ref", "p.name")}, p.id) AS k FROM (SELECT DISTINCT ref FROM r) x JOIN p ON {_dist("x.ref", "p.name")} <= 2) WHERE k = 1),
c AS (SELECT r.rel, me.id AS me, o.id AS other, me.name AS my_name, o.name AS its_name, me.birth_year - o.birth_year AS gap, o.age - me.age AS older, me.gender AS g, o.gender AS og FROM r JOIN t ON r.ref = t.ref JOIN p me ON me.id = r.id JOIN p o ON o.id = t.target WHERE me.id <> o.id),
ok AS (SELECT * FROM c WHERE CASE WHEN rel = 'spouse' THEN coalesce(g <> og, true) AND coalesce(abs(gap) <= 25, true) ELSE my_name <> its_name AND coalesce(gap BETWEEN 13 AND 60, older >= 13, true) END),
e AS (SELECT DISTINCT other AS src, me AS dst, rel FROM ok UNION SELECT me, other, rel FROM ok WHERE rel = 'spouse')"""


def _persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    f, l, i = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2)), F.col("id")  # noqa: E741
    return n.select(
        "id", "name", F.concat(f, F.lit(" bolt")).alias("father"), F.concat(f, F.lit("s gear")).alias("mother"), F.when(l == "anvil", F.concat(f, F.lit(" ring"))).when(l == "rod", "nobody at all").alias("spouse"),
        F.when(i % 4 == 1, "m").when(i % 4 > 1, "f").alias("gender"), F.when(i % 5 > 0, (1700 + i * 7 % 61).cast("double")).alias("birth_year"), F.when(i % 7 > 0, (i * 3 % 50).cast("double")).alias("age"),
    )


@query(f"WITH {_EDGES} SELECT src, dst, rel FROM e")
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents and spouses resolved by name, exactly or nearly, and validated."""
    return graph.link_relationships(_persons(spark, sf_dir))


@query(f"""WITH RECURSIVE {_EDGES}, pe AS (SELECT DISTINCT src, dst FROM e WHERE rel <> 'spouse'),
w AS (SELECT id AS root, id AS node, [id] AS path, false AS circular FROM p WHERE id NOT IN (SELECT dst FROM pe)
      UNION ALL SELECT w.root, pe.dst, list_append(w.path, pe.dst), list_contains(w.path, pe.dst) FROM w JOIN pe ON pe.src = w.node WHERE NOT w.circular)
SELECT w.root, w.node, len(path)::INT AS depth, circular, p.name FROM w JOIN p ON p.id = w.node""")
def family_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of every person without parents, over the resolved relationships."""
    people = _persons(spark, sf_dir)
    edges = settle(graph.link_relationships(people), "relationships")
    tree = graph.closure(edges.where("rel <> 'spouse'"), graph.roots_of(people, edges))
    return tree.join(people.select(F.col("id").alias("node"), "name"), "node").select("root", "node", "depth", "circular", "name")


@query("""SELECT c_custkey AS k, c_name AS parent, child, (len(string_split(child, ' ')) < 2 OR child LIKE '% acme%' OR child LIKE '%zz corp yy') AS fits FROM (
SELECT c_custkey, 'ana corp acme' AS c_name, CASE c_custkey % 5 WHEN 0 THEN 'luis acme' WHEN 1 THEN 'luis zz corp yy' WHEN 2 THEN 'luis' WHEN 3 THEN 'luis unrelated people' ELSE 'luis acmes solo' END AS child FROM customer)""")
def surname_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surname rule over made names: last token, paternal position, one token, none."""
    k = F.col("c_custkey")
    child = F.when(k % 5 == 0, "luis acme").when(k % 5 == 1, "luis zz corp yy").when(k % 5 == 2, "luis").when(k % 5 == 3, "luis unrelated people").otherwise("luis acmes solo")
    c = _t(spark, sf_dir, "customer").select(k.alias("k"), F.lit("ana corp acme").alias("parent"), child.alias("child"))
    return c.withColumn("fits", graph.valid_child_surname(F.col("parent"), F.col("child")))


def _hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations and customers as one tree: ids 1.., 100.., 1000..; age from the balance."""
    region, nation, customer = (_t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    # Spark's floor is an integer: it has no negative zero and ends at 2^63. From 2^53 on doubles are whole.
    balance = F.col("c_acctbal")
    age = F.when((balance != 0) & (F.abs(balance) < 2.0**53), F.floor(balance).cast("double")).otherwise(balance)
    edges = nation.select((F.col("n_regionkey") + 1).cast("long").alias("src"), (F.col("n_nationkey") + 100).cast("long").alias("dst")).unionByName(
        customer.select((F.col("c_nationkey") + 100).cast("long").alias("src"), (F.col("c_custkey") + 1000).cast("long").alias("dst"))
    )
    nodes = (
        region.select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("double").alias("age"))
        .unionByName(nation.select((F.col("n_nationkey") + 100).cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("double").alias("age")))
        .unionByName(customer.select((F.col("c_custkey") + 1000).cast("long").alias("id"), F.col("c_name").alias("name"), age.alias("age")))
    )
    return nodes, edges


_TREE = """
e AS (SELECT n_regionkey + 1 AS src, n_nationkey + 100 AS dst FROM nation UNION ALL SELECT c_nationkey + 100, c_custkey + 1000 FROM customer),
a AS (SELECT r_regionkey + 1 AS id, r_name AS name, NULL::DOUBLE AS age FROM region UNION ALL SELECT n_nationkey + 100, n_name, NULL FROM nation UNION ALL SELECT c_custkey + 1000, c_name, floor(c_acctbal) FROM customer),
t AS (SELECT id::BIGINT AS root, id::BIGINT AS node, 1 AS depth FROM a WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT t.root, e.dst::BIGINT, t.depth + 1 FROM t JOIN e ON e.src = t.node)"""


@query(f"WITH RECURSIVE {_TREE} SELECT root, node, depth FROM t")
def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _hierarchy(spark, sf_dir)
    roots = graph.roots_of(nodes, edges.withColumn("rel", F.lit("father")))
    return graph.closure(edges, roots).select("root", "node", "depth")


@query(f"""WITH RECURSIVE {_TREE}, o AS (SELECT root, max(depth) AS depth, count(*) AS nodes FROM t GROUP BY root)
SELECT count(*) AS total_trees, avg(depth) AS average_depth, min(depth)::BIGINT AS shortest_tree, avg(nodes) AS average_number_of_nodes, max(nodes) AS highest_number_of_nodes, avg(nodes - 1) AS average_number_of_children,
       (SELECT max(age) FROM t JOIN a ON a.id = t.node) AS oldest_node_age FROM o""")
def tree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _hierarchy(spark, sf_dir)
    tree = graph.closure(edges, graph.roots_of(nodes, edges.withColumn("rel", F.lit("father"))))
    return graph.tree_metrics(tree.join(nodes.select(F.col("id").alias("node"), "age"), "node"))


@query(f"""WITH RECURSIVE {_TREE} SELECT t.root, t.node, a.age FROM t JOIN a ON a.id = t.node WHERE a.age >= 5000""")
def tree_age_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _hierarchy(spark, sf_dir)
    tree = graph.closure(edges, graph.roots_of(nodes, edges.withColumn("rel", F.lit("father"))))
    return graph.at_least_age(tree.join(nodes.select(F.col("id").alias("node"), "age"), "node"), 5000).select("root", "node", "age")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 7 + 3) % 25)::BIGINT AS dst FROM nation),
t AS (SELECT n_nationkey::BIGINT AS root, n_nationkey::BIGINT AS node, [n_nationkey::BIGINT] AS path, false AS circular FROM nation
      UNION ALL SELECT t.root, e.dst, list_append(t.path, e.dst), list_contains(t.path, e.dst) FROM t JOIN e ON e.src = t.node WHERE NOT t.circular)
SELECT root, node, len(path)::INT AS depth, circular FROM t""")
def cycle_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths over a nation map with cycles, each ended by a circular reference."""
    n = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    edges = n.select(F.col("id").alias("src"), ((F.col("id") * 7 + 3) % 25).alias("dst"))
    return graph.closure(edges, n).select("root", "node", "depth", "circular")


@query("""
WITH p AS (SELECT s_suppkey AS pid, s_nationkey AS k, s_name AS pname, 1700 + floor(abs(s_acctbal))::INT % 100 AS pb FROM supplier),
c AS (SELECT c_custkey AS cid, c_nationkey AS k, c_name AS cname, 1700 + floor(abs(c_acctbal))::INT % 100 AS cb FROM customer)
SELECT pid, cid, pname <> cname AND cb - pb BETWEEN 13 AND 60 AS parent_ok, abs(pb - cb) <= 25 AS spouse_ok FROM p JOIN c ON p.k = c.k""")
def relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and spouse rules over suppliers and customers of one nation."""
    year = lambda c: (1700 + F.floor(F.abs(c)).cast("int") % 100).cast("double")
    p = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pid"), F.col("s_nationkey").alias("k"), F.col("s_name").alias("p_name"), year(F.col("s_acctbal")).alias("p_birth_year"))
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cid"), F.col("c_nationkey").alias("k"), F.col("c_name"), year(F.col("c_acctbal")).alias("c_birth_year"))
    unknown = {f"{x}_{f}": F.lit(None).cast(kind) for x in "pc" for f, kind in (("age", "double"), ("gender", "string"))}
    pairs = linkage.pairs_of_groups(c, p, "k", ["c_birth_year", "cid"], ["p_birth_year", "pid"]).withColumns(unknown)
    return pairs.select("pid", "cid", graph.valid_parent_child("p_", "c_").alias("parent_ok"), graph.valid_spouses("p_", "c_").alias("spouse_ok"))


@query(f"""
WITH l AS (SELECT min(p_partkey) AS id, p_name AS name, min(p_size)::DOUBLE AS age, min(split_part(p_name, ' ', 1)) AS spouse FROM part GROUP BY p_name),
k AS (SELECT a.id AS a_id, b.id AS b_id, {_dist("a.name", "b.name")} AS distance, abs(a.age + 4 - b.age) <= 2 AS age_fits, {_dist("a.spouse", "b.spouse")} <= 2 AS family_fits FROM l a, l b),
s AS (SELECT *, distance + CASE WHEN age_fits THEN 0 ELSE 5 END + CASE WHEN NOT family_fits THEN 3 ELSE 0 END AS score FROM k WHERE distance <= 2 OR (distance <= 3 AND (age_fits OR family_fits)))
SELECT a_id, b_id, distance, age_fits, family_fits, score, row_number() OVER (PARTITION BY a_id ORDER BY score, b_id) AS rank FROM s""")
def cross_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored matches between two lists of the distinct part names, four years apart."""
    p = _t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.min("p_size").cast("double").alias("age"))
    p = p.withColumn("spouse", F.split_part("name", F.lit(" "), F.lit(1)))
    return graph.cross_census(p, p, 4)


@query(f"""
WITH w AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE replace(p_name, 'i', 'y') || 'x' END AS name FROM part), o AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name),
x AS (SELECT w.name, o.id FROM w JOIN o ON w.name = o.name), r AS (SELECT name FROM w WHERE name NOT IN (SELECT name FROM o)),
f AS (SELECT name, id FROM (SELECT r.name, o.id, row_number() OVER (PARTITION BY r.name ORDER BY {_dist("r.name", "o.name")}, o.id) AS k FROM r, o WHERE {_dist("r.name", "o.name")} <= 2) WHERE k = 1)
SELECT name, id, false AS created FROM x UNION ALL SELECT r.name, f.id, f.id IS NULL FROM r LEFT JOIN f ON r.name = f.name""")
def find_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    wanted = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.replace("p_name", F.lit("i"), F.lit("y")), F.lit("x"))).alias("name"))
    return graph.find_or_create(wanted, p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


@query("""
WITH k AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS k FROM orders GROUP BY o_custkey)
SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_name AS name, n_name || ' ' || c_mktsegment AS spouse, coalesce(len(k.k), 0)::BIGINT AS n_children, coalesce(array_to_string(k.k, '|'), '') AS children
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN k ON k.o_custkey = c_custkey""")
def family_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as persons with a spouse from their nation and children from their orders' priorities."""
    c, n, o = (_t(spark, sf_dir, x) for x in ("customer", "nation", "orders"))
    kids = o.groupBy(F.col("o_custkey").alias("ecpp_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("k"))
    census = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("ecpp_id"), F.col("n_name").alias("spouse_first"), F.col("c_mktsegment").alias("spouse_last")).join(kids, "ecpp_id", "left")
    census = census.select("ecpp_id", "spouse_first", "spouse_last", *[F.get("k", F.lit(i)).alias(f"Child{i + 1}") for i in range(5)])
    people = c.select(F.col("c_custkey").alias("ecpp_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), *[F.lit(None).cast("string").alias(x) for x in ("sex", "race", "ethnicity", "baptismal_date")], F.lit(1.0).alias("match_prob"))
    none = c.select(F.col("c_custkey").alias("id"), *[F.lit(None).cast("string").alias(x) for x in ("father_first", "father_last", "mother_first", "mother_last")])
    units = family.family_units(people, census, none, [f"Child{i + 1}" for i in range(5)])
    m = F.get("members", F.lit(0))
    return units.select(F.col("fid").cast("long").alias("id"), m["name"].alias("name"), m["potential_spouse"].alias("spouse"), F.size(m["potential_children"]).cast("long").alias("n_children"), F.array_join(m["potential_children"], "|").alias("children"))


# ---- extraction --------------------------------------------------------------------------------------

_GRANT = (
    "'Yolo Co. Grant of 3 sq. leagues made in ' || (1800 + p_size) || ' by Gov. ' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' to ' || p_name || '. Patent for ' || p_partkey || '.5 acres issued in '"
    " || (1850 + p_size) || ' to ' || p_name || '. In T 5N, R 7W, MDM. Also known as ' || p_brand || '. On the Blue River near ' || p_name || ', old.'"
)


def _grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.upper(F.col("p_name")).alias("name"), F.expr(_GRANT).alias("description"))


@query(f"""SELECT p_partkey AS number, upper(p_name) AS name, {_GRANT} AS description, 'Yolo' AS county, 'In T 5N, R 7W, MDM' AS coordinates FROM part""")
def entry_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants written in the separated text form, a thousand numbers in a file, and parsed back."""
    g = _grants(spark, sf_dir).withColumn("file", F.floor(F.col("number") / 1000))
    lines = sinks.entries_text(g, "file")
    texts = lines.groupBy("file").agg(F.array_join(F.collect_list("value"), "\n").alias("text"))
    return X.parse_entries(texts).select("number", "name", "description", "county", "coordinates")


@query(f"""
WITH g AS (SELECT p_partkey AS number, {_GRANT} AS t FROM part)
SELECT number, regexp_extract(t, '{X.GRANT_SIZE}', 1) AS grant_size, array_to_string(regexp_extract_all(t, '{X.GRANT_YEAR}', 1), '; ') AS grant_year, regexp_extract(t, '{X.GOVERNOR}', 1) AS governor,
       regexp_extract(t, '{X.PATENT}', 1) AS patent_acres, regexp_extract(t, '{X.PATENT}', 2) AS patent_year, regexp_extract(t, '{X.PATENT}', 3) AS patent_recipients, regexp_extract(t, '{X.LOCATION}', 1) AS location,
       trim(regexp_extract(t, '{X.ALIAS}', 1)) AS alternative_names, regexp_extract(t, '{X.ACRES}', 1) AS size_acres, regexp_extract(t, '{X.LEAGUES}', 1) AS size_leagues, trim(regexp_extract(t, '{X.NEAR}', 1)) AS near,
       array_to_string(regexp_extract_all(t, '{X.WATER}', 1), '; ') AS water FROM g""")
def grant_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.grant_details(_grants(spark, sf_dir)).drop("name", "description")


@query("SELECT p_partkey AS number, upper(p_name) AS name, 'Granted to ' || p_brand || ' in full' AS description FROM part")
def caps_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``NAME #n, description`` entries with a continuation line."""
    p = _t(spark, sf_dir, "part")
    line = F.concat(F.upper("p_name"), F.lit(" MDM. #"), F.col("p_partkey").cast("string"), F.lit(", Granted to "), F.col("p_brand"), F.lit("\n  in full"))
    return X.extract_grants(p.select(line.alias("text")))


@query("SELECT upper(p_brand[1:5]) || ' COUNTY' AS county, upper(p_name) AS name, '#' || p_partkey AS number, 'Granted.' AS description FROM part")
def section_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County sections with entries and meridian headings that are skipped."""
    p = _t(spark, sf_dir, "part")
    text = F.concat(F.lit("preface\n"), F.upper(F.substring("p_brand", 1, 5)), F.lit(" COUNTY"), F.lit("\n"), F.upper("p_name"), F.lit(", #"), F.col("p_partkey").cast("string"), F.lit(" Granted.\nMDM, #7 x"))
    sections = X.split_sections(p.select(text.alias("text")))
    rows = X.split_entries(sections.withColumn("place", F.col("county"))).where("name <> 'MDM'")
    return rows.select(F.col("place").alias("county"), "name", "number", "description")


# Parts of a sentence, by the part's key and size; both dialects read them alike.
_GIVER = "CASE p_size % 4 WHEN 0 THEN 'Maria' WHEN 1 THEN 'Ana' WHEN 2 THEN 'Juana' ELSE 'Zoila' END || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'Lopez' WHEN 1 THEN 'Castro' ELSE 'de la Vega' END"
_TAKER = "CASE p_size % 5 WHEN 0 THEN 'Pedro' WHEN 1 THEN 'Luis' WHEN 2 THEN 'Bruno' WHEN 3 THEN 'Teo' ELSE 'Hugo' END || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'Ruiz' WHEN 1 THEN 'Soto' WHEN 2 THEN 'Montes' ELSE 'Paz' END"
_TOWN = "CASE p_partkey % 3 WHEN 0 THEN 'San Jose' WHEN 1 THEN 'Santa Cruz' ELSE 'San Diego' END"
_RIVER = "CASE p_size % 3 WHEN 0 THEN 'Blue River' WHEN 1 THEN 'Alder Creek' ELSE 'Clear Lake' END"
_BODY = "CASE p_partkey % 2 WHEN 0 THEN 'Land Commission' ELSE 'Rancho Company' END"
_RULER = "CASE p_size % 2 WHEN 0 THEN 'Pico' ELSE 'Micheltorena' END"
_SENTENCE = (
    f"'made by Gov. ' || {_RULER} || ' to ' || {_GIVER} || ' of ' || {_TOWN} || ' in ' || (1800 + p_size) || '. Patent for ' || p_size || ' acres issued in ' || (1800 + p_size + p_partkey % 7) || ' to ' || {_TAKER}"
    f" || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' by ' || {_BODY} END || ' along ' || {_RIVER}"
)


@query(f"""WITH s AS (SELECT p_partkey, {_GIVER} AS giver, {_TAKER} AS taker, {_TOWN} AS town, {_RIVER} AS river, (1800 + p_size)::VARCHAR AS early, (1800 + p_size + p_partkey % 7)::VARCHAR AS late, CASE WHEN p_partkey % 5 > 0 THEN {_BODY} ELSE '' END AS body, {_RULER} AS ruler FROM part)
SELECT p_partkey AS number, least(giver, taker) || '; ' || greatest(giver, taker) AS persons, taker AS patent_holders, least(river, town) || '; ' || greatest(river, town) AS locations,
       CASE WHEN early = late THEN early ELSE early || '; ' || late END AS dates, body AS organizations, ruler AS grantors, giver AS grantor, taker AS grantee, river AS place, late AS year FROM s""")
def entity_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-tagged entities of varied sentences routed to persons, patent holders, places, dates and organisations."""
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("number"), F.expr(_SENTENCE).alias("text"))
    return X.entity_roles(X.route_entities(X.tag_entities(p, "text"), "text")).drop("text", "entities")


# ---- evaluation --------------------------------------------------------------------------------------

_CONF = """r AS (SELECT lang AS model, quality AS g, CASE WHEN n_chars >= 200 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)),
s AS (SELECT model, sum(CASE WHEN g = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN g = 0 AND p = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN g = 1 AND p = 0 THEN 1 ELSE 0 END) AS fn, sum(p) AS ng, sum(g) AS gg FROM r GROUP BY GROUPING SETS ((model), ()))"""


@query(f"""WITH {_CONF} SELECT coalesce(model, 'Overall') AS model, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, (ng + gg - tp - fp - fn)::BIGINT AS tn, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
       round(coalesce((100 * tp)::DOUBLE / nullif(ng, 0), 0), 2) AS accuracy FROM s""")
def confusion_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels against a length rule, by language and over all."""
    j = _t(spark, sf_dir, "labels").join(_t(spark, sf_dir, "documents"), "doc_id")
    p = F.when(F.col("n_chars") >= 200, 1).otherwise(0)
    hit = lambda g, v: F.when((F.col("quality") == g) & (p == v), 1).otherwise(0).cast("long")
    rows = j.select(F.col("lang").alias("model"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), p.cast("long").alias("n_generated"), F.col("quality").cast("long").alias("n_golden"))
    return E.confusion(rows)


_GOLD = "g AS (SELECT c_custkey AS key, '[' || c_mktsegment || ', ' || n_name || ']' AS a, c_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT o_custkey AS key, o_orderpriority || ', ' || c_mktsegment AS a, c_name || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END AS b FROM orders JOIN customer ON o_custkey = c_custkey)"


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, n, o = (_t(spark, sf_dir, x) for x in ("customer", "nation", "orders"))
    g = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("key"), F.concat(F.lit("["), "c_mktsegment", F.lit(", "), "n_name", F.lit("]")).alias("a"), F.col("c_name").alias("b"))
    p = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("key"), F.concat("o_orderpriority", F.lit(", "), "c_mktsegment").alias("a"), F.concat("c_name", F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise("")).alias("b"))
    return g, p


def _values(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(string_split(regexp_replace({x}, '^\\[(.*)\\]$', '\\1'), ','), lambda y: lower(trim(y))), lambda y: y <> ''))"


_CELLS = f"""{_GOLD},
j AS (SELECT row_number() OVER () AS row, g.key, g.a AS ga, g.b AS gb, p.a AS pa, p.b AS pb FROM g JOIN p ON g.key = p.key),
u AS (SELECT row, key, 'a' AS col, {_values("ga")} AS g, {_values("pa")} AS p FROM j UNION ALL SELECT row, key, 'b', {_values("gb")}, {_values("pb")} FROM j),
h AS (SELECT row, key, col, len(list_intersect(g, p)) AS tp, len(p) - len(list_intersect(g, p)) AS fp, len(g) - len(list_intersect(g, p)) AS fn FROM u)"""


@query(f"""WITH {_CELLS}, s AS (SELECT col, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM h GROUP BY col),
m AS (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp + fn, 0), 0) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall FROM s)
SELECT col AS "column", tp, fp, fn, accuracy, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m""")
def column_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-value cells of customers against their orders."""
    return E.evaluate_columns(*_gold(spark, sf_dir), "key", ["a", "b"], digits=None)


@query(f"WITH {_CELLS} SELECT key, bool_and(fp = 0 AND fn = 0) AS perfect FROM h GROUP BY row, key")
def perfect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.perfect_matches(*_gold(spark, sf_dir), "key", ["a", "b"])


@query()
def column_metrics_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with Ratcliff-Obershelp similarity, which SQL lacks."""
    return E.evaluate_columns(*_gold(spark, sf_dir), "key", ["a", "b"], fuzzy=0.8)


@query("SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_golden, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS only_predicted, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS common")
def key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""WITH j AS (SELECT o1.o_orderpriority = o2.o_orderpriority AS same FROM orders o1 JOIN orders o2 ON o1.o_orderkey = o2.o_custkey), s AS (SELECT count(*) FILTER (WHERE same) AS tp, count(*) FILTER (WHERE NOT same) AS fp, count(*) FILTER (WHERE NOT same) AS fn FROM j)
SELECT tp, fp, fn, tp::DOUBLE / (tp + fp + fn) AS accuracy, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / (tp + fn) AS recall, 2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / (tp::DOUBLE / (tp + fp) + tp::DOUBLE / (tp + fn)) AS f1 FROM s""")
def positional_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    return E.positional(o.select(F.col("o_orderkey").alias("i"), "o_orderpriority"), o.select(F.col("o_custkey").alias("i"), "o_orderpriority"), "i", "o_orderpriority")


@query("""WITH k AS (SELECT o_orderkey AS key, o_orderstatus || ', ' || o_orderpriority AS a, o_orderpriority || ', [' || (o_custkey % 3) || ']' AS b FROM orders)
SELECT key, array_to_string(list_sort(list_transform(list_distinct(list_concat(string_split(a, ','), string_split(b, ','), string_split(a, ','), [chr(39) || 'x' || chr(39)])), lambda x: trim(translate(x, '[]"' || chr(39), '')))), ', ') AS ensemble FROM k""")
def ensemble_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models' name lists joined on the key and united."""
    o = _t(spark, sf_dir, "orders")
    key = F.col("o_orderkey").alias("key")
    a = o.select(key, F.concat("o_orderstatus", F.lit(", "), "o_orderpriority").alias("p"))
    b = o.select(key, F.concat("o_orderpriority", F.lit(", ["), (F.col("o_custkey") % 3).cast("string"), F.lit("]")).alias("p"))
    x = o.select(key, F.lit("'x'").alias("p"))
    return E.ensemble([a, b, a, x], ["key"], "p")


@query("""WITH w AS (SELECT unnest(string_split(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ',', 'g'), ',')) AS w FROM documents), n AS (SELECT trim(w) AS name FROM w WHERE trim(w) <> '')
SELECT name, count(*) AS frequency FROM n GROUP BY name ORDER BY frequency DESC, name LIMIT 10""")
def frequent_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten of comma-separated names."""
    d = _t(spark, sf_dir, "documents").select(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", ",").alias("names"))
    return E.top(E.name_frequency(d, "names"))


@query("SELECT p_type AS model, round(avg(p_size), 3) AS p_size, round(avg(p_retailprice), 3) AS p_retailprice FROM part GROUP BY p_type")
def model_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.model_means(_t(spark, sf_dir, "part"), "p_type", ["p_size", "p_retailprice"]).withColumnRenamed("p_type", "model")


@query("""WITH r AS (SELECT key, a AS golden, b AS generated FROM (SELECT c_custkey AS key, c_mktsegment || ', ' || c_name AS a, c_name || ',' || c_mktsegment || ',zz' AS b FROM customer)),
m AS (SELECT *, len(list_filter(string_split(generated, ','), lambda x: contains(golden, trim(x)))) AS matches FROM r)
SELECT key, matches, len(string_split(golden, ',')) AS n_golden, len(string_split(generated, ',')) AS n_generated, round_even(100.0::DOUBLE * matches / len(string_split(generated, ',')), 2) AS percentage FROM m""")
def substring_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    g = c.select("c_custkey", F.concat("c_mktsegment", F.lit(", "), "c_name").alias("x"))
    p = c.select("c_custkey", F.concat("c_name", F.lit(","), "c_mktsegment", F.lit(",zz")).alias("x"))
    return E.compare_names(g, p, "c_custkey", "x", "m").select("key", "matches", "n_golden", "n_generated", "percentage")


@query(f"""WITH {_FAMILY},
ups AS (SELECT dst AS id, max(CASE WHEN rel = 'father' THEN name END) AS father, max(CASE WHEN rel = 'mother' THEN name END) AS mother, max(CASE WHEN rel = 'spouse' THEN name END) AS spouse FROM fam JOIN ab ON ab.id = src GROUP BY dst),
kid AS (SELECT src AS id, string_agg(name, '|' ORDER BY dst) AS children FROM (SELECT DISTINCT src, dst FROM fam WHERE rel <> 'spouse') JOIN ab ON ab.id = dst GROUP BY src)
SELECT ab.id, ab.name, father, mother, spouse, coalesce(children, '') AS children, gender, age FROM ab LEFT JOIN ups ON ups.id = ab.id LEFT JOIN kid ON kid.id = ab.id""")
def flat_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat JSON documents of integrated people, with names for references, written, read and taken apart."""
    persons, entities = _kin(spark, sf_dir)
    about = settle(kinship.about_entities(persons, entities), "about")
    flat = kinship.flat_nodes(about, kinship.contract(kinship.link_censuses(persons), entities, about))
    path = scratch(spark, "flat")
    flat.select(F.concat_ws(":", "id", "json").alias("value")).write.text(path)
    line = spark.read.text(path)
    doc = F.from_json(F.expr("substring(value, instr(value, ':') + 1)"), "name string, father string, mother string, spouse string, children array<string>, info struct<gender: string, age: double>")
    rows = line.select(F.split_part("value", F.lit(":"), F.lit(1)).cast("long").alias("id"), doc.alias("d"))
    return rows.select("id", "d.name", "d.father", "d.mother", "d.spouse", F.array_join("d.children", "|").alias("children"), "d.info.gender", "d.info.age")


@query(f"""WITH RECURSIVE {_FAMILY},
up AS (SELECT DISTINCT src, dst FROM fam WHERE rel <> 'spouse'),
t AS (SELECT id AS node, 1 AS depth, [id] AS path, false AS circular FROM ab WHERE id NOT IN (SELECT dst FROM up)
      UNION ALL SELECT up.dst, t.depth + 1, list_append(t.path, up.dst), list_contains(t.path, up.dst) FROM t JOIN up ON up.src = t.node WHERE NOT t.circular),
tl AS (SELECT entity, string_agg(census_year, ',' ORDER BY census_year) AS years FROM jn WHERE turn = 1 GROUP BY entity)
SELECT t.node AS id, ab.name, t.depth, t.circular, CASE WHEN NOT circular THEN (SELECT max(src)::VARCHAR FROM fam WHERE rel = 'spouse' AND dst = t.node) END AS spouse, CASE WHEN NOT circular THEN years END AS years
FROM t JOIN ab ON ab.id = t.node JOIN tl ON tl.entity = t.node""")
def integrated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees of integrated people as nested JSON with spouses and timelines, written and read as rows."""
    persons, entities = _kin(spark, sf_dir)
    about = settle(kinship.about_entities(persons, entities), "about")
    links = settle(kinship.link_censuses(persons), "links")
    family = settle(kinship.contract(links, entities, about), "family")
    relations = kinship.relation_rows(links, entities)
    nested = kinship.nested_timeline(kinship.timeline(persons, entities, relations), relations)
    spouse = family.where("rel = 'spouse'").select(F.col("dst").alias("id"), F.col("src").alias("spouse"))
    info = about.join(nested.select(F.col("entity").alias("id"), "timeline"), "id").join(spouse, "id", "left")
    edges = family.where("rel <> 'spouse'")
    path = scratch(spark, "documents")
    graph.tree_json(graph.closure(edges, graph.roots_of(about, edges)), settle(info, "info")).select(F.col("json").alias("value")).write.option("lineSep", "\n").text(path)
    one = scratch(spark, "lists")  # a list of trees a file, as they are kept
    spark.read.text(path).withColumn("bucket", F.pmod(F.hash("value"), F.lit(16))).groupBy("bucket").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).write.partitionBy("bucket").text(one)
    rows = D.read_trees(spark, f"{one}/*")
    years = F.array_join(F.array_sort(F.json_object_keys("timeline")), ",")
    return rows.select("id", "name", "depth", "circular", "spouse", F.when(F.col("timeline").isNotNull(), years).alias("years"))


@query("""WITH t AS (SELECT o_custkey AS id, list({'y': 1700 + o_orderkey % 150, 'a': CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 60)::DOUBLE END, 'k': o_orderkey} ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey),
f AS (SELECT o_custkey AS id, 1700 + o_orderkey % 150 AS y, min(o_orderkey) AS k FROM orders GROUP BY ALL),
v AS (SELECT f.id, f.y, CASE WHEN k % 4 > 0 THEN (k % 60)::DOUBLE END AS age, CASE WHEN k % 3 = 0 THEN (1600 + k % 100)::DOUBLE END AS birth FROM f)
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 10 = 0 THEN 1799.0::DOUBLE END, (SELECT birth FROM v WHERE v.id = c_custkey AND y = 1821), (SELECT arg_max(y - age, y) FROM v WHERE v.id = c_custkey AND age IS NOT NULL)) AS birth_year
FROM customer WHERE c_custkey IN (SELECT id FROM f)""")
def timeline_birth_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of birth estimated from timelines: given, recorded in 1821, or by the latest age."""
    o, k = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = o.groupBy(F.col("o_custkey").alias("id"), (1700 + k % 150).cast("int").alias("y")).agg(F.min("o_orderkey").alias("k"))
    k = F.col("k")
    record = F.struct(F.when(k % 4 > 0, (k % 60).cast("double")).alias("age"), F.when(k % 3 == 0, (1600 + k % 100).cast("double")).alias("birth_year"))
    lines = first.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("y", record.alias("r")))).alias("timeline"))
    given = F.when(F.col("id") % 10 == 0, F.lit(1799.0)).otherwise(F.lit(0.0))
    return lines.join(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id").select("id", graph.birth_year_of_timeline(given, F.col("timeline")).alias("birth_year"))


@query("""SELECT p_partkey AS pc_id, p_partkey AS "1790_ecpp_id", CASE WHEN p_partkey % 4 > 0 THEN p_partkey + 7 ELSE -1 END AS baptisms_id, split_part(p_name, ' ', 2) AS last_name, split_part(p_name, ' ', 1) AS first_name, NULL::VARCHAR AS father_last_name,
       NULL::VARCHAR AS father_first_name, NULL::VARCHAR AS mother_last_name, NULL::VARCHAR AS mother_first_name, CASE WHEN p_partkey % 4 > 0 THEN 'o' || (p_partkey + 7) END AS father_origin, CASE WHEN p_partkey % 4 > 0 THEN 'p' || (p_partkey + 7) END AS mother_origin,
       NULL::VARCHAR AS father_military_status, CASE WHEN p_partkey % 4 > 0 THEN 'f' END AS sex, array_to_string([p_brand, p_type], ', ') AS race_1790, CASE WHEN p_partkey % 4 > 0 THEN 'mulato, indio' END AS ethnicity,
       CASE WHEN p_partkey % 4 > 0 THEN 'd' || (p_partkey + 7) END AS baptismal_date, NULL::VARCHAR AS location_ecpp_baptism, p_type AS location_1790_census, NULL::VARCHAR AS origin_parish_1790_census, NULL::VARCHAR AS location_other_race FROM part""")
def enriched_v0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first profile's table: census and baptism columns of matches, one in four without its baptism."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    matches = p.select(k.alias("pc_id"), k.alias("ecpp_id"), F.when(k % 4 > 0, k + 7).otherwise(-1).alias("#ID"))
    census = p.select(k.alias("ecpp_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("First"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("Last"), F.concat(F.lit("["), "p_brand", F.lit("], "), "p_type", F.lit(".")).alias("Race"), F.col("p_type").alias("Current_Location"))
    b = (k + 7).cast("string")
    baptisms = p.select((k + 7).alias("#ID"), F.concat(F.lit("o"), b).alias("FOrigin"), F.concat(F.lit("p"), b).alias("MOrigin"), F.lit("f").alias("Sex"), F.lit("mulato ,[indio]").alias("Ethnicity"), F.concat(F.lit("d"), b).alias("FmtdDate"))
    return linkage.enrich_v0(matches, baptisms, census)


@query("""SELECT count(*) AS rows, coalesce(sum(len(string_split(CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment || ', ' || c_name || CASE WHEN c_nationkey > 9 THEN ',x' ELSE '' END END, ','))), 0)::BIGINT AS generated, 0::BIGINT AS absent, sum(c_nationkey)::BIGINT AS correct FROM customer""")
def name_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in comma-separated cells, some of them null, of a column that is absent, and the sum of matches."""
    names = F.when(F.col("c_custkey") % 5 > 0, F.concat("c_mktsegment", F.lit(", "), "c_name", F.when(F.col("c_nationkey") > 9, ",x").otherwise("")))
    return E.name_totals(_t(spark, sf_dir, "customer").select(names.alias("generated"), F.col("c_nationkey").alias("Match")), ["generated", "absent"])


@query("""SELECT s_suppkey AS id, '{"name":"' || s_name || '","list":["a","[b] c","x' || s_nationkey || '"],"deep":{"[k]":"v","n":[["y"]]},"number":' || s_suppkey || '}' AS document FROM supplier""")
def bracketless_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enclosing brackets taken from the texts of nested documents at any depth; keys, lists and inner brackets stay."""
    s = _t(spark, sf_dir, "supplier")
    text = F.concat(F.lit('{"name":"['), "s_name", F.lit(']","list":["[a]","[b] c","[x'), "s_nationkey", F.lit(']"],"deep":{"[k]":"[v]","n":[["[y]"]]},"number":'), "s_suppkey", F.lit("}"))
    return s.select(F.col("s_suppkey").alias("id"), N.outer_brackets_json(text).alias("document"))


@query("""WITH m AS (SELECT DISTINCT o_custkey AS household, o_orderpriority AS name, o_orderkey % 7 AS pid FROM orders)
SELECT household, string_agg(pid || ':' || name, '|' ORDER BY pid, name) AS members FROM m GROUP BY household""")
def household_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members added to household units, repeats once."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("household"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 7).alias("id"))
    units = family.units_by_household(o, "household")
    return units.select("household", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["pid"].cast("string"), m["name"])), "|").alias("members"))


@query("""WITH e AS (SELECT n_regionkey AS src, n_nationkey AS dst FROM nation UNION ALL SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey % 2 = 0)
SELECT src, array_to_string(list(DISTINCT dst ORDER BY dst), ',') AS children FROM e GROUP BY src""")
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of every node, each once, however often they were added."""
    e = _t(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))
    return graph.adjacency(e.unionByName(e.where("dst % 2 = 0"))).select("src", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'maria ' || lower(replace(s_name, '#', ' ')) END AS reference, 'made by  to ' || s_name || ' and ' AS description, chr(123) || chr(10) || '  "k" : ' || s_suppkey || ',' || chr(10) || '  "n" : "' || s_name || '"' || chr(10) || chr(125) AS pretty FROM supplier""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without particles and accents (blank ones null), descriptions without governors, indented documents."""
    s = _t(spark, sf_dir, "supplier")
    ref = F.when(F.col("s_suppkey") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" de Mar\u00eda "), F.replace("s_name", F.lit("#"), F.lit("  "))))
    out = s.select(F.col("s_suppkey").alias("id"), N.sanitize_reference(ref).alias("reference"), X.without_governors(F.concat(F.lit("made by Gov. Pico to "), "s_name", F.lit(" and Gov. Alvarado"))).alias("description"), F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n")).alias("doc"))
    return out.withColumn("pretty", F.to_json("doc", {"pretty": "true"})).drop("doc")


@query("""WITH n AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT x.a, y.a AS b FROM n x JOIN n y ON split_part(x.a, ' ', 1) = split_part(y.a, ' ', 1))
SELECT a, b, least(length(a), length(b), length(a) - length(translate(a, b, '')), length(b) - length(translate(b, a, ''))) * 2.0::DOUBLE >= 0.8::DOUBLE * (length(a) + length(b)) AS may FROM p""")
def similarity_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lengths and letters say of the similarity of names."""
    n = _names(spark, sf_dir)
    pairs = n.select("f", F.col("p_name").alias("a")).join(n.select("f", F.col("p_name").alias("b")), "f")
    return pairs.select("a", "b", C.may_reach(F.col("a"), F.col("b"), 0.8).alias("may"))


_WIDE = "CASE WHEN fd <= 2 THEN 1 ELSE 0 END", "CASE WHEN ld <= 2 THEN 1 ELSE 0 END"


@query(f"""WITH {_sql_candidates(3)}
SELECT role, ecpp_id, bid, fd AS first_distance, ld AS last_distance, ({_WIDE[0]} + {_WIDE[1]} + {_GENDER} + CASE WHEN abs(age - bage) <= 2 THEN 1 ELSE 0 END)::DOUBLE AS score,
       concat_ws(', ', CASE WHEN fd <= 2 THEN 'First Name' END, CASE WHEN ld <= 2 THEN 'Last Name' END, CASE WHEN ({_GENDER}) = 1 THEN 'Gender' END, CASE WHEN abs(age - bage) <= 2 THEN 'Age' END) AS criteria FROM k WHERE role <> 'father'""")
def linkage_v1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0/1 profile over names up to three edits apart, so that its name features hold for some pairs and fail for others."""
    census, baptisms = _people(spark, sf_dir)
    out = None
    for role in ("direct", "mother"):
        one = linkage.v1_scores(linkage.candidates(census, baptisms, role, most=3), "c_Gender", "b_Sex", "c_Age", "b_Age")
        out = one if out is None else out.unionByName(one)
    return out.select("role", F.col("c_ecpp_id").alias("ecpp_id"), F.col("b_#ID").alias("bid"), "first_distance", "last_distance", "score", "criteria")


@query(f"""WITH {_NAMES}, p AS (SELECT a.f || CASE WHEN a.n % 3 = 0 THEN '' ELSE ' ' || a.l END || CASE WHEN a.n % 2 = 0 THEN ' ' || b.l ELSE '' END AS parent, b.f || CASE WHEN b.n % 4 = 0 THEN '' ELSE ' ' || b.l END || CASE WHEN b.n % 3 = 0 THEN ' ' || a.l ELSE '' END AS child FROM n a JOIN n b ON a.n % 5 = b.n % 5 AND a.f <> b.f),
t AS (SELECT DISTINCT parent, child, string_split(parent, ' ') AS o, string_split(child, ' ') AS w FROM p)
SELECT parent, child, CASE WHEN len(w) < 2 OR len(o) < 2 THEN true ELSE len(list_filter(w, lambda t: {_dist("t", "o[-1]")} <= 2)) > 0 OR (len(w) > 2 AND {_dist("w[-2]", "(CASE WHEN len(o) > 2 THEN o[-2] ELSE o[-1] END)")} <= 2) END AS fits FROM t""")
def surname_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether surnames of children fit those of parents, for names of one to three tokens from the distinct part names."""
    n = _names(spark, sf_dir).select("f", "l", "n")
    a, b = n.toDF("af", "al", "an"), n.toDF("bf", "bl", "bn")
    also = lambda when, x: F.when(when, F.concat(F.lit(" "), x)).otherwise("")
    pairs = a.join(b, (F.col("an") % 5 == F.col("bn") % 5) & (F.col("af") != F.col("bf")))
    parent = F.concat("af", also(F.col("an") % 3 != 0, F.col("al")), also(F.col("an") % 2 == 0, F.col("bl")))
    child = F.concat("bf", also(F.col("bn") % 4 != 0, F.col("bl")), also(F.col("bn") % 3 == 0, F.col("al")))
    return pairs.select(parent.alias("parent"), child.alias("child")).distinct().withColumn("fits", graph.valid_child_surname(F.col("parent"), F.col("child")))


@query("""SELECT 'ALAMEDA COUNTY' AS county, 'REAL ' || upper(p_name) AS name, '#' || p_partkey AS number, 'in earnest.' AS description FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'INDEX COUNTY', 'LISTED ' || upper(p_name), '#' || p_partkey, 'in the index.' FROM part WHERE p_partkey % 2 = 1""")
def corpus_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts begin at the first county of the corpus where they have it: what an index lists before it is left out."""
    p = _t(spark, sf_dir, "part")
    key, name = F.col("p_partkey").cast("string"), F.upper("p_name")
    head = F.concat(F.lit("INDEX COUNTY\nLISTED "), name, F.lit(", #"), key, F.lit(" in the index.\n"))
    body = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("ALAMEDA COUNTY\nREAL "), name, F.lit(", #"), key, F.lit(" in earnest.\n"))).otherwise("")
    sections = X.split_sections(p.select(F.concat(head, body).alias("text")))
    return X.split_entries(sections.withColumn("place", F.col("county"))).select(F.col("place").alias("county"), "name", "number", "description")


@query("""SELECT 'padron_nation' AS dataset, n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' ' || n_regionkey END AS strict, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ' ' || n_regionkey ELSE n_regionkey::VARCHAR END AS loose, NULL::DOUBLE AS age FROM nation
UNION ALL SELECT 'region', r_regionkey::VARCHAR, NULL, r_name, 7.0 FROM region""")
def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named datasets as views: each one's key column, surnames with and without gaps, and an age column where there was none."""
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    path = scratch(spark, "catalog")
    n.select(F.col("n_nationkey").alias("ecpp_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("Paternal"), F.col("n_regionkey").alias("Maternal")).write.csv(f"{path}/padron_nation.tsv", header=True, sep="\t")
    r.select(F.col("r_regionkey").alias("#ID"), F.col("r_name").alias("Paternal"), F.lit(None).cast("string").alias("Maternal"), F.lit("7").alias("Age")).write.csv(f"{path}/region.csv", header=True)
    tabular.catalog(spark, {"padron_nation": f"{path}/padron_nation.tsv", "region": f"{path}/region.csv"})
    out = None
    for name in ("padron_nation", "region"):
        df = tabular.ensure_column(spark.table(name), "age", "string")
        df = tabular.last_name(tabular.last_name(df, "paternal", "maternal", "loose"), "paternal", "maternal", "strict", null_propagating=True)
        one = df.select(F.lit(name).alias("dataset"), F.col(f"`{tabular.id_column(name).lower()}`").alias("id"), "strict", "loose", F.col("age").cast("double").alias("age"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT unnest(['customers', 'orders']) AS "Metric", unnest([(SELECT count(*) FROM customer)::VARCHAR, (SELECT count(*) FROM orders)::VARCHAR]) AS "Value" """)
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t, a: _t(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(a))
    return sinks.as_metrics(n("customer", "customers").crossJoin(n("orders", "orders")))


@query()
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents in seeded random order (a sampling operator)."""
    return E.sample(_t(spark, sf_dir, "documents").select("doc_id", "lang"), 50, 7)


@query("""WITH c AS (SELECT c_nationkey AS k, string_agg('{"id":' || (c_custkey + 1000) || ',"name":"' || c_name || '","age":' || floor(c_acctbal)::DOUBLE::VARCHAR || ',"children":[]}', ',' ORDER BY c_custkey) AS kids FROM customer GROUP BY c_nationkey),
n AS (SELECT n_regionkey AS k, string_agg('{"id":' || (n_nationkey + 100) || ',"name":"' || n_name || '","children":[' || coalesce(kids, '') || ']}', ',' ORDER BY n_nationkey) AS kids FROM nation LEFT JOIN c ON c.k = n_nationkey GROUP BY n_regionkey)
SELECT (r_regionkey + 1)::BIGINT AS root, '{"id":' || (r_regionkey + 1) || ',"name":"' || r_name || '","children":[' || coalesce(kids, '') || ']}' AS json FROM region LEFT JOIN n ON n.k = r_regionkey""")
def nested_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region tree as nested JSON."""
    nodes, edges = _hierarchy(spark, sf_dir)
    tree = graph.closure(edges, graph.roots_of(nodes, edges.withColumn("rel", F.lit("father"))))
    return graph.tree_json(tree, nodes)


@query(f"""WITH k AS (SELECT DISTINCT p_name AS name FROM part)
SELECT a.p_partkey AS id, a.p_name AS name, k.name AS known, {_dist("a.p_name", "k.name")}::INT AS distance FROM part a, k WHERE {_dist("a.p_name", "k.name")} <= 2""")
def incremental_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream-static join of new records with known names, here over a table; tests run it as a stream."""
    p = _t(spark, sf_dir, "part")
    return incremental.link_stream(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), p.select(F.col("p_name").alias("name")))


@query("SELECT p_partkey, list_filter(list_transform(string_split(p_brand || '., [' || p_type || ']', ','), lambda x: trim(translate(rtrim(trim(x), '.'), '[]', ''))), lambda x: x <> '') AS races, ltrim(trim('#' || p_size), '#') AS number, CASE WHEN p_size % 3 = 0 THEN round_even(p_retailprice / 7, 2) WHEN p_size % 3 = 1 THEN round_even(p_retailprice / 11, 2) END AS score FROM part")
def cell_cleaners(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "direct").when(F.col("p_size") % 3 == 1, "mother").otherwise("none")
    price = F.col("p_retailprice")
    return p.select(
        "p_partkey", N.race_list(F.concat("p_brand", F.lit("., ["), "p_type", F.lit("]"))).alias("races"), C.normalize_grant_number(F.concat(F.lit("#"), F.col("p_size").cast("string"))).alias("number"),
        N.pick_score(kind, price / 7, price / 11, price).alias("score"),
    )


# ---- sources and sinks: tables written to the shared folder and read back ----------------------------------


@query("SELECT c_custkey::VARCHAR AS key, 'Ana ' || c_name AS name, c_mktsegment AS race, c_nationkey::INT AS age FROM customer")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited file with drifting headers, line ends in cells and blank rows."""
    c = _t(spark, sf_dir, "customer")
    full = c.select(F.col("c_custkey").cast("string").alias("Key"), F.concat(F.lit("Ana"), F.lit("\n"), F.lit('"q"')).alias("Ego_ First Name"), F.col("c_name").alias("Ego_Paternal  Last Name"), F.col("c_mktsegment").alias("Race"), F.col("c_nationkey").cast("string").alias("Age "))
    blank = c.where("c_custkey % 3 = 0").select(*[F.lit(v).alias(n) for n, v in zip(full.columns, (None, " ", None, None, None), strict=True)])
    path = scratch(spark, "csv")
    sinks.write_csv(full.unionByName(blank), path)
    read = tabular.drop_blank_rows(tabular.read_csv(spark, path))
    read = read.withColumn("ego_first name", F.replace("ego_first name", F.lit('\n"q"'), F.lit("")))
    people = tabular.to_persons(read, {"name": ["ego_first name", "ego_paternal last name"], "race": "race", "age": "age "}).select("ordinal", "name", "race", "age")
    return read.select("ordinal", "key").join(people, "ordinal").select("key", "name", "race", "age")


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def tsv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tsv")
    _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("Key "), F.col("n_name").alias("NAME")).write.csv(path, header=True, sep="\t")
    return tabular.read_tsv(spark, path, ordinal=False).select("key", "name")


@query("SELECT p_partkey, p_name, p_size FROM part")
def parquet_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches kept as Parquet."""
    path = scratch(spark, "matches")
    sinks.write_matches(_t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.parquet(path)


@query("""SELECT s_name AS "Grant Name", s_suppkey::VARCHAR AS "Grant Number", 'p' || s_nationkey AS "Persons (entities)", s_nationkey::VARCHAR AS "Year" FROM supplier WHERE s_suppkey % 4 > 0""")
def records_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in JSON lists and in objects of records, one file for each nation; those without a name are dropped."""
    s = _t(spark, sf_dir, "supplier")
    record = F.struct(F.when(F.col("s_suppkey") % 4 > 0, F.col("s_name")).alias("Grant Name"), F.concat(F.lit("#"), F.col("s_suppkey").cast("string")).alias("Grant Number"), F.concat(F.lit("p"), F.col("s_nationkey").cast("string")).alias("Persons"), F.col("s_nationkey").alias("Year"))
    each = s.groupBy("s_nationkey").agg(F.collect_list(record).alias("r"), F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), record))).alias("m"))
    path = scratch(spark, "records")
    each.select("s_nationkey", F.when(F.col("s_nationkey") % 2 == 0, F.to_json("r")).otherwise(F.to_json("m")).alias("value")).write.partitionBy("s_nationkey").text(path)
    return D.golden(D.read_records(spark, f"{path}/*")).select("Grant Name", "Grant Number", "Persons (entities)", "Year")


@query("SELECT n_name || ' a' || chr(241) || 'o' AS line FROM nation")
def text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole text files, by turns in UTF-8 and in ISO-8859-1."""
    n = _t(spark, sf_dir, "nation").select("n_regionkey", F.concat("n_name", F.lit(" a\u00f1o")).alias("line"))
    path = scratch(spark, "texts")
    for odd, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        n.where(F.col("n_regionkey") % 2 == odd).write.option("encoding", encoding).csv(f"{path}/{odd}")
    lines = D.read_text(spark, f"{path}/*/*.csv").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''").select(F.element_at(F.split("line", ","), -1).alias("line"))


@query(f"""WITH RECURSIVE {_TREE}
SELECT a.name, t.depth, (SELECT count(*) FROM e WHERE e.src = t.node)::INT AS children, a.age, r.name AS root FROM t JOIN a ON a.id = t.node JOIN a r ON r.id = t.root""")
def trees_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region tree written as nested JSON, a file for each root, and read as rows."""
    nodes, edges = _hierarchy(spark, sf_dir)
    tree = graph.closure(edges, graph.roots_of(nodes, edges.withColumn("rel", F.lit("father"))))
    path = scratch(spark, "trees")
    graph.tree_json(tree, nodes).write.partitionBy("root").text(path)
    read = settle(D.read_trees(spark, f"{path}/*"), "tree_rows")
    top = read.where("depth = 1").select("file", "root", F.col("name").alias("root_name"))
    return read.join(top, ["file", "root"]).select("name", "depth", "children", "age", F.col("root_name").alias("root"))


@query("SELECT r_regionkey AS k, r_name AS name FROM region")
def json_lines_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    sinks.write_json_lines(_t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), path)
    return spark.read.schema("k int, name string").json(path)


@query("""WITH p AS (SELECT c_custkey AS id, nullif(CASE WHEN c_custkey % 4 > 0 THEN c_name END, '') AS name, CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'f' END AS sex, (c_nationkey * 2)::DOUBLE AS age FROM customer)
SELECT id, lower(sex) AS sex, age FROM p WHERE name IS NOT NULL AND age <= 21""")
def person_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named persons of 21 or less, split by sex and put together again; ages that are no numbers are null."""
    k = F.col("c_custkey")
    age = F.when(F.col("c_nationkey") == 24, F.lit(float("nan"))).otherwise((F.col("c_nationkey") * 2).cast("double"))
    p = _t(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 4 > 0, F.col("c_name")).otherwise("").alias("name"), F.when(k % 2 == 0, "M").otherwise("f").alias("sex"), N.nan_to_null(age).alias("age"))
    m, f = filters.split_by_sex(filters.at_most_age(filters.named(p, "name"), "age", 21), "sex")
    return m.unionByName(f).select("id", F.lower("sex").alias("sex"), "age")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def matched_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a match names, each once."""
    return filters.matched_rows(_t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders"), {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS normal FROM documents")
def normalize_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that decomposes any character."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(N.normalize(F.col("text"), exact=True).cast("binary")).alias("normal"))


@query(f"""WITH {_NAMES}
SELECT a.p_name AS a, b.p_name AS b, round({_prob(_dist("a.p_name", "b.p_name"), _most("a.p_name", "b.p_name"))}, 9) AS score, greatest(0.0::DOUBLE, (5 - abs(a.n - b.n)) / 5.0::DOUBLE) AS age_score FROM n a JOIN n b ON a.f = b.f""")
def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match probability of names as written (accents and capitals do not count), and the decay of an age difference."""
    n = _names(spark, sf_dir)
    a, b = n.select("f", F.col("p_name").alias("a"), F.col("n").alias("x")), n.select("f", F.col("p_name").alias("b"), F.col("n").alias("y"))
    score = N.names_score(F.upper("a"), F.translate("b", "aeo", "\u00e1\u00e9\u00f3"))
    return a.join(b, "f").select("a", "b", F.round(score, 9).alias("score"), linkage.age_decay(F.col("x"), F.col("y")).alias("age_score"))


_SPELT = "replace(replace({0}.p_name, 'g', 'ph'), 'bolt', 'bollt')", "replace(replace(replace({0}.p_name, 'g', 'j'), 'hot', 'ot'), 'bolt', 'boyt')"


@query(f"""WITH {_NAMES}, p AS (SELECT a.p_name AS a, b.p_name AS b, {_SPELT[0].format("a")} AS x, {_SPELT[1].format("b")} AS y FROM n a JOIN n b ON a.f = b.f OR a.l = b.l)
SELECT a, b, {_digraph_dist("x", "y")}::INT AS distance, {_digraph_dist("y", "x")}::INT AS back FROM p""")
def digraph_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of names in two spellings, with two letters that stand for one and a silent letter."""
    n = _names(spark, sf_dir)
    by = lambda w: n.select(F.col("p_name").alias("a"), w).join(n.select(F.col("p_name").alias("b"), w), w)
    pairs = by("f").select("a", "b").unionByName(by("l").select("a", "b")).distinct()
    x = F.replace(F.replace("a", F.lit("g"), F.lit("ph")), F.lit("bolt"), F.lit("bollt"))
    y = F.replace(F.replace(F.replace("b", F.lit("g"), F.lit("j")), F.lit("hot"), F.lit("ot")), F.lit("bolt"), F.lit("boyt"))
    return pairs.select("a", "b", N.digraph_distance(x, y).alias("distance"), N.digraph_distance(y, x).alias("back"))


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+'))::BIGINT AS n_spans, md5(array_to_string(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+'), ',')) AS texts FROM documents""")
def windowed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised words of whole documents by a model that gets texts in overlapping windows."""

    def make():
        import re

        word = re.compile("[A-Z][a-z]+")
        return lambda texts: [[(m.start(), m.end(), "NAME") for m in word.finditer(t)] for t in texts]

    d = X.tag_spans(_t(spark, sf_dir, "documents").select("doc_id", "text"), "text", make, "capitalised", window=1000, overlap=200)
    return d.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.md5(F.array_join(F.transform("spans", lambda x: x["text"]), ",").cast("binary")).alias("texts"))


@query("""SELECT 'customers' AS dataset, 'person' AS kind, c_name AS value FROM customer
UNION ALL SELECT 'suppliers', CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN 'rejected' ELSE 'person' END, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 5 = 0 THEN s_name || ',' || s_nationkey || ',x' ELSE s_name END FROM supplier
UNION ALL SELECT 'absent', 'failed', NULL UNION ALL SELECT 'other', 'failed', NULL""")
def isolated_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A good file, one with short and long rows, one that is absent and one without the columns asked for, ingested together."""
    path = scratch(spark, "ingest")
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    c.select(F.col("c_name").alias("Name "), F.col("c_nationkey").cast("string").alias("AGE")).write.csv(f"{path}/good", header=True, sep="\t")
    short, long = F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 5 == 0
    line = F.when(short, F.col("s_name")).when(long, F.concat_ws(",", "s_name", "s_nationkey", F.lit("x"))).otherwise(F.concat_ws(",", "s_name", "s_nationkey"))
    s.select(line.alias("value")).write.text(f"{path}/malformed")
    who = {"name": "name", "age": "age"}
    all_of = ingest.Ingest(spark, {
        "customers": ingest.Dataset(f"{path}/good", who, "\t"), "suppliers": ingest.Dataset(f"{path}/malformed", who, columns=("name", "age")),
        "absent": ingest.Dataset(f"{path}/absent", who), "other": ingest.Dataset(f"{path}/good", {"name": "no such column"}, "\t"),
    })
    persons = all_of.all_persons().select("dataset", F.lit("person").alias("kind"), F.col("name").alias("value"))
    rejected = all_of.rejected().select("dataset", F.lit("rejected").alias("kind"), F.col("record").alias("value"))
    return persons.unionByName(rejected).unionByName(all_of.errors().select("dataset", F.lit("failed").alias("kind"), F.lit(None).cast("string").alias("value")))


@query(f"""WITH k AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name), d AS (SELECT * FROM (SELECT a.name AS l, b.name AS r, {_dist("a.name", "b.name")}::INT AS d FROM k a, k b) WHERE d <= 2)
SELECT p.p_partkey AS id, p.p_name AS name, k.id AS known_id, k.name AS known, d.d AS distance FROM part p JOIN d ON d.l = p.p_name JOIN k ON k.name = d.r WHERE k.id < p.p_partkey""")
def stateful_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a stream in three batches, each record matched with the names that came before it."""
    base = scratch(spark, "stream")
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    step = (p.agg(F.max("id")).first()[0] or 0) // 3 + 1
    for k in range(3):
        p.where(F.floor(F.col("id") / step) == k).write.mode("append").parquet(f"{base}/in")
        out = incremental.advance(spark, f"{base}/in", "id long, name string", incremental.link_seen, f"{base}/out", f"{base}/state")
    return out
