"""Name and field functions as Column expressions: normalisation, orthography-aware distance, scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: substitutions that cost nothing in colonial Spanish spelling.
FREE_PAIRS = ("bv", "cs", "cz", "sz", "iy", "gj", "cq", "uv")
# Two letters that stand for one at no cost, and the silent letter, which comes and goes at no cost.
DIGRAPHS = (("ph", "j"), ("ll", "y"))
SILENT = "h"
# Fixed value: name particles, deleted in this order.
PARTICLES = ("de ", "del ", "de la ", "y ", "los ")
# Letters of one zero-cost class (the transitive closure of FREE_PAIRS) and their representative.
CLASS_FROM, CLASS_TO = "bvcszqiygju", "bbcccciiggb"



def _table() -> tuple[str, str]:
    """Latin letters (up to U+017F) that decompose into one plain letter and marks, and those plain letters."""
    pairs = []
    for k in range(0xC0, 0x180):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalpha():
            pairs.append((chr(k), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _table()


@F.pandas_udf(T.StringType())
def _exact(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        if t is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower()

    return texts.map(one)


def normalize(name: Column, exact: bool = False) -> Column:
    """Lower case without accents. The fast form covers Latin letters; ``exact`` decomposes any character in an Arrow UDF."""
    return _exact(name) if exact else F.lower(F.translate(name, _FROM, _TO))


def normalize_particles(name: Column, whole_words: bool = False, exact: bool = False) -> Column:
    """:func:`normalize` after deleting particles, with white space collapsed.

    By default particles go as substrings, in order, before lower-casing, word ends included; ``whole_words`` keeps to whole words.
    """
    out = F.trim(F.regexp_replace(name, r"\s+", " "))
    if whole_words:
        out = F.regexp_replace(out, r"(?i)(?<![^ ])(?:de la|del|de|y|los) ", "")
    else:
        for p in PARTICLES:
            out = F.replace(out, F.lit(p), F.lit(""))
    return F.trim(normalize(out, exact))


def canon(name: Column) -> Column:
    """One letter for each zero-cost class; distances of canonical forms never exceed the weighted distance."""
    return F.translate(name, CLASS_FROM, CLASS_TO)


def own_keys(name: Column, k: int) -> Column:
    """The k + 1 even pieces of a name in canonical letters, each with the name's length and its number.

    Of two names within ``k`` edits, one has at least one of the other's pieces unedited, few places away: see :func:`probe_keys`.
    """
    n = F.length(name)
    cut = lambda i: F.floor(n * i / F.lit(k + 1)).cast("int")
    piece = lambda i: F.concat_ws(":", n, i, F.substring(canon(name), cut(i) + 1, cut(i + 1) - cut(i)))
    return F.transform(F.sequence(F.lit(0), F.lit(k)), piece)


def probe_keys(name: Column, k: int) -> Column:
    """The keys of :func:`own_keys` that any name within ``k`` edits may have, without repeats."""
    n, plain = F.length(name), canon(name)

    def of_length(m: Column) -> Column:
        cut = lambda i: F.floor(m * i / F.lit(k + 1)).cast("int")

        def of_piece(i: Column) -> Column:
            size = cut(i + 1) - cut(i)
            # A piece that moves by d has |d| edits before it and |n - m - d| after it at least.
            low = F.greatest(cut(i) + F.ceil((n - m - k) / 2).cast("int"), F.lit(0))
            high = F.least(cut(i) + F.floor((n - m + k) / 2).cast("int"), n - size)
            starts = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda at: F.concat_ws(":", m, i, F.substring(plain, at + 1, size)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k)), of_piece))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(n - k, F.lit(0)), n + k), of_length)))


def _free(a: Column, b: Column) -> Column:
    pairs = [p for x in FREE_PAIRS for p in (x, x[::-1])]
    return (a == b) | F.concat(a, b).isin(pairs)


def weighted_distance(a: Column, b: Column) -> Column:
    """Edit distance in which FREE_PAIRS substitute for nothing; an empty side costs the length of the other. Null in, null out."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    first = F.sequence(F.lit(0), F.length(b))

    def row(above: Column, x: Column, i: Column) -> Column:
        def cell(acc: Column, y: Column, j: Column) -> Column:
            left = F.element_at(acc, -1)
            return F.concat(
                acc,
                F.array(F.least(left + 1, F.get(above, j + 1) + 1, F.get(above, j) + F.when(_free(x, y), F.lit(0)).otherwise(F.lit(1)))),
            )

        steps = F.transform(chars(b), lambda y, j: F.struct(y.alias("y"), j.alias("j")))
        return F.aggregate(steps, F.array(i + 1), lambda acc, s: cell(acc, s["y"], s["j"]))

    rows = F.transform(chars(a), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.element_at(F.aggregate(rows, first, lambda acc, s: row(acc, s["x"], s["i"])), -1).cast("int")


def digraph_distance(a: Column, b: Column) -> Column:
    """:func:`weighted_distance` in which DIGRAPHS substitute for one letter and SILENT is inserted and deleted for nothing. Null in, null out.

    A cell looks two letters back on either side, so two rows are kept.
    """
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    heard = lambda c, n: F.length(F.replace(F.substring(c, 1, n), F.lit(SILENT), F.lit("")))
    two = lambda c, end: F.when(end > 0, F.substring(c, end, 2))
    step = lambda x: F.when(x == SILENT, F.lit(0)).otherwise(F.lit(1))
    stands = lambda pair, one: F.coalesce(F.concat(pair, F.lit(":"), one).isin([f"{p}:{x}" for p, x in DIGRAPHS]), F.lit(False))
    first = F.transform(F.sequence(F.lit(0), F.length(b)), lambda n: heard(b, n))

    def row(over: Column, above: Column, x: Column, i: Column) -> Column:
        def cell(acc: Column, y: Column, j: Column) -> Column:
            edits = F.least(
                F.element_at(acc, -1) + step(y), F.get(above, j + 1) + step(x), F.get(above, j) + F.when(_free(x, y), F.lit(0)).otherwise(F.lit(1)),
                F.when(stands(two(a, i), y), F.get(over, j)), F.when(stands(two(b, j), x), F.get(above, j - 1)),
            )
            return F.concat(acc, F.array(edits))

        steps = F.transform(chars(b), lambda y, j: F.struct(y.alias("y"), j.alias("j")))
        return F.aggregate(steps, F.array(heard(a, i + 1)), lambda acc, s: cell(acc, s["y"], s["j"]))

    rows = F.transform(chars(a), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    start = F.struct(F.array().cast("array<int>").alias("over"), first.alias("above"))
    last = F.aggregate(rows, start, lambda acc, s: F.struct(acc["above"].alias("over"), row(acc["over"], acc["above"], s["x"], s["i"]).alias("above")))
    return F.element_at(last["above"], -1).cast("int")


def _dp(a: str, b: str) -> int:
    free = {p for x in FREE_PAIRS for p in (x, x[::-1])}
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if x == y or x + y in free else 1)))
        row = new
    return row[-1]


@F.pandas_udf(T.IntegerType())
def weighted_distance_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The same for long strings, where the expression's array copies cost more than an Arrow round trip; repeats in a batch are computed once."""
    for a, b in batches:
        known: dict[tuple[str, str], int] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in known:
                known[pair] = _dp(*pair)
            out.append(known[pair])
        yield pd.Series(out, dtype="Int32")


def within(a: Column, b: Column, k: int) -> Column:
    """Weighted distance of at most ``k``: built-in bounds decide most pairs, the exact distance the rest."""
    low = F.levenshtein(canon(a), canon(b), k) >= 0
    high = F.levenshtein(a, b, k) >= 0
    return F.when(F.abs(F.length(a) - F.length(b)) > k, False).when(~low, False).when(high, True).otherwise(weighted_distance(a, b) <= k)


def dynamic_max_distance(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n <= 8, F.lit(5.0)).otherwise(F.lit(5.0) + F.lit(0.2) * (n - 8))


def match_probability(distance: Column, most: Column) -> Column:
    d = distance.cast("double")
    return F.when(d.isNull() | (d > most), F.lit(0.0)).otherwise((most - d) / most)


def names_score(a: Column, b: Column, normalized: bool = False) -> Column:
    """Match probability in [0, 1] of two names; null counts as empty."""
    x, y = (F.coalesce(c if normalized else normalize(c), F.lit("")) for c in (a, b))
    return match_probability(weighted_distance(x, y), dynamic_max_distance(x, y))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def convert_age(x: Column) -> Column:
    """Number of an age text, 0 where it is none, null where it is null."""
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(F.trim(x.cast("string")).try_cast("double"), F.lit(0.0)))


def sanitize_age(x: Column) -> Column:
    return F.nullif(x.cast("string").try_cast("double"), F.lit(0.0))


def safe_int(x: Column) -> Column:
    return F.when(F.trim(x).rlike(r"^\d+$"), F.trim(x).try_cast("int"))


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def sanitize_reference(x: Column) -> Column:
    return normalize_particles(blank_to_null(x))


def normalize_field(x: Column) -> Column:
    return F.lower(F.trim(x))


def race_list(x: Column) -> Column:
    """Comma-separated races as a list without blanks, dots and brackets."""
    parts = F.transform(F.split(x, ","), lambda p: F.trim(F.translate(F.rtrim(F.trim(p), F.lit(".")), "[]", "")))
    return F.filter(parts, lambda p: p != "")


def plain_list(x: Column) -> Column:
    """Each comma, white space and bracket as a blank."""
    return F.regexp_replace(x, r"[,\s\[\]]", " ")


def join_races(columns: list[Column]) -> Column:
    """Non-null races, cleaned and joined by a comma."""
    return F.concat_ws(", ", *[plain_list(F.trim(c)) for c in columns])


def strip_brackets(x: Column) -> Column:
    return F.translate(x, "[]", "")


def outer_brackets(x: Column) -> Column:
    """Removes one pair of brackets that encloses the whole text."""
    return F.regexp_replace(x, r"(?s)^\[(.*)\]$", "$1")


def outer_brackets_json(document: Column) -> Column:
    """:func:`outer_brackets` of every text value of a JSON document, at any depth; keys stay."""
    value = r'(?<=[:,\[])(\s*)"\[((?:[^"\\\n]|\\(?!n).)*)\]"(?=\s*[,}\]])'
    return F.regexp_replace(document, value, '$1"$2"')


def space_commas(x: Column) -> Column:
    return F.replace(F.rtrim(x, F.lit(",")), F.lit(","), F.lit(", "))


def first_truthy(*columns: Column) -> Column:
    """The first value that is neither null, empty text nor zero."""
    return F.coalesce(*[F.when((c.cast("string") != "") & (c.cast("string") != "0") & (c.cast("string") != "0.0"), c) for c in columns])


def pick_score(match_type: Column, direct: Column, mother: Column, father: Column) -> Column:
    """The score that the match type names, to two digits, else null."""
    return F.when(match_type == "direct", F.bround(direct, 2)).when(match_type == "mother", F.bround(mother, 2)).when(match_type == "father", F.bround(father, 2))
