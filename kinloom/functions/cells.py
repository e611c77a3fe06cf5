"""Multi-value cells and evaluation scores as Column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_string(x: Column) -> Column:
    """Trimmed, lower case, blanks collapsed, without a trailing ``co.`` or ``county``; null and ``nan`` are empty."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    s = F.regexp_replace(F.lower(F.trim(s)), r"\s+", " ")
    s = F.regexp_replace(s, r" (?:co\.|county)$", "")
    return F.when(F.lower(F.trim(F.coalesce(x.cast("string"), F.lit("")))) == "nan", "").otherwise(s)


def normalize_grant_number(x: Column) -> Column:
    return F.ltrim(F.trim(x.cast("string")), F.lit("#"))


def extract_values(x: Column) -> Column:
    """Distinct normalised values of a cell: ``[a, b]``, ``['a']``, ``a, b`` or a single value; commas inside numbers split too."""
    t = F.trim(F.coalesce(x.cast("string"), F.lit("")))
    listed = t.rlike(r"(?s)^\[.*\]$")
    body = F.regexp_replace(t, r"(?s)^\[(.*)\]$", "$1")
    quoted = F.when(listed, F.from_json(F.replace(t, F.lit("'"), F.lit('"')), "array<string>"))
    parts = F.coalesce(quoted, F.split(F.when(listed, body).otherwise(t), ","))
    clean = F.transform(parts, lambda p: normalize_string(F.trim(F.trim(p), F.lit("'\""))))
    return F.when(F.lower(t) == "nan", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(clean, lambda p: p.isNotNull() & (p != ""))))


def compare_sets(gold: Column, predicted: Column) -> Column:
    """struct(tp, fp, fn) of exact membership."""
    return F.struct(
        F.size(F.array_intersect(gold, predicted)).cast("long").alias("tp"),
        F.size(F.array_except(predicted, gold)).cast("long").alias("fp"),
        F.size(F.array_except(gold, predicted)).cast("long").alias("fn"),
    )


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    known: dict[tuple[str, str], float] = {}
    for p in zip(a, b, strict=True):
        if p not in known:
            known[p] = difflib.SequenceMatcher(None, p[0] or "", p[1] or "").ratio()
    return pd.Series([known[p] for p in zip(a, b, strict=True)])


def may_reach(a: Column, b: Column, least: float) -> Column:
    """Whether lengths and letters allow a :func:`similarity_ratio` of ``least``: matching letters are at most those of the shorter text, and at most those of letters that both have."""
    total = F.length(a) + F.length(b)
    shared = lambda x, y: F.length(x) - F.length(F.call_function("translate", x, y, F.lit("")))
    most = F.least(F.length(a), F.length(b), shared(a, b), shared(b, a))
    return F.when(total == 0, F.lit(True)).otherwise(F.lit(2.0) * most >= F.lit(least) * total)


def count_substring_matches(generated: Column, golden: Column) -> Column:
    """Comma items of ``generated`` that occur in the whole golden text; null counts nothing, an empty item always occurs."""
    return F.when(generated.isNull() | golden.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(generated, ","), lambda g: F.contains(golden, F.trim(g))))).cast("long")


def comma_count(x: Column) -> Column:
    return F.when(x.isNull(), 0).otherwise(F.size(F.split(x, ","))).cast("long")


def match_percentage(matches: Column, generated: Column) -> Column:
    n = comma_count(generated)
    return F.when((n == 0) | (matches == 0), F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * matches / n, 2))


def guarded(top: Column, bottom: Column) -> Column:
    """Ratio, 0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(top.cast("double"), F.nullif(bottom.cast("double"), F.lit(0.0))), F.lit(0.0))


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " "))).cast("long")
