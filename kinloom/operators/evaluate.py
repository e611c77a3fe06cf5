"""Extraction quality: comparisons with a golden set, confusion counts, ensembles, frequencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import comma_count, compare_sets, count_substring_matches, extract_values, guarded, match_percentage, may_reach, similarity_ratio
from ..session import settle


def compare_names(golden: DataFrame, predicted: DataFrame, key: str, column: str, model: str) -> DataFrame:
    """Inner join on the key; counts of golden, generated and matching names. A key that repeats multiplies."""
    g = golden.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("golden"))
    p = predicted.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("generated"))
    out = g.join(p, "key").withColumn("matches", count_substring_matches(F.col("generated"), F.col("golden")))
    return out.select(
        "key", "golden", "generated", F.lit(model).alias("model"), "matches", comma_count(F.col("golden")).alias("n_golden"), comma_count(F.col("generated")).alias("n_generated"),
        match_percentage(F.col("matches"), F.col("generated")).alias("percentage"),
    )


def row_confusion(compared: DataFrame) -> DataFrame:
    """``tp``, ``fp``, ``fn`` of rows from :func:`compare_names`."""
    tp = F.col("matches")
    return compared.withColumns({"tp": tp, "fp": F.col("n_generated") - tp, "fn": F.greatest(F.lit(0), F.col("n_golden") - tp).cast("long")})


def confusion(rows: DataFrame, model: str = "model") -> DataFrame:
    """Sums for each model and a row ``Overall``; tn is what golden and generated names leave; ratios come from the sums."""
    sums = rows.rollup(model).agg(
        F.grouping(model).alias("__all"), *[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "n_generated", "n_golden")]
    )
    tn = F.col("n_generated") + F.col("n_golden") - (F.col("tp") + F.col("fp") + F.col("fn"))
    name = F.when(F.col("__all") == 1, "Overall").otherwise(F.col(model))
    return sums.select(
        name.alias("model"), "tp", "fp", "fn", tn.alias("tn"), guarded(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), guarded(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        F.coalesce(F.round(guarded(100 * F.col("tp"), F.col("n_generated")), 2), F.lit(0.0)).alias("accuracy"),
    )


def metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = guarded(tp, tp + fp), guarded(tp, tp + fn)
    return {"accuracy": guarded(tp, tp + fp + fn), "precision": precision, "recall": recall, "f1": guarded(2 * precision * recall, precision + recall)}


def _cells(golden: DataFrame, predicted: DataFrame, key: str, columns: Sequence[str], fuzzy: float | None) -> DataFrame:
    g = golden.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").cast("string").alias(f"g_{k}") for k, c in enumerate(columns)])
    p = predicted.select(F.col(f"`{key}`").alias("key"), *[F.col(f"`{c}`").cast("string").alias(f"p_{k}") for k, c in enumerate(columns) if c in predicted.columns])
    joined = g.join(p, "key").withColumn("row", F.monotonically_increasing_id())
    side = lambda k: F.col(f"p_{k}") if f"p_{k}" in joined.columns else F.lit("")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"g_{k}").alias("g"), side(k).alias("p")) for k, c in enumerate(columns)]))
    rows = joined.select("key", "row", cells.alias("c")).select("key", "row", "c.column", extract_values(F.col("c.g")).alias("g"), extract_values(F.col("c.p")).alias("p"))
    if fuzzy is None:
        return rows.withColumn("h", compare_sets(F.col("g"), F.col("p"))).select("key", "row", "column", "h.*", F.size("g").cast("long").alias("n"))
    # Written once: the rows are joined on their numbers, which must not change, and used three times.
    return fuzzy_hits(settle(rows, "cells"), ("row", "column"), fuzzy).select("key", "row", "column", "tp", "fp", "fn", F.size("g").cast("long").alias("n"))


def evaluate_columns(golden: DataFrame, predicted: DataFrame, key: str, columns: Sequence[str], fuzzy: float | None = None, digits: int | None = 4) -> DataFrame:
    """tp, fp, fn, accuracy, precision, recall, f1 of each column over joined keys."""
    sums = _cells(golden, predicted, key, columns, fuzzy).groupBy("column").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    shown = {k: (F.round(v, digits) if digits is not None else v) for k, v in metrics(F.col("tp"), F.col("fp"), F.col("fn")).items()}
    return sums.select("column", "tp", "fp", "fn", *[v.alias(k) for k, v in shown.items()])


def perfect_matches(golden: DataFrame, predicted: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``key`` and ``perfect``: whether every column is matched in full; null where no column is compared."""
    if not columns:
        return golden.join(predicted, key).select(F.col(f"`{key}`").alias("key"), F.lit(None).cast("boolean").alias("perfect"))
    return _cells(golden, predicted, key, columns, None).groupBy("key", "row").agg(F.bool_and((F.col("fp") == 0) & (F.col("fn") == 0) & (F.col("tp") == F.col("n"))).alias("perfect")).select("key", "perfect")


def name_totals(rows: DataFrame, columns: Sequence[str], match: str = "Match") -> DataFrame:
    """One row: comma-separated names in each of the columns (null: none, a column that is absent: 0), and ``correct``, the sum of ``match`` (0 where it is absent)."""
    words = [F.coalesce(F.sum(comma_count(F.col(f"`{c}`"))), F.lit(0)).cast("long").alias(c) if c in rows.columns else F.lit(0).cast("long").alias(c) for c in columns]
    correct = F.coalesce(F.sum(F.col(f"`{match}`").cast("long")), F.lit(0)) if match in rows.columns else F.lit(0).cast("long")
    return rows.agg(F.count(F.lit(1)).alias("rows"), *words, correct.alias("correct"))


def fuzzy_hits(rows: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """``keys``, ``tp``, ``fp``, ``fn`` of value lists ``g`` and ``p`` by similarity.

    Exact matches first; each golden value left takes its best predicted value of a ratio of ``least`` or more; predicted values may serve again. Values left are paired inside their row; what lengths and shared letters
    can rule out goes before any text is compared, and each two texts are compared once, however often they meet.
    """
    rows = rows.withColumns({"both": F.array_intersect("g", "p"), "only_g": F.array_except("g", "p"), "only_p": F.array_except("p", "g")})
    pairs = rows.select(*keys, "only_p", F.explode("only_g").alias("x")).select(*keys, "x", F.explode("only_p").alias("y")).where(may_reach(F.col("x"), F.col("y"), least))
    texts = pairs.select("x", "y").distinct().withColumn("ratio", similarity_ratio("x", "y")).where(F.col("ratio") >= least)
    best = pairs.join(texts, ["x", "y"]).groupBy(*keys, "x").agg(F.max(F.struct("ratio", "y")).alias("b"))
    found = best.groupBy(*keys).agg(F.count(F.lit(1)).alias("more"), F.count_distinct("b.y").alias("used"))
    tp = F.size("both") + F.coalesce("more", F.lit(0))
    out = rows.join(found, list(keys), "left").withColumns({"tp": tp.cast("long"), "fp": F.size("only_p") - F.coalesce("used", F.lit(0)), "fn": F.size("only_g") - F.coalesce("more", F.lit(0))})
    return out.drop("both", "only_g", "only_p", "more", "used")


def coverage(golden: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Numbers of distinct keys on one side only and on both."""
    g, p = golden.select(key).distinct(), predicted.select(key).distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(g.join(p, key, "left_anti"), "only_golden").crossJoin(n(p.join(g, key, "left_anti"), "only_predicted")).crossJoin(n(g.join(p, key, "left_semi"), "common"))


def positional(golden: DataFrame, predicted: DataFrame, ordinal: str, column: str) -> DataFrame:
    """Precision, recall and f1 of i-th against i-th value, over the shorter list; unequal values count on both sides, null equals nothing."""
    g = golden.select(F.col(ordinal).alias("i"), F.col(column).alias("g"))
    p = predicted.select(F.col(ordinal).alias("i"), F.col(column).alias("p"))
    same = F.coalesce(F.col("g") == F.col("p"), F.lit(False))
    sums = g.join(p, "i").agg(F.count_if(same).alias("tp"), F.count_if(~same).alias("fp"), F.count_if(~same).alias("fn"))
    return sums.select("tp", "fp", "fn", *[v.alias(k) for k, v in metrics(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def ensemble(models: Sequence[DataFrame], keys: Sequence[str], column: str) -> DataFrame:
    """Inner join of the models on the keys; ``ensemble``: the union of their comma lists, cleaned of brackets and quotes, sorted. Items are told apart before cleaning."""
    out = None
    for k, m in enumerate(models):
        m = m.select(*keys, F.col(f"`{column}`").alias(f"__{k}"))
        out = m if out is None else out.join(m, list(keys))
    parts = [F.filter(F.split(F.coalesce(F.col(f"__{k}"), F.lit("")), ","), lambda x: x != "") for k in range(len(models))]
    union = parts[0]
    for p in parts[1:]:
        union = F.array_union(union, p)
    clean = F.filter(F.transform(F.array_distinct(union), lambda x: F.trim(F.translate(x, "[]'\"", ""))), lambda x: x != "")
    return out.select(*keys, F.array_join(F.array_sort(clean), ", ").alias("ensemble"))


def name_frequency(df: DataFrame, column: str) -> DataFrame:
    """``name`` and ``frequency`` of comma-separated names."""
    names = df.select(F.explode(F.split(column, ",")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''")
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("frequency"))


def top(frequency: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent, ties by name."""
    return frequency.orderBy(F.desc("frequency"), "name").limit(n)


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows in a random order that the seed fixes for given partitions."""
    return df.orderBy(F.rand(seed)).limit(n)


def model_means(df: DataFrame, model: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(model).agg(*[F.round(F.avg(c), 3).alias(c) for c in columns])


def rank_by(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
