"""Connected components of an edge list in rounds that go as the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle


def _hook_larger(edges: DataFrame) -> DataFrame:
    """Every node hooks its larger neighbours to the least of its neighbourhood (large star)."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _hook_smaller(edges: DataFrame) -> DataFrame:
    """Every node hooks itself and its smaller neighbours to the least of these (small star); afterwards a node has one edge at most for each it had."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    others = edges.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return others.unionByName(least.select("u", F.col("low").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge at most to a smaller one, which has none itself; then that is the least of its component."""
    several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    inner = edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi")
    return several.unionByName(inner).isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest id reachable over the edges ``u``, ``v``, whose direction, repeats and loops do not matter.

    Larger and smaller neighbours hook to the least by turns until all components are stars. Both steps keep each component
    together and never add edges, so a round costs no more than the first; each is written to the shared folder. Edges always run from the larger
    to the smaller id. Nodes without an edge to another are not returned.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _stars(now):
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        now = settle(_hook_smaller(_hook_larger(now)), "hooked")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
