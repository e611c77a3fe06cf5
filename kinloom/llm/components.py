"""Connected components by alternating large-star and small-star passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(r)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that an edge touches.

    ``edges`` has two id columns ``u`` and ``v``; direction, repeats and loops do not matter,
    and rows with a null end are ignored. Returns ``node``, ``root``, the root itself included.
    Each pass keeps one edge for each node at most after the small star, so its rows never exceed the
    edges given, and passes go as the logarithm of the longest chain. Empty in, empty out.
    """
    now = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = settle(_small_star(_large_star(now)), "stars")
        was, seen = seen, _digest(now)
        if was == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
