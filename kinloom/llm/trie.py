"""Prefix trie of conversations: what a cache of shared prefixes would save.

A turn stands as the SHA-256 of its role and text, a prefix as the chained digest of its turns (128 bits), so texts are read once and never shuffled. One sorted
pass over each conversation's turns chains them, holding one state; equal prefixes then meet in a partial aggregate, so a thousand copies of a conversation are
one row for each turn before the trie is built.

Nodes are dealt by the digest of their first turn, many first-turn subtries to a bucket. Inside ``applyInPandas`` a bucket's nodes become dictionary tries with pointers to
children, and an iterative postorder sums the subtrees. A first-turn subtrie of more nodes than a few mean buckets (``LIMIT`` at most) is dealt again by its next turn, and so on until all parts fit; where
all go on alike, the turns up to the next fork go in one step. What is above the forks, chains that lead to a node with known children, is summed afterwards by windows, from the last step to the
first. So the number of steps is that of nested forks with more nodes than that below, whatever the number of turns.

The list of ids that end at a node is hashed as a stream of sorted blocks of at most ``BLOCK`` ids; no task holds a list.

Defined cases: a null role or text counts as empty. Rows without conv_id belong to no conversation and are left out. A null turn stands first; turns of equal number stand by role, then by digest, null role
and text as empty. Repeated rows are turns like others. A conversation may be turnless once rebuilt; it ends at the root. An empty table has no node, not even the root. Empty and very long
texts are digested by the JVM. Extra columns, whatever their names, are not read; ``conv_id`` and ``turn`` may be any integer type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SQL_CRC, settle, sql_crc

#: Nodes of a subtrie that one group builds at most; LEAST and fewer are never worth a step, and between them it is SHARE mean buckets.
LIMIT, LEAST, SHARE = 100_000, 1000, 4
#: Nodes that make up a bucket of small subtries.
BUCKET = 50_000
#: Ids hashed from one row.
BLOCK = 4096
WIDTH, HEADS = 5, 9
ROOT = b""
_DIGEST = 16


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (1, 2, …), ``digest`` of role and text, ``bytes`` of the text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), text("role").alias("role"), F.unhex(F.sha2(key.cast("binary"), 256)).alias("digest"), F.octet_length(text("text")).cast("long").alias("bytes")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("place"), "digest", "bytes")


def head_length(conv_id: Column, heads: int = HEADS) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % heads


def rebuilt(turns: DataFrame, width: int = WIDTH, heads: int = HEADS) -> DataFrame:
    """Conversations whose first h turns are those of conversation c - c % width and whose other turns are their own after the first h: ``conv_id``, ``part``, ``place``, ``digest``, ``bytes``."""
    donor = F.col("conv_id") - F.col("conv_id") % width
    ids = turns.select("conv_id").distinct().select("conv_id", donor.alias("donor"), head_length(F.col("conv_id"), heads).alias("h"))
    lent = turns.where((F.col("conv_id") % width == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "donor")
    head = ids.join(lent, "donor").where("place <= h").select("conv_id", F.lit(0).alias("part"), "place", "digest", "bytes")
    tail = turns.where(F.col("place") > head_length(F.col("conv_id"), heads)).select("conv_id", F.lit(1).alias("part"), "place", "digest", "bytes")
    return head.unionByName(tail)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to (conv_id, depth, node, parent, top, bytes, last); the last row seen waits for the next one to tell whether it ends its conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("top", pa.binary()), ("bytes", pa.int64()), ("last", pa.bool_())])
    held = None
    for batch in batches:
        out = []
        for conv, digest, size in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "digest", "bytes")), strict=True):
            if held is not None:
                out.append((*held, held[0] != conv))
            depth, parent, top = (held[1], held[2], held[4]) if held is not None and held[0] == conv else (0, ROOT, None)
            node = hashlib.sha256(parent + digest).digest()[:_DIGEST]
            held = (conv, depth + 1, node, parent, top or node, size)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*held, True), schema.types, strict=True)], schema=schema)


def paths(turns: DataFrame) -> DataFrame:
    """Every conversation's nodes: one row for each of its prefixes."""
    placed = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "digest", "bytes")
    return placed.mapInArrow(_chain, "conv_id long, depth long, node binary, parent binary, top binary, bytes long, last boolean")


def _stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha = None, hashlib.sha256()
    for batch in batches:
        nodes, digests = [], []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == now:
                sha.update(b",")
            else:
                if now is not None:
                    nodes.append(now)
                    digests.append(sha.hexdigest())
                now, sha = node, hashlib.sha256()
            sha.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([sha.hexdigest()])], names=["node", "ends_sha256"])


def ends_hash(ends: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of its ids, ascending and joined by commas; ends: node, conv_id (each once)."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ends.groupBy("node", F.floor(F.col("conv_id") / BLOCK).alias("block")).agg(ids.alias("ids"))
    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(_stream_hash, "node binary, ends_sha256 string")


_SUMS = "node binary, parent binary, depth long, conv_id long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def _build(part: pd.DataFrame) -> pd.DataFrame:
    """The tries of one bucket: children by pointers, subtree sums by a postorder without recursion."""
    place = {n: k for k, n in enumerate(part["node"])}
    up = [place.get(p, -1) for p in part["parent"]]
    children: dict[int, list[int]] = {}
    for k, p in enumerate(up):
        children.setdefault(p, []).append(k)
    own = ((part["n_convs"] - 1) * part["bytes"]).tolist()
    leaves, saved = [0] * len(own), own[:]
    for top in children.get(-1, ()):
        stack, order = [top], []
        while stack:
            x = stack.pop()
            order.append(x)
            stack.extend(children.get(x, ()))
        for x in reversed(order):  # children before parents
            below = children.get(x, ())
            leaves[x] = sum(leaves[y] for y in below) or 1
            saved[x] += sum(saved[y] for y in below)
    conv = part["conv_id"].tolist()
    out = part[["node", "parent", "depth", "conv_id", "n_convs"]].copy()
    out["parent_conv_id"] = pd.array([conv[p] if p >= 0 else None for p in up], dtype="Int64")
    out["n_children"] = [len(children.get(k, ())) for k in range(len(up))]
    out["n_leaves"], out["saved_tokens"] = leaves, saved
    return out


def _split(live: DataFrame, path: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The groups that fit, the chains from the tops of the others to their first fork (``fork``: its depth), and what is below the forks, dealt by the next turn; None if all fit."""
    sizes = live.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if not (sizes.agg(F.max("n")).first()[0] or 0) > limit:
        return None
    large = settle(sizes.where(F.col("n") > limit).select("key"), "large")
    small = settle(live.join(large, "key", "left_anti"), "small")
    big = live.join(large, "key")
    kids = big.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    forks = big.join(kids, "node", "left").groupBy("key").agg(F.coalesce(F.min(F.when(F.col("kids") > 1, F.col("depth"))), F.max("depth")).alias("fork"))
    big = settle(big.join(settle(forks, "forks"), "key"), "big")
    rest = big.where("depth > fork").withColumn("next", F.col("fork") + 1).drop("key", "fork")
    step = path.select(F.col("conv_id"), F.col("depth").alias("next"), F.col("node").alias("key"))
    return small, big.where("depth <= fork"), settle(rest.join(step, ["conv_id", "next"]).drop("next"), "split")


def _chains(chain: DataFrame, below: DataFrame) -> DataFrame:
    """Sums of the chains whose forks' children are in ``below``."""
    fork = chain.where("depth = fork").select(F.col("node").alias("at"), "key")
    sums = fork.join(below.select(F.col("parent").alias("at"), "n_leaves", "saved_tokens"), "at", "left")
    sums = sums.groupBy("key").agg(F.count("n_leaves").alias("kids"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("under"))
    down = Window.partitionBy("key").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    out = chain.join(sums, "key").withColumns(
        {
            "parent_conv_id": F.lag("conv_id").over(Window.partitionBy("key").orderBy("depth")),
            "n_children": F.when(F.col("depth") == F.col("fork"), F.col("kids")).otherwise(F.lit(1)),
            "saved_tokens": F.sum((F.col("n_convs") - 1) * F.col("bytes")).over(down) + F.col("under"),
        }
    )
    return out.select("node", "parent", "depth", "conv_id", "n_convs", "parent_conv_id", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def summed(nodes: DataFrame, path: DataFrame, limit: int | None = None) -> DataFrame:
    """Subtree sums of all nodes (node, parent, top, depth, bytes, conv_id, n_convs); the parent's id is null for nodes of depth 1."""
    total = nodes.count()
    buckets = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)
    limit = max(LEAST, min(LIMIT, SHARE * total // buckets)) if limit is None else limit
    live, fitting, chains = nodes.withColumnRenamed("top", "key"), [], []
    while (step := _split(live, path, limit)) is not None:
        small, chain, live = step
        fitting.append(small)
        chains.append(chain)
    whole = live
    for small in fitting:
        whole = whole.unionByName(small)
    out = whole.withColumn("bucket", F.pmod(F.hash("key"), F.lit(buckets))).drop("key").groupBy("bucket").applyInPandas(lambda part: _build(part), _SUMS)
    if not chains:
        return out
    out = settle(out, "tries")
    for chain in reversed(chains):
        out = out.unionByName(settle(_chains(chain, out), "chains"))
    forks = chains[0].where("depth = fork").select(F.col("node").alias("parent"), F.col("conv_id").alias("fork_id"))
    for chain in chains[1:]:
        forks = forks.unionByName(chain.where("depth = fork").select(F.col("node").alias("parent"), F.col("conv_id").alias("fork_id")))
    return out.join(forks, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "fork_id")).drop("fork_id")


def prefix_trie(turns: DataFrame, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """One row for each node of the trie over sequences of turns (conv_id, part, place, digest, bytes); ``ids`` has the conv_id of every conversation once, the turnless ones too.

    Returns ``conv_id`` (the node's smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    path = settle(paths(turns), "paths")
    ids = settle(ids, "ids")
    nodes = settle(path.groupBy("node", "parent", "top", "depth", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "nodes")
    ended = path.where("last").select("node", "conv_id")
    ends = ends_hash(ended.unionByName(ids.join(ended, "conv_id", "left_anti").select(F.lit(ROOT).alias("node"), "conv_id")))
    sums = settle(summed(nodes, path, limit), "sums")
    least, n = ids.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    top = sums.where("depth = 1").agg(F.count(F.lit(1)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    root = top.where(F.lit(n > 0)).select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(least).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("n_convs"),
        F.lit(None).cast("long").alias("parent_conv_id"), "n_children", "n_leaves", "saved_tokens",
    )
    rows = sums.withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long")).otherwise(F.col("parent_conv_id"))).unionByName(root)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.join(ends, "node", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, width: int = WIDTH, heads: int = HEADS, limit: int | None = None) -> DataFrame:
    """:func:`prefix_trie` of the rebuilt conversations."""
    turns = settle(turns_of(conversations), "turns")
    return prefix_trie(rebuilt(turns, width, heads), turns.select("conv_id").distinct(), limit)


def oracle(width: int = WIDTH, heads: int = HEADS) -> str:
    """:func:`conversation_trie` over ``conversations`` in DuckDB SQL: prefixes as joined digests, subtree sums by handing each node to all its ancestors."""
    return f"""
WITH {SQL_CRC},
v AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, turn, role, sha256(strlen(role)::VARCHAR || ':' || role || text) AS dig, strlen(text) AS bytes FROM v),
t AS (SELECT conv_id, dig, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, dig) AS place FROM s),
i AS (SELECT conv_id, conv_id - conv_id % {width} AS donor, {sql_crc("conv_id::VARCHAR")} % {heads} AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT i.conv_id, 0 AS part, place, dig, bytes FROM i JOIN t ON t.conv_id = i.donor WHERE place <= h UNION ALL SELECT t.conv_id, 1, place, dig, bytes FROM i JOIN t ON t.conv_id = i.conv_id WHERE place > h),
l AS (SELECT conv_id, list(dig ORDER BY part, place) AS l, list(bytes ORDER BY part, place) AS b FROM r GROUP BY conv_id),
p AS (SELECT i.conv_id, coalesce(l, []) AS l, coalesce(b, []) AS b, unnest(range(coalesce(len(l), 0) + 1)) AS depth FROM i LEFT JOIN l ON i.conv_id = l.conv_id),
k AS (SELECT conv_id, depth, l[1:depth] AS l, array_to_string(l[1:depth], ',') AS key, array_to_string(l[1:depth - 1], ',') AS up, coalesce(b[depth], 0) AS bytes, depth = len(l) AS last FROM p),
n AS (SELECT key, any_value(l) AS l, any_value(up) AS up, depth, min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * max(bytes) AS own, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM k GROUP BY key, depth),
c AS (SELECT up, count(*) AS kids FROM n WHERE depth > 0 GROUP BY up),
a AS (SELECT n.*, coalesce(kids, 0) AS kids, unnest(range(n.depth + 1)) AS above FROM n LEFT JOIN c ON c.up = n.key),
m AS (SELECT array_to_string(l[1:above], ',') AS key, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves, sum(own)::BIGINT AS saved FROM a GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(c.kids, 0) AS n_children, m.leaves AS n_leaves, m.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN m ON m.key = n.key LEFT JOIN c ON c.up = n.key LEFT JOIN n u ON n.depth > 0 AND u.key = n.up"""
