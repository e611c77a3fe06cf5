"""The conversation trie against a plain one built from whole sequences, at limits that force every kind of split."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int"


def plain(rows, width=5, heads=9):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        full[c] = own.get(c - c % width, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0) + sum(saved[k] for k in kids[s])
    return sorted(
        (min(m), len(s), min(members[s[:-1]]) if s else -1, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()) for s, m in members.items()
    )


def rows_of(seed, n=60):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(3 * n), n):
        hot = r.random() < 0.4
        for t in range(r.randint(1, 14)):
            text = f"turn {t}" if hot and t < 9 and r.random() < 0.95 else r.choice(["ja", "no", "é" * t, "x", None])
            out.append((c, r.choice([None, t]) if r.random() < 0.1 else t, r.choice(["user", "assistant"]) if r.random() < 0.1 else "user", text, "n", 1))
    out += [(1000 + k, t, "user", f"copy {t}", "n", 1) for k in range(40) for t in range(12)]
    out += [(2000, t, None, "y" * t, "n", 1) for t in range(300)]
    return [*out, *out[:9], (None, 1, "user", "lost", "n", 1), (-7, None, None, None, "n", 1), (-7, None, None, None, "n", 1)]


def result(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in map(tuple, df.collect()))


@pytest.mark.parametrize("limit", [None, 20, 3])
def test_against_a_plain_trie(spark, monkeypatch, limit):
    rows = [r for r in rows_of(limit or 1) if r[0] is None or r[0] >= 0]
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA).repartition(6), limit=limit)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert result(got) == plain(rows)


def test_blocks_of_ids_and_batches_of_turns(spark, monkeypatch):
    rows = [(k, t, "user", f"copy {t}", "n", 1) for k in range(0, 60, 5) for t in range(9)]
    monkeypatch.setattr(trie, "BLOCK", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert result(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_turnless_conversations_end_at_the_root(spark):
    # Conversations of one turn whose donor is absent lose it wherever h > 0.
    rows = [(5 * k + 1, 0, "user", "only", "n", 1) for k in range(30)]
    got = result(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and got[0][1] == 0 and got[0][3] == 30
    gone = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 9]
    got = result(trie.conversation_trie(spark.createDataFrame(gone, SCHEMA)))
    assert got == plain(gone) and len(got) == 1 and got[0][4:7] == (0, 1, 0)


def test_empty_table_and_narrow_ids(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [r for r in rows_of(7, 20) if r[0] is not None and r[0] >= 0]
    narrow = spark.createDataFrame(rows, SCHEMA).select(F.col("conv_id").cast("int").alias("conv_id"), F.col("turn").cast("short").alias("turn"), "role", "text", F.lit(1).alias("bytes"), F.lit(1).alias("key"))
    assert result(trie.conversation_trie(narrow)) == plain(rows)


def test_negative_ids_and_a_text_of_megabytes(spark):
    rows = [(-7, 1, "user", "a", "n", 1), (-5, 1, "user", "b", "n", 1), (0, 0, "user", "x" * 3_000_000, "n", 1), (1, 0, "user", "x" * 3_000_000, "n", 1)]
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    # A negative id's remainder has its sign: -7 takes its head from -5.
    assert {r["conv_id"] for r in got if r["depth"] == 0} == {-7} and sum(r["n_convs"] for r in got if r["depth"] == 0) == 4
