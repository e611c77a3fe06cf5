"""Importance resampling against brute force: features, gains, noise, exact selection and ranks."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.llm import importance, textkernel

SCHEMA = "doc_id long, text string, rank string, score int, `select` int"


def runs(text, size):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return [b" ".join(w[i : i + k]) for k in range(1, size + 1) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target, size, buckets, least, percent):
    s, t = (Counter(zlib.crc32(f) % buckets for x in texts for f in runs(x, size)[0]) for texts in ([r[1] for r in docs], target))
    a, b = sum(s.values()), sum(t.values())
    out = []
    for d, text, *_ in docs:
        f, n = runs(text, size)
        w = sum(math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in (zlib.crc32(x) % buckets for x in f)) // max(1, len(f))
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "beta", "GAMMA", "délta", "漢字", "e1", "x" * 70, "y" * 300, "zeta"])
    out = [(k, r.choice([" ", ", ", "\n", "-"]).join(word() for _ in range(r.randint(0, 40))), "r", 1, 2) for k in range(150)]
    out += [(200, None, "r", 1, 2), (201, "", "r", 1, 2), (202, " .,\t", "r", 1, 2), (None, "alpha " * 30, "r", 1, 2), (None, "alpha " * 30, "r", 1, 2)]
    out += [(300, "beta " * 25, "r", 1, 2)] * 40 + [(300, "beta " * 26, "r", 1, 2)] * 3
    return out


TARGET = ["alpha beta", None, "", "délta 漢字 alpha", "Beta, beta."]


@pytest.mark.parametrize(("size", "least", "percent"), [(1, 20, 10), (1, 0, 50), (3, 5, 33), (2, 1, 100), (1, 1000, 10)])
def test_against_brute_force(spark, size, least, percent):
    docs = rows(size)
    got = importance.resample(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame([(t,) for t in TARGET], "text string"), size=size, buckets=97, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, TARGET, size, 97, least, percent)


def test_slices_change_no_feature(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice(["ab", "c", "déf", "g" * 90]) for _ in range(r.randint(0, 60))) for _ in range(30)]
    data, off = textkernel.buffers(pa.array(texts))
    for limit in (64, 7):
        monkeypatch.setattr(textkernel, "SLICE_BYTES", limit)
        for size in (1, 2, 4):
            got = Counter((int(t), int(b)) for text, bucket in importance.feature_buckets(data, off, size, 1000) for t, b in zip(text, bucket, strict=True))
            assert got == Counter((k, zlib.crc32(f) % 1000) for k, t in enumerate(texts) for f in runs(t, size)[0])


def test_radix_selection_finds_every_cut(spark):
    r = random.Random(5)
    values = [(r.choice([-(2**63), -5, 0, 7, 2**40, 2**63 - 1, r.randint(-9000, 9000)]), r.randint(-3, 3), k) for k in range(400)]
    df = spark.createDataFrame(values, "a long, b long, c long").cache()
    for k in (0, 1, 7, 57, 199, 399, 400, 500):
        got = sorted(map(tuple, df.where(importance.first_k(df, [F.col("a"), F.col("b"), F.col("c")], k)).collect()))
        assert got == sorted(values)[:k]


def test_ranks_are_places_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), "id").repartition(7)
    got = importance.ranked(df, [F.col("v"), F.col("id")]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 1001)) and all(r["rank"] == r["v"] + 1 for r in got)


def test_crc_of_ranges():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    starts = np.array([0, 10, 10, 4000, 100, 5000])
    ends = np.array([0, 10, 74, 5000, 4100, 5000])
    assert [int(x) for x in importance.crc32(data, starts, ends)] == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def test_empty_tables_and_drawn_documents(spark):
    docs, none = spark.createDataFrame(rows(9), SCHEMA), spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert importance.resample(none, target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == docs.count()
    drawn = importance.resampled_documents(docs.withColumn("doc_id", F.col("doc_id").cast("int")), target, least_words=1, percent=50)
    assert drawn.columns == ["doc_id", "text", "score", "select", "rank"] and drawn.count() > 50


def test_a_text_of_megabytes(spark):
    text = "alpha beta gamma " * 200_000
    df = spark.createDataFrame([(1, text), (2, "x" * 3_000_000), (3, "alpha")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_features"] for r in importance.resample(df, df, size=2).collect()}
    assert got == {1: 600_000 * 2 - 1, 2: 1, 3: 1}
