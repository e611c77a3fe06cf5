"""Datasets that fail alone, and taggers whose model sees a text in windows."""

from __future__ import annotations

import gzip
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from kinloom.functions import names as N
from kinloom.operators import extract as X
from kinloom.sources.ingest import Dataset, Ingest


def test_one_bad_dataset_does_not_end_the_rest(spark, tmp_path):
    (tmp_path / "good.tsv").write_text("﻿Name \tAge\nana paz\t7\n\"two\nlines\"\t8\n")
    (tmp_path / "ragged.csv").write_text("name,age\nok,1\nshort\nlong,2,3\nfine,x\n")
    (tmp_path / "broken.csv.gz").write_bytes(b"name,age\nno gzip at all\n")
    half = gzip.compress(b"name,age\n" + b"".join(b"n%d,%d\n" % (k, k) for k in range(50_000)))
    (tmp_path / "cut.csv.gz").write_bytes(half[: len(half) // 2])
    who = {"name": "name", "age": "age"}
    at = lambda name, *more, **kw: Dataset(f"file://{tmp_path}/{name}", who, *more, **kw)
    many = Ingest(spark, {"good": at("good.tsv", "\t", year=1790), "ragged": at("ragged.csv"), "absent": at("absent.csv"), "broken": at("broken.csv.gz"), "cut": at("cut.csv.gz"), "other": Dataset(f"file://{tmp_path}/good.tsv", {"name": "nowhere"}, "\t")})
    assert sorted((r["dataset"], r["name"], r["age"], r["census_year"]) for r in many.all_persons().collect()) == [("good", "ana paz", 7, 1790), ("good", "two\nlines", 8, 1790), ("ragged", "fine", None, None), ("ragged", "ok", 1, None)]
    assert sorted(map(tuple, many.rejected().collect())) == [("ragged", "long,2,3"), ("ragged", "short")]
    errors = {r["dataset"]: r["error"] for r in many.errors().collect()}
    assert sorted(errors) == ["absent", "broken", "cut", "other"] and "nowhere" in errors["other"] and all(errors.values())
    assert many.persons("absent").columns == many.persons("good").columns and many.persons("absent").count() == 0
    # What was read is kept until it is forgotten.
    (tmp_path / "good.tsv").write_text("Name\tAge\nnew\t1\n")
    assert many.persons("good").count() == 2
    many.forget("good")
    assert [r["name"] for r in many.persons("good").collect()] == ["new"]


def word_model():
    word = re.compile("[A-Z][a-z]+")
    return lambda texts: [[(m.start(), m.end(), "W") for m in word.finditer(t)] for t in texts]


@pytest.mark.parametrize(("window", "overlap"), [(60, 20), (25, 24), (1000, 40)])
def test_windows_find_what_one_pass_finds(spark, window, overlap):
    r = random.Random(window)
    texts = ["".join(r.choice(["Ab", "cD", " ", "Efgh ", "é", "\n", "x"]) for _ in range(r.randint(0, 200))) for _ in range(40)] + [None, "", "A" + "b" * 6, "Ab " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    rows = X.tag_spans(df, "t", word_model, f"words {window}", window=window, overlap=overlap, batch=3, pool=17).collect()
    one = word_model()
    for row in rows:
        text = row["t"] or ""
        # Runs of letters longer than half an overlap may be cut.
        want = one([text])[0]
        got = [(x["start"], x["end"], x["label"]) for x in row["spans"]]
        if all(e - s <= overlap // 2 for s, e, _ in want):
            assert got == want
        assert all(text[x["start"] : x["end"]] == x["text"] for x in row["spans"]) and got == sorted(set(got))


def counting_model():
    """Says in its label in which process it lives and how often it was made there."""
    made = os.environ["TAGGER_MADE"] = str(int(os.environ.get("TAGGER_MADE", "0")) + 1)
    largest = [0]

    def tag(texts):
        assert len(texts) <= 4 and max(map(len, texts)) - min(map(len, texts)) <= 400
        largest[0] = max(largest[0], len(texts))
        return [[(0, 1, f"{os.getpid()}:{made}:{largest[0]}")] for _ in texts]

    return tag


def test_a_model_is_loaded_once_a_worker(spark):
    df = spark.range(400).select(F.col("id"), F.repeat(F.lit("x"), (F.col("id") % 300 + 1).cast("int")).alias("t")).repartition(24)
    labels = {x["label"] for r in X.tag_spans(df, "t", counting_model, "counting", window=300, overlap=20, batch=4).collect() for x in r["spans"]}
    again = {x["label"] for r in X.tag_spans(df, "t", counting_model, "counting", window=300, overlap=20, batch=4).collect() for x in r["spans"]}
    assert {x.split(":")[1] for x in labels | again} == {"1"} and len({x.split(":")[0] for x in labels}) <= 8 and any(x.endswith(":4") for x in labels)


def test_spans_route_like_entities(spark):
    text = "made by Gov. Pico to Maria Lopez of San Jose in 1845. Patent for 5 acres issued in 1850 to Pedro Ruiz by Land Commission"
    df = spark.createDataFrame([(text,)], "t string")
    by_spans = X.tag_spans(df, "t", X.rule_model, "rules").withColumn("entities", X.entities_of(F.col("spans"))).drop("spans")
    both = [X.entity_roles(X.route_entities(x, "t")).first() for x in (by_spans, X.tag_entities(df, "t"))]
    assert both[0] == both[1] and both[0]["grantee"] == "Pedro Ruiz"


def far(a, b):
    free = {p for x in N.FREE_PAIRS for p in (x, x[::-1])}
    two = {p: x for p, x in N.DIGRAPHS}
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = [0] if i == j == 0 else []
            if i:
                ways.append(d[i - 1][j] + (a[i - 1] != "h"))
            if j:
                ways.append(d[i][j - 1] + (b[j - 1] != "h"))
            if i and j:
                ways.append(d[i - 1][j - 1] + (a[i - 1] != b[j - 1] and a[i - 1] + b[j - 1] not in free))
            if i > 1 and j and two.get(a[i - 2 : i]) == b[j - 1]:
                ways.append(d[i - 2][j - 1])
            if j > 1 and i and two.get(b[j - 2 : j]) == a[i - 1]:
                ways.append(d[i - 1][j - 2])
            d[i][j] = min(ways)
    return d[-1][-1]


def test_digraphs_and_the_silent_letter(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice(["ph", "j", "ll", "y", "h", "l", "p", "a", "b", "v"]) for _ in range(r.randint(0, 6)))
    rows = [("joseph", "josej"), ("llanos", "yanos"), ("hernan", "ernan"), ("", "hh"), ("phph", "jj"), ("yy", "llll"), (None, "a")] + [(word(), word()) for _ in range(400)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", N.digraph_distance(F.col("a"), F.col("b")).alias("d"), N.weighted_distance(F.col("a"), F.col("b")).alias("w")).collect()
    assert [x["d"] for x in got[:4]] == [0, 0, 0, 0] and got[6]["d"] is None
    assert all(x["d"] == far(x["a"], x["b"]) <= x["w"] for x in got if x["a"] is not None)
