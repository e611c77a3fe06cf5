"""The stages in order, each on its predecessor's result, against what brute force says of the planted cases."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from kinloom.llm import queries as Q

from .test_operators import SCHEMA, brute, prose

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    d = tmp_path_factory.mktemp("tables")
    bench = [(k, prose(r, 30, 3000)) for k in range(3)]
    rows = [(k, prose(r, 60, 2000) + "\nshared footer of the site here\n" + prose(r, 10), "en", f"s{k % 2}", 0, k) for k in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 0, 0), (101, rows[1][1] + " more", "en", "s1", 0, 0), (102, prose(r, 20) + " " + bench[1][1], "en", "s0", 0, 0), (103, "12 34", None, "s1", 0, 0), (104, None, None, None, 0, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def test_stages(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(seen["language_id"]) == {*range(40), 100, 101, 102}
    assert set(seen["line_dedup"]) == set(seen["language_id"]) and all("shared footer" not in t for t in seen["line_dedup"].values())
    groups = brute(seen["line_dedup"].items(), 5, 80, 100)
    assert set(seen["near_dedup"]) == {d for d, (_, root) in groups.items() if d == root} and not {100, 101} & set(seen["near_dedup"])
    assert set(seen["decontamination"]) == set(seen["near_dedup"]) - {102}
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and docs.columns == [c for c in columns if c != "taken"] + ["epoch", "taken", "position"]
    ran = corpus_pipeline.run(spark, folder)
    assert sorted(map(repr, ran.collect())) == sorted(map(repr, docs.collect()))


def test_an_empty_table_stays_empty(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "epoch", "taken", "position"} <= set(out.columns)


@pytest.mark.skipif(not DATA.exists(), reason="the generated tables are not here")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = Q.queries()[name](spark, str(DATA))
    res = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(repr, res.fetchall()))
