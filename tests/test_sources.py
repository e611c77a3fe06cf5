from __future__ import annotations

import json

from pyspark.sql import functions as F

from kinloom.operators import extract as X
from kinloom.sources import documents as D
from kinloom.sources import sinks, tabular


def test_csv_with_mark_line_ends_and_blank_rows(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿Ego_First Name,Ego_ Paternal Last Name,Age ,Race\nJosé ,"de\nla",30,indio\n,,,\nAna,,x,\n', encoding="utf-8")
    df = tabular.drop_blank_rows(tabular.read_csv(spark, str(p)))
    assert df.columns[:4] == ["ego_first name", "ego_paternal last name", "age", "race"] and df.count() == 2
    rows = tabular.to_persons(df, {"name": ["ego_first name", "ego_paternal last name"], "age": "age ", "race": "race", "spouse": [None, None]}, "p", 1781).orderBy("ordinal").collect()
    assert rows[0]["name"] == "José de\nla" and rows[0]["age"] == 30 and rows[1]["age"] is None and rows[1]["spouse"] is None and rows[0]["census_year"] == 1781


def test_catalog_reads_tsv(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("A B\tC\n1\t2\n")
    out = tabular.catalog(spark, {"b_table": str(tmp_path / "b.tsv")})
    assert out["b_table"].select("a b", "c").collect()[0][:] == ("1", "2") and spark.table("b_table").count() == 1


def test_identifiers_match_a_global_window(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.col("id") * 37, F.lit(101)))
    a = {r["id"]: r["n"] for r in tabular.add_identifiers(df, "n", ("k", "id")).collect()}
    b = {r["id"]: r["n"] for r in tabular.add_identifiers(df, "n", ("k", "id"), whole=True).collect()}
    assert a == b and sorted(a.values()) == list(range(1, 1001))


def test_identifiers_of_wide_rows_over_many_ranges(spark):
    """Rows wide beside their keys, more than the sample of the bounds holds: those numbered and those counted are placed by one run, so none is lost or numbered twice."""
    confs = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {c: spark.conf.get(c, None) for c in confs}
    for c, v in confs.items():
        spark.conf.set(c, v)
    try:
        df = spark.range(60000, numPartitions=4).select(F.pmod(F.col("id") * 7919, F.lit(60000)).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
        got = tabular.add_identifiers(df, "n", ("k",)).collect()
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert sorted((r["k"], r["n"]) for r in got) == [(k, k + 1) for k in range(60000)]


def test_text_falls_back_to_latin(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("año".encode())
    (tmp_path / "l.txt").write_bytes("año".encode("latin-1"))
    assert {r["text"] for r in D.read_text(spark, str(tmp_path / "*.txt")).collect()} == {"año"}


def test_records_from_list_and_object(spark, tmp_path):
    rec = {"Grant Name": "A", "Grant Number": "#501", "Persons": "x", "Year": 1840}
    (tmp_path / "l.json").write_text(json.dumps([rec, {"Grant Name": "", "Grant Number": "2"}]))
    (tmp_path / "o.json").write_text(json.dumps({"1": rec}))
    for f in ("l.json", "o.json"):
        rows = D.read_records(spark, str(tmp_path / f)).collect()
        assert len(rows) == 1 and rows[0]["Grant Number"] == "501" and rows[0]["Persons (entities)"] == "x" and rows[0]["Year"] == "1840"


def test_trees(spark, tmp_path):
    tree = [{"name": "a", "age": 50, "children": [{"name": "b", "children": [{"name": "a", "circular_reference": True}]}]}, {"name": "c"}]
    (tmp_path / "t.json").write_text(json.dumps(tree))
    rows = D.read_trees(spark, str(tmp_path / "t.json")).orderBy("node").collect()
    assert [(r["name"], r["depth"], r["root"], r["parent"]) for r in rows] == [("a", 1, 0, None), ("b", 2, 0, 0), ("a", 3, 0, 1), ("c", 1, 3, None)] and rows[2]["circular"]


def test_entries_round_trip(spark, tmp_path):
    g = spark.createDataFrame([("RANCHO UNO", 7, "Yolo Co. In T 5N, R 7W, MDM\nmore")], "name string, number long, description string")
    sinks.write_entries(g, str(tmp_path / "e"))
    back = X.parse_entries(spark.read.text(str(tmp_path / "e"), wholetext=True), "value").collect()
    assert len(back) == 1 and back[0]["name"] == "RANCHO UNO" and back[0]["number"] == 7 and back[0]["county"] == "Yolo" and back[0]["coordinates"] == "In T 5N, R 7W, MDM"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    sinks.write_csv(df, str(tmp_path / "c"), single=True)
    sinks.write_matches(df, str(tmp_path / "p"))
    sinks.write_metrics(df, str(tmp_path / "m"))
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).collect()[0][:] == ("1", "a")
    assert spark.read.csv(str(tmp_path / "m"), header=True).orderBy("Metric").collect()[0][:] == ("n", "1")
    assert spark.read.json(str(tmp_path / "j")).count() == 1 and '"s" : "a"' in sinks.pretty(df).first()[0]
