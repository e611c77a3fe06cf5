"""Every query of the library proper against its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from kinloom.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the generated tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in res.fetchall())
    assert got == want


def test_results_do_not_depend_on_partitions(spark):
    one = sorted(map(tuple, QUERIES["linkage_merged"](spark, str(DATA)).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, QUERIES["linkage_merged"](spark, str(DATA)).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trees_with_ages_of_any_size(spark, tmp_path):
    """Ages that are zero with a sign, or so large that Spark writes an exponent or its integers end."""
    con = duckdb.connect()
    for t in ("region", "nation", "customer"):
        balance = "CASE c_custkey % 9 WHEN 0 THEN -0.0::DOUBLE WHEN 1 THEN 1e7 WHEN 2 THEN -123456789.25 WHEN 3 THEN 9e15 + 1 WHEN 4 THEN 3e18 WHEN 5 THEN 1.5e16 WHEN 6 THEN -0.25 WHEN 7 THEN 0.0 ELSE c_acctbal END"
        own = f"* REPLACE ({balance} AS c_acctbal)" if t == "customer" else "*"
        con.execute(f"COPY (SELECT {own} FROM '{DATA}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    for name in ("nested_trees", "tree_age_filter", "tree_statistics", "trees_source"):
        want = con.execute(ORACLES[name])
        cols = [d[0] for d in want.description]
        assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(tmp_path)).select(*cols).collect()) == sorted(map(repr, want.fetchall())), name
