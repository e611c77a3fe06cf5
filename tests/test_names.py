from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kinloom.functions import cells as C
from kinloom.functions import names as N


def one(spark, rows, schema, **cols):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*[v.alias(k) for k, v in cols.items()]).collect()]


def dp(a, b):
    free = {p for x in N.FREE_PAIRS for p in (x, x[::-1])}
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (0 if x == y or x + y in free else 1)))
        row = new
    return row[-1]


PAIRS = [("vaca", "baca", 0), ("cesar", "sesar", 0), ("zapata", "capata", 0), ("ibarra", "ybarra", 0), ("gimenez", "jimenez", 0), ("quesada", "cuesada", 0), ("bu", "ub", 2), ("s", "q", 1), ("z", "q", 1), ("b", "u", 1), ("", "abc", 3), ("abc", "", 3), ("", "", 0), ("lopes", "lopezx", 1)]


def test_distance_cases(spark):
    got = one(spark, [(a, b) for a, b, _ in PAIRS], "a string, b string", a=F.col("a"), b=F.col("b"), d=N.weighted_distance(F.col("a"), F.col("b")), u=N.weighted_distance_udf("a", "b"))
    for r, (a, b, d) in zip(got, PAIRS, strict=True):
        assert r["d"] == d == r["u"] == dp(a, b), (a, b)


def test_distance_and_bounds_on_random_pairs(spark):
    r = random.Random(5)
    rows = [tuple("".join(r.choice("bvucszqiygjax") for _ in range(r.randint(0, 9))) for _ in range(2)) for _ in range(600)]
    a, b = F.col("a"), F.col("b")
    got = one(spark, rows, "a string, b string", a=a, b=b, d=N.weighted_distance(a, b), low=F.levenshtein(N.canon(a), N.canon(b)), high=F.levenshtein(a, b), w=N.within(a, b, 2))
    for x in got:
        assert x["d"] == dp(x["a"], x["b"]) and x["low"] <= x["d"] <= x["high"] and x["w"] == (x["d"] <= 2)


def test_null_distance_and_scores(spark):
    got = one(spark, [(None, "a"), ("jose", "josé"), (None, None)], "a string, b string", d=N.weighted_distance(F.col("a"), F.col("b")), s=N.names_score(F.col("a"), F.col("b")))
    assert got[0]["d"] is None and got[1]["s"] == 1.0 and got[2]["s"] == 1.0 and got[0]["s"] == pytest.approx(0.8)


def test_normalize_fast_and_exact_agree(spark):
    rows = [("José Muñoz",), ("ÁÉÍÓÚ Ç",), (None,), ("",), ("ﬁ",)]
    got = one(spark, rows, "a string", f=N.normalize(F.col("a")), e=N.normalize(F.col("a"), exact=True), p=N.normalize_particles(F.col("a")))
    assert [g["f"] for g in got[:4]] == [g["e"] for g in got[:4]] == ["jose munoz", "aeiou c", None, ""]
    assert got[4]["e"] == "fi"


def test_particles(spark):
    got = one(spark, [("Juan de la Cruz",), ("Mary Sol",), ("De  Leon",)], "a string", p=N.normalize_particles(F.col("a")), w=N.normalize_particles(F.col("a"), whole_words=True))
    assert [g["p"] for g in got] == ["juan la cruz", "marsol", "de leon"] and [g["w"] for g in got] == ["juan cruz", "mary sol", "leon"]


def test_ages(spark):
    rows = [("30",), (" 30 ",), ("25 years",), ("",), (None,), ("inf",), ("0",)]
    got = one(spark, rows, "a string", c=N.convert_age(F.col("a")), i=N.safe_int(F.col("a")), s=N.sanitize_age(F.col("a")))
    assert [g["c"] for g in got] == [30.0, 30.0, 0.0, 0.0, None, float("inf"), 0.0]
    assert [g["i"] for g in got] == [30, 30, None, None, None, None, 0] and got[6]["s"] is None


def test_cells(spark):
    rows = [("[Ana, Bo]", "ana, cy"), ("['Ana']", "[ana"), (None, "nan"), ("Yolo Co.", "YOLO  county")]
    got = one(spark, rows, "a string, b string", a=C.extract_values(F.col("a")), b=C.extract_values(F.col("b")), s=C.compare_sets(C.extract_values(F.col("a")), C.extract_values(F.col("b"))), n=C.normalize_string(F.col("b")))
    assert got[0]["a"] == ["ana", "bo"] and tuple(got[0]["s"]) == (1, 1, 1) and got[1]["a"] == ["ana"] and got[2]["a"] == got[2]["b"] == []
    assert got[3]["a"] == got[3]["b"] == ["yolo"] and got[3]["n"] == "yolo"


def test_fuzzy_sets(spark):
    """Against one row at a time."""
    import difflib

    from kinloom.operators.evaluate import fuzzy_hits

    r = random.Random(23)
    word = lambda: "".join(r.choice("abcde ") for _ in range(r.randint(0, 7)))
    rows = [(["maria lopez", "juan"], ["maria lopes", "pedro"]), ([], ["x"]), (["a"], []), (["ab", "abx"], ["aby", "abz"]), ([""], ["", "b"])]
    rows += [(sorted({word() for _ in range(r.randint(0, 5))}), sorted({word() for _ in range(r.randint(0, 5))})) for _ in range(150)]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, g array<string>, p array<string>")
    for least in (0.5, 0.8):
        got = {x["k"]: (x["tp"], x["fp"], x["fn"]) for x in fuzzy_hits(df, ["k"], least).collect()}
        for k, (g, p) in enumerate(rows):
            left, used, tp = [y for y in p if y not in g], set(g) & set(p), len(set(g) & set(p))
            for x in g:
                if x not in p and left:
                    ratio, best = max((difflib.SequenceMatcher(None, x, y).ratio(), y) for y in left)
                    if ratio >= least:
                        tp += 1
                        used.add(best)
            assert got[k] == (tp, len(set(p) - used), len(g) - tp), (g, p)
