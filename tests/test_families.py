"""Components, blocking of namesakes, names met on both parts, and families of integrated people, against plain Python."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kinloom.functions import names as N
from kinloom.operators import components as comp
from kinloom.operators import graph, kinship, linkage


def groups(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("order", ["falling", "shuffled"])
def test_a_chain_of_ten_thousand(spark, order):
    ids = [1, *range(9999, 1, -1)] if order == "falling" else random.Random(3).sample(range(10_000), 10_000)
    edges = spark.createDataFrame(list(itertools.pairwise(ids)), "u long, v long")
    got = comp.components(edges, rounds=20)
    assert got.count() == len(ids) and {r[0] for r in got.select("root").distinct().collect()} == {min(ids)}


def test_components_of_random_edges(spark):
    r = random.Random(4)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)]
    got = {x["node"]: x["root"] for x in comp.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == groups([p for p in pairs if p[0] != p[1]])
    assert comp.components(spark.createDataFrame([(1, 1)], "u long, v long")).count() == 0


NODE = "id long, name string, gender string, race string, birth_year double, spouse string"


def agree(a, b):
    _, _, ga, ra, ya, sa = a
    _, _, gb, rb, yb, sb = b
    ok = lambda x, y, rule: x is None or y is None or rule(x, y)
    return ok(ya, yb, lambda x, y: abs(x - y) <= 5) and ok(ga, gb, str.__eq__) and ok(ra, rb, lambda x, y: ";" in x + y or x == y) and ok(sa, sb, lambda x, y: N._dp(x, y) <= 3)


def people(r, n):
    some = lambda *v: r.choice([None, *v])
    return [(k, r.choice(["jose vaca", "jose baca", "ana paz", "anna pas", "luz"]), some("m", "f"), some("a", "b", "a;b"), some(*(float(1700 + r.randint(0, 60)) for _ in range(4))), some("rosa", "roza", "pedro paz", "x")) for k in range(n)]


def test_namesakes_in_bands_join_what_all_pairs_join(spark):
    rows = people(random.Random(6), 90)
    df = spark.createDataFrame(rows, NODE)
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if N._dp(a[1], b[1]) <= 2 and agree(a, b)]
    assert groups(map(tuple, graph.node_edges(df).collect())) == groups(pairs)
    found = sorted((r["a_id"], r["b_id"], r["distance"]) for r in graph.compatible_pairs(df, df).collect())
    assert found == sorted((a[0], b[0], N._dp(a[1], b[1])) for a in rows for b in rows if N._dp(a[1], b[1]) <= 2 and agree(a, b))


def test_a_hundred_thousand_namesakes(spark):
    """All pairs of these would be five billion."""
    k = F.col("id")
    df = spark.range(100_000).select("id", F.lit("jose vaca").alias("name"), F.when(k % 2 == 0, "m").otherwise("f").alias("gender"), F.lit(None).cast("string").alias("race"), (1500 + k % 300 * 7).cast("double").alias("birth_year"), F.when(k % 4 > 0, F.concat(F.lit("sp"), F.md5((k % 997).cast("string").cast("binary")))).alias("spouse"))
    got = graph.resolve(df)
    # Years are seven apart. Where spouses are unknown all of a year are one; elsewhere each has a spouse of their own in that year.
    assert got.count() == 100_000 and got.select("entity").distinct().count() == 75 + 75_000


def test_names_meet_on_both_parts(spark):
    """With few first names, records that are near in the first name alone are some hundred millions; none of them meets."""
    r = random.Random(8)
    firsts = ["jose", "maria", "juan", "ana", "pedro", "luisa", "diego", "rosa", "pablo", "ines", "tomas", "clara", "mateo", "elena", "lucas", "marta", "simon", "julia", "felix", "delia"]
    lasts = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(3, 5))) for _ in range(2000)]
    weights = [1 / (k + 1) for k in range(len(firsts))]
    side = lambda p: spark.createDataFrame([(r.choices(firsts, weights)[0], r.choice(lasts)) for _ in range(100_000)], f"{p}f string, {p}l string")
    c, b = side("c").cache(), side("b").cache()
    first = linkage.name_pairs(c, b, "cf", "bf", 2).toDF("cf", "bf", "first_distance")
    last = linkage.name_pairs(c, b, "cl", "bl", 2).toDF("cl", "bl", "last_distance").cache()
    pairs = linkage.full_name_pairs(c, b, first, last)
    rows = c.select("cf", "cl").distinct().join(first, "cf").count() + b.select("bf", "bl").distinct().join(last, "bl").count()
    true = pairs.count()
    assert pairs.where((F.col("first_distance") > 2) | (F.col("last_distance") > 2)).count() == 0 and pairs.distinct().count() == true
    assert rows < 40 * 40_000 < c.join(first, "cf").join(b.groupBy("bf").count(), "bf").agg(F.sum("count")).first()[0] / 100


def test_coupled_names_are_all_that_the_profile_accepts(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcsvzi") for _ in range(r.randint(1, 12)))
    words = [word() for _ in range(25)]
    words += [w + r.choice("abz") for w in words[:10]] + ["sebastianademontemayor", "sebastianodemontemayor", "sevastianademonte"]
    rows = sorted({(r.choice(words), r.choice(words)) for _ in range(120)})
    c, b = spark.createDataFrame(rows, "cf string, cl string"), spark.createDataFrame(rows, "bf string, bl string")
    got = {(x["cf"], x["cl"], x["bf"], x["bl"]): (x["first_distance"], x["last_distance"]) for x in linkage.coupled_names(c, b).collect()}

    def feature(x, y):
        most, d = 5 + 0.2 * max(0, max(len(x), len(y)) - 8), N._dp(x, y)
        return 0.0 if d > most else 1 - math.exp(-(most - d) / most)

    accepted = {(*p, *q) for p in rows for q in rows if 0.45 * feature(p[0], q[0]) + 0.45 * feature(p[1], q[1]) + 0.1 > 0.4}
    assert accepted <= set(got) and all(d == (N._dp(k[0], k[2]), N._dp(k[1], k[3])) for k, d in got.items())
    # What meets beyond that is bounded: one part is near, the other within its limit.
    assert len(got) < 2 * len(accepted)


def test_coupling_meets_within_a_factor_of_what_it_accepts(spark):
    """Candidates of the first profile over some thousand full names with few first names, which is its worst case: the score lets last names of one first name be four edits apart."""
    r = random.Random(10)
    syllable = lambda: r.choice("bcdfglmnprst") + r.choice("aeiou")
    firsts = ["".join(syllable() for _ in range(r.randint(2, 4))) for _ in range(60)]
    lasts = ["".join(syllable() for _ in range(r.randint(3, 5))) for _ in range(1500)]
    rows = sorted({(firsts[int(60 * r.random() ** 2)], r.choice(lasts)) for _ in range(4000)})
    c, b = spark.createDataFrame(rows, "cf string, cl string").cache(), spark.createDataFrame(rows, "bf string, bl string").cache()
    first = linkage.near_name_pairs(c, b, "cf", "bf").toDF("cf", "bf", "fd")
    last = linkage.near_name_pairs(c, b, "cl", "bl").toDF("cl", "bl", "ld")
    met = c.join(first, "cf").join(b, "bf").count() + c.join(last, "cl").join(b, "bl").count()
    pairs = linkage.coupled_names(c, b).select(F.col("cf"), "cl", "bf", "bl", "first_distance", "last_distance", F.lit("x").alias("g"))
    accepted = linkage.v0_scores(pairs, "g", "g").where(F.col("score") > linkage.V0_CUT).count()
    # Measured: 3,827 names, 658,358 pairs that meet in one part, 23,003 accepted; all pairs would be 14.6 million.
    assert len(rows) < accepted and met < 40 * accepted and met < len(rows) ** 2 / 20


PERSON = "id long, name string, father string, mother string, spouse string, gender string, race string, birth_year double, age double, census_year int"


def small_town(spark):
    rows = [
        (1, "juan", None, None, "rosa", "m", "a", None, 40.0, 1760), (2, "rosa", None, None, "juan", "f", "b", None, 38.0, 1760), (3, "luz", "juan", "rosa", None, "f", None, None, 10.0, 1760),
        (11, "juan", None, None, "ines", "m", "c", None, 50.0, 1770), (12, "ines", None, None, "juan", "f", None, None, 44.0, 1770), (13, "luz", "pablo", "ines", None, "f", "a", None, 20.0, 1770), (14, "pablo", None, None, None, "m", None, None, 45.0, 1770), (15, "teo", "jvan", "rosa", None, "m", None, None, 4.0, 1770),
        (21, "luz", "juan", None, "luz", "f", None, None, 30.0, 1780), (22, "juan", None, None, None, "m", None, None, 60.0, 1780), (23, "old", "luz", None, None, "m", None, None, 70.0, 1780), (24, "lost", "nobody", None, None, None, None, None, None, None),
    ]
    entities = [(1, 1), (2, 2), (3, 3), (11, 1), (12, 12), (13, 3), (14, 14), (15, 15), (21, 3), (22, 1), (23, 23), (24, 24)]
    return spark.createDataFrame(rows, PERSON), spark.createDataFrame(entities, "id long, entity long")


def test_family_of_entities(spark):
    persons, entities = small_town(spark)
    edges = kinship.link_censuses(persons)
    got = sorted(map(tuple, edges.collect()))
    assert got == [
        (1760, 1, 2, "spouse"), (1760, 1, 3, "father"), (1760, 2, 1, "spouse"), (1760, 2, 3, "mother"), (1770, 11, 12, "spouse"), (1770, 11, 15, "father"), (1770, 12, 11, "spouse"), (1770, 12, 13, "mother"), (1770, 14, 13, "father"), (1780, 22, 21, "father"),
    ]
    family = sorted(map(tuple, kinship.integrated_family(persons, entities).select("src", "dst", "rel", "votes", "rivals", "first_year").collect()))
    # luz names juan twice and pablo once; her mothers tie, and the earlier census stands. juan's wives tie likewise.
    assert family == [(1, 2, "spouse", 1, 0, 1760), (1, 3, "father", 2, 1, 1760), (1, 15, "father", 1, 0, 1770), (2, 1, "spouse", 1, 1, 1760), (2, 3, "mother", 1, 1, 1760)]


def test_timeline_of_relations(spark):
    persons, entities = small_town(spark)
    relations = kinship.relation_rows(kinship.link_censuses(persons), entities)
    rows = {(r["entity"], r["census_year"]): r for r in kinship.timeline(persons, entities, relations).collect()}
    one = lambda e, y: tuple(rows[e, y][c] for c in ("age", "race", "father", "mother", "spouse", "n_children", "known_father", "known_mother", "known_spouse", "all_children"))
    assert one(3, 1760) == (10.0, None, 1, 2, None, 0, 1, 2, None, 0) and one(3, 1770) == (20.0, "a", 14, 12, None, 0, 1, 2, None, 0) and one(3, 1780) == (30.0, None, 1, None, None, 0, 1, 2, None, 0)
    assert one(1, 1760) == (40.0, "a", None, None, 2, 1, None, None, 2, 1) and one(1, 1770) == (50.0, "c", None, None, 12, 1, None, None, 2, 2) and one(1, 1780) == (60.0, None, None, None, None, 1, None, None, 2, 2)
    assert one(24, 0)[:2] == (None, None)
    nested = {r["entity"]: r for r in kinship.nested_timeline(kinship.timeline(persons, entities, relations), relations).collect()}
    assert sorted(nested[1]["timeline"]) == [1760, 1770, 1780] and nested[1]["timeline"][1770]["children"] == [15] and nested[1]["children"] == [3, 15] and nested[24]["children"] == []


def test_no_persons(spark):
    persons, entities = (df.limit(0) for df in small_town(spark))
    assert kinship.integrated_family(persons, entities).count() == 0
    relations = kinship.relation_rows(kinship.link_censuses(persons), entities)
    assert kinship.timeline(persons, entities, relations).count() == 0
