"""Record linkage: candidate pairs, features, scoring profiles, filters, merging and enrichment.

Names repeat, so distances are computed once for each pair of distinct names. Within a fixed number of edits, distinct names meet through an
equi-join on pieces: of two names within k edits, one has one of the k + 1 even pieces of the other unedited and at most k places away. Built-in
bounds drop most pairs. Full names then meet on both parts at once: a side's full name with each first name near its own, the other side's with each last name near its own,
joined on (first, last); so no two full names meet that are near in one part only, and records meet last.

Under the dynamic limit of the v0 profile a part may be far (five edits and more) if the other one is near, for the score bars two far parts. So the near part is found by pieces, and the far one
is compared only where the near one holds.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import settle

ROLES = ("direct", "mother", "father")
#: Column names of either side for each role, for the 1790 census and for the padrones.
BAPTISM_COLUMNS = {
    "direct": ("SpanishName", "Surname"),
    "mother": ("MSpanishName", "MSurname"),
    "father": ("FSpanishName", "FSurname"),
    "gender": "Sex",
    "age": "Age",
}
CENSUS_COLUMNS = {"name": ("First", "Last"), "gender": "Gender", "age": "Age"}
PADRON_COLUMNS = {"name": ("Ego_First Name", "Ego_Last Name"), "gender": "Sex", "age": "Age"}

# Weights and cuts of the profiles.
V0_WEIGHTS = {"first": 0.45, "last": 0.45, "gender": 0.10}
V0_CUT = 0.4
V1_CUT = 3
ANALYSIS_WEIGHTS = {"first": 0.20, "last": 0.35, "age": 0.30, "gender": 0.15}
ANALYSIS_CUT = 0.8


def name_pairs(left: DataFrame, right: DataFrame, l: str, r: str, most: int | None = None) -> DataFrame:  # noqa: E741
    """(l, r, distance) of distinct normalised names; with ``most``, of those within that distance only.

    Without ``most`` it keeps pairs whose distance is below their dynamic maximum, which are all with a positive probability.
    """
    a = left.select(F.col(l).alias("l")).where("l is not null").distinct()
    b = right.select(F.col(r).alias("r")).where("r is not null").distinct()
    if most is not None:
        near = candidate_names(a, b, most).distinct()
        limit = F.lit(most)
    else:
        # |la - lb| <= 5 + 0.2 (max - 8): the longer side may reach (5 + lb - 1.6) / 0.8.
        short = F.greatest(F.lit(0), F.floor(F.length("r") - (5 + F.greatest(F.length("r") - 8, F.lit(0)) * 0.2))).cast("int")
        long = F.greatest(F.length("r") + 5, F.floor((F.length("r") + 3.4 + 1e-9) / 0.8)).cast("int")
        pairs = a.withColumn("len", F.length("l")).join(b.withColumn("len", F.explode(F.sequence(short, long))), "len")
        limit = F.floor(N.dynamic_max_distance(F.col("l"), F.col("r"))).cast("int")
        near = pairs.where(F.levenshtein(N.canon(F.col("l")), N.canon(F.col("r"))) <= limit)
    return near.withColumn("distance", N.weighted_distance(F.col("l"), F.col("r"))).where(F.col("distance") <= limit).select("l", "r", "distance")


def candidate_names(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Pairs (l, r) of names that share a piece and are within ``k`` edits in canonical letters; a pair comes once for each piece it shares."""
    probe = a.withColumn("key", F.explode(N.probe_keys(F.col("l"), k)))
    own = b.withColumn("key", F.explode(N.own_keys(F.col("r"), k)))
    return probe.join(own, "key").where(F.levenshtein(N.canon(F.col("l")), N.canon(F.col("r")), k) >= 0).select("l", "r")


def _in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, name: str) -> DataFrame:
    """``keys`` and ``name``: up to ``size`` rows of equal keys that follow each other in ``order``, as an array of structs in that order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fields = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    blocks = df.withColumn("__block", F.floor((place - 1) / size)).groupBy(*keys, "__block")
    return blocks.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name)).drop("__block")


def pairs_of_groups(a: DataFrame, b: DataFrame, key: str, a_order: Sequence[str], b_order: Sequence[str], most: int = 1 << 27) -> DataFrame:
    """All pairs of rows with one ``key``, for keys with few values and large groups: the join on ``key``, spread over the cluster. Other columns have distinct names.

    A group of ``a`` is dealt out by a hash of its order and meets a copy of that of ``b``, the smaller side, in each deal. Such input is small beside its pairs, so that its size says
    nothing about the work: pairs are counted first. A deal of the largest group makes about ``most`` of them, fewer where few keys would leave cores idle, and there are 64 deals at most, for each is one more copy of ``b`` on disk.

    Pairs come in blocks: each row of ``b`` with the same 168 rows of ``a``. What is written is then long runs of one value and a short cycle of others, which Parquet keeps in some 0.15 to 0.18
    bytes a pair. A cycle over a whole group is longer than the compressor's window, and takes two bytes a pair. 168 is a third of the format's longest bit-packed run, so that cycles stay
    in step with runs. Orders should put rows side by side that fare alike under what is computed of a pair.
    """
    spark = a.sparkSession
    groups = a.groupBy(key).agg(F.count("*").alias("__n")).join(b.groupBy(key).agg(F.count("*").alias("__m")), key)
    keys, largest, made = groups.select((F.col("__n").cast("double") * F.col("__m")).alias("pairs")).agg(F.count("*"), F.coalesce(F.max("pairs"), F.lit(0.0)), F.coalesce(F.sum("pairs"), F.lit(0.0))).first()
    cores = spark.sparkContext.defaultParallelism
    deals = min(64, max(8, math.ceil(largest / most), math.ceil(8 * cores / max(keys, 1))))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * cores, math.ceil(4 * made / most))
    known = F.col(key).isNotNull()
    left = a.where(known).withColumn("__deal", F.pmod(F.xxhash64(*a_order), F.lit(deals)).cast("int")).repartition(n, key, "__deal")
    right = _in_blocks(b.where(known), [key], b_order, 256, "__b").withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).repartition(n, key, "__deal")
    blocks = _in_blocks(left, [key, "__deal"], a_order, 168, "__a").join(right.hint("shuffle_hash"), [key, "__deal"])
    return blocks.select(key, "__a", F.inline("__b")).select("*", F.inline("__a")).drop("__a")


def gender_feature(a: Column, b: Column) -> Column:
    return F.when(F.lower(F.trim(a)) == F.lower(F.trim(b)), 1).otherwise(0)


def age_feature(a: Column, b: Column, most: float = 2, literal: bool = False) -> Column:
    """1 if both ages are known and differ by ``most`` at most; ``literal`` never scores it."""
    return F.lit(0) if literal else F.when(F.abs(a.cast("double") - b.cast("double")) <= most, 1).otherwise(0)


def age_decay(a: Column, b: Column) -> Column:
    """Linear from 1 at no difference to 0 at five years; null is 0."""
    return F.coalesce(F.greatest(F.lit(0.0), (5 - F.abs(a.cast("double") - b.cast("double"))) / 5), F.lit(0.0))


def v0_feature(probability: Column) -> Column:
    return F.when(probability.isNull(), F.lit(0.0)).otherwise(F.lit(1.0) - F.exp(-probability))


def v1_name_feature(distance: Column, l: Column, r: Column, rule: str = "distance_le_2") -> Column:  # noqa: E741
    """``distance_le_2``: within two edits. ``nonnull``: any two names."""
    hit = (distance <= 2) if rule == "distance_le_2" else (l.isNotNull() & r.isNotNull())
    return F.when(hit, 1).otherwise(0)


def weighted_total(features: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.coalesce(features[k].cast("double"), F.lit(0.0)) * F.lit(w)
    return total


def criteria(features: Mapping[str, Column]) -> Column:
    """Labels of the features that score 1, joined by a comma."""
    return F.concat_ws(", ", *[F.when(v == 1, F.lit(k)) for k, v in features.items()])


def full_name_pairs(c: DataFrame, b: DataFrame, first: DataFrame, last: DataFrame) -> DataFrame:
    """Distinct full names (cf, cl) and (bf, bl) whose first names are in ``first`` (cf, bf, first_distance) and whose last names are in ``last`` (cl, bl, last_distance)."""
    left = c.select("cf", "cl").distinct().join(first, "cf")
    right = b.select("bf", "bl").distinct().join(last, "bl")
    return left.join(right, ["bf", "cl"])


def _far(pairs: DataFrame, l: str, r: str, out: str) -> DataFrame:  # noqa: E741
    """Pairs whose names ``l`` and ``r`` are within their dynamic maximum, with the distance; each two names are compared once."""
    names = pairs.select(l, r).distinct()
    most = N.dynamic_max_distance(F.col(l), F.col(r))
    names = names.where(F.levenshtein(N.canon(F.col(l)), N.canon(F.col(r))) <= F.floor(most)).withColumn(out, N.weighted_distance(F.col(l), F.col(r))).where(F.col(out) <= most)
    return pairs.join(names, [l, r])


def near_share() -> float:
    """The share of its dynamic maximum within which one of the two distances of an accepted pair lies at least: with both beyond it, even equal genders do not reach the cut."""
    left = 1 - (V0_CUT - V0_WEIGHTS["gender"]) / (V0_WEIGHTS["first"] + V0_WEIGHTS["last"])
    return 1 + math.log(left)


def longest_name(*columns: tuple[DataFrame, str]) -> int:
    """Letters of the longest name in any of the columns."""
    sizes = None
    for df, c in columns:
        one = df.select(F.length(c).alias("n"))
        sizes = one if sizes is None else sizes.unionByName(one)
    return sizes.agg(F.max("n")).first()[0] or 0


def near_name_pairs(left: DataFrame, right: DataFrame, l: str, r: str, longest: int | None = None) -> DataFrame:  # noqa: E741
    """(l, r, distance) of distinct names within :func:`near_share` of their dynamic maximum, by pieces: one join for each number of edits that some length up to ``longest`` allows."""
    a = left.select(F.col(l).alias("l")).where("l is not null").distinct()
    b = right.select(F.col(r).alias("r")).where("r is not null").distinct()
    longest = longest_name((a, "l"), (b, "r")) if longest is None else longest
    share, out, low = near_share(), None, 0
    while low <= longest:
        k = math.floor(share * 5 + share * 0.2 * max(0, low - 8) + 1e-9)
        high = max(8, math.ceil(8 + ((k + 1) / share - 5) / 0.2) - 1)  # the last length with this number of edits
        size = F.greatest(F.length("l"), F.length("r"))
        met = candidate_names(a.where(F.length("l") <= high), b.where(F.length("r") <= high), k).where(size.between(low, high)).distinct()
        met = met.withColumn("distance", N.weighted_distance(F.col("l"), F.col("r"))).where(F.col("distance") <= F.lit(share) * N.dynamic_max_distance(F.col("l"), F.col("r")))
        out = met if out is None else out.unionByName(met)
        low = high + 1
    return out.select("l", "r", "distance")


def candidates(census: DataFrame, baptisms: DataFrame, role: str, census_columns: Mapping = CENSUS_COLUMNS, baptism_columns: Mapping = BAPTISM_COLUMNS, most: int | None = None) -> DataFrame:
    """Pairs of census and baptism records whose names can match in one role, with both distances: within ``most`` edits in either part, or, without it, all that the v0 profile can accept.

    Columns of the census side get the prefix ``c_``, those of the baptisms ``b_``.
    """
    (cf, cl), (bf, bl) = census_columns["name"], baptism_columns[role]
    norm = lambda df, p, f, l: df.select(*[F.col(f"`{c}`").alias(f"{p}_{c}") for c in df.columns], N.normalize(F.col(f"`{f}`")).alias(f"{p}f"), N.normalize(F.col(f"`{l}`")).alias(f"{p}l"))  # noqa: E731, E741
    c, b = norm(census, "c", cf, cl), norm(baptisms, "b", bf, bl)
    if most is not None:
        first = name_pairs(c, b, "cf", "bf", most).toDF("cf", "bf", "first_distance")
        last = name_pairs(c, b, "cl", "bl", most).toDF("cl", "bl", "last_distance")
        names = full_name_pairs(c, b, first, last)
    else:
        names = coupled_names(c, b)
    return c.join(names, ["cf", "cl"]).join(b, ["bf", "bl"]).withColumn("role", F.lit(role))


def coupled_names(c: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct full names (cf, cl) and (bf, bl) within their dynamic maxima, one part of which is near, with both distances."""
    ours, theirs = c.select("cf", "cl").distinct(), b.select("bf", "bl").distinct()
    longest = longest_name((ours, "cf"), (ours, "cl"), (theirs, "bf"), (theirs, "bl"))
    first = settle(near_name_pairs(c, b, "cf", "bf", longest).toDF("cf", "bf", "first_distance"), "near")
    last = near_name_pairs(c, b, "cl", "bl", longest).toDF("cl", "bl", "last_distance")
    by_first = _far(ours.join(first, "cf").join(theirs, "bf"), "cl", "bl", "last_distance")
    by_last = ours.join(last, "cl").join(theirs, "bl").join(first.drop("first_distance"), ["cf", "bf"], "left_anti")
    return by_first.unionByName(_far(by_last, "cf", "bf", "first_distance"))


def v0_scores(pairs: DataFrame, c_gender: str, b_gender: str) -> DataFrame:
    """``score``: 0.45 first + 0.45 last + 0.10 gender on exponential name features."""
    p = lambda a, b, d: N.match_probability(F.col(d), N.dynamic_max_distance(F.col(a), F.col(b)))
    features = {"first": v0_feature(p("cf", "bf", "first_distance")), "last": v0_feature(p("cl", "bl", "last_distance")), "gender": gender_feature(F.col(c_gender), F.col(b_gender))}
    return pairs.withColumn("score", weighted_total(features, V0_WEIGHTS))


def v1_scores(pairs: DataFrame, c_gender: str, b_gender: str, c_age: str, b_age: str, rule: str = "distance_le_2", literal_age: bool = False) -> DataFrame:
    """``score``: the sum of 0/1 features, and ``criteria``, the labels of those that hold."""
    f = {
        "First Name": v1_name_feature(F.col("first_distance"), F.col("cf"), F.col("bf"), rule),
        "Last Name": v1_name_feature(F.col("last_distance"), F.col("cl"), F.col("bl"), rule),
        "Gender": gender_feature(F.col(c_gender), F.col(b_gender)),
        "Age": age_feature(F.col(c_age), F.col(b_age), literal=literal_age),
    }
    total = F.lit(0)
    for v in f.values():
        total = total + v
    return pairs.withColumn("score", total.cast("double")).withColumn("criteria", criteria(f))


def analysis_scores(pairs: DataFrame, c_gender: str, b_gender: str, c_age: str, b_age: str) -> DataFrame:
    """Weighted binary features; ``accepted`` from 0.8 on."""
    f = {
        "first": F.when(F.col("first_distance") <= 2, 1).otherwise(0),
        "last": F.when(F.col("last_distance") <= 2, 1).otherwise(0),
        "age": age_feature(F.col(c_age), F.col(b_age), 3),
        "gender": gender_feature(F.col(c_gender), F.col(b_gender)),
    }
    out = pairs.withColumn("score", weighted_total(f, ANALYSIS_WEIGHTS))
    return out.withColumn("accepted", F.col("score") >= ANALYSIS_CUT - 1e-9)


def best_per(pairs: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return pairs.withColumn("__rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rank = 1").drop("__rank")


def filter_matched(scored: DataFrame, scores: Mapping[str, str], threshold: float, dataset: str) -> DataFrame:
    """One row for each match type whose score reaches the threshold, in one pass: ``match_type``, ``dataset_key``."""
    options = F.array(*[F.struct(F.lit(t).alias("type"), F.col(c).cast("double").alias("score")) for t, c in scores.items()])
    hits = F.explode(F.filter(options, lambda s: s["score"] >= threshold))
    return scored.withColumn("__hit", hits).withColumn("match_type", F.col("__hit.type")).withColumn("dataset_key", F.lit(dataset)).drop("__hit")


def combine_matches(rows: DataFrame, keys: Sequence[str], scores: Sequence[str], text: str = "criteria") -> DataFrame:
    """One row for each pair: highest scores, text of the first match type in the order direct, mother, father, and the merged type.

    A direct match stays direct; mother and father together are ``mother_father``.
    """
    kind = F.lower("match_type")
    of = lambda t: F.max(F.when(kind == t, F.nullif(F.col(text), F.lit(""))))
    has = lambda t: F.bool_or(kind == t)
    merged = F.when(has("direct"), "direct").when(has("mother") & has("father"), "mother_father").when(has("mother"), "mother").otherwise("father")
    return rows.groupBy(*keys).agg(*[F.max(s).alias(s) for s in scores], F.coalesce(*[of(t) for t in ROLES]).alias(text), merged.alias("match_type"))


# Output column of the enrichment, the baptism column, and the match types that carry it (None: all).
ENRICH = (
    ("baptismal_date", "Date", None), ("location_ecpp_baptism", "Mission", None), ("sex", "Sex", None),
    ("origin_parish_1790_census", "Place", None), ("notes_url_1790_census", "Notes", None),
    ("first_name", "SpanishName", None), ("last_name", "Surname", None),
    ("father_first_name", "FSpanishName", ("direct", "father", "mother_father")), ("father_last_name", "FSurname", ("direct", "father", "mother_father")),
    ("father_military_status", "FMilitaryStatus", ("direct",)), ("father_origin", "FOrigin", ("direct",)),
    ("mother_first_name", "MSpanishName", ("direct", "mother", "mother_father")), ("mother_last_name", "MSurname", ("direct", "mother", "mother_father")),
    ("mother_origin", "MOrigin", ("direct",)),
)
# Order of the enriched table.
COLLECTED = (
    "#ID", "ecpp_id", "Direct_Total_Match_Score", "Mother_Total_Match_Score", "Father_Total_Match_Score", "Matched_Criteria", "match_type", "dataset_key",
    "first_name", "last_name", "father_first_name", "father_last_name", "father_military_status", "father_origin", "mother_first_name", "mother_last_name",
    "mother_origin", "sex", "race_1790", "race_1781", "race_1785", "race_1821", "race_267", "race_aggregated", "ethnicity",
    "origin_parish_1790_census", "baptismal_date", "location_ecpp_baptism", "notes_url_1790_census",
)
RACES = {"race_1790": "afro_1790_census", "race_1781": "padron_1781", "race_1785": "padron_1785", "race_1821": "padron_1821", "race_267": "padron_267"}


def enrich(matches: DataFrame, baptisms: DataFrame, races: DataFrame) -> DataFrame:
    """Matches with baptism fields by match type and each dataset's own race: two left joins.

    ``matches`` has ``#ID``, ``ecpp_id``, ``match_type``, ``dataset_key``, the three totals and ``Matched_Criteria``;
    ``races`` has ``dataset_key``, ``ecpp_id``, ``Race``.
    """
    b = baptisms.select(F.col("`#ID`").alias("__id"), *[F.col(f"`{c}`").alias(f"__{c}") for c in baptisms.columns if c != "#ID"])
    r = races.select(F.col("dataset_key").alias("__key"), F.col("ecpp_id").alias("__ecpp"), F.col("Race").alias("__race"))
    joined = matches.join(b, F.col("`#ID`") == F.col("__id"), "left").join(r, (F.col("dataset_key") == F.col("__key")) & (F.col("ecpp_id") == F.col("__ecpp")), "left")
    take = lambda c: F.col(f"`__{c}`") if f"__{c}" in joined.columns else F.lit(None).cast("string")
    out = {}
    for name, source, kinds in ENRICH:
        out[name] = take(source) if kinds is None else F.when(F.col("match_type").isin(*kinds), take(source))
    out["ethnicity"] = F.when(F.col("match_type").isin("direct"), take("Ethnicity")).when(F.col("match_type").isin("mother", "mother_father"), take("MEthnicity")).otherwise(take("FEthnicity"))
    for name, key in RACES.items():
        out[name] = F.when(F.col("dataset_key") == key, F.col("__race"))
    full = joined.withColumns(out)
    full = full.withColumn("race_aggregated", N.join_races([F.col(c) for c in RACES]))
    for c in ("ethnicity", "origin_parish_1790_census"):
        full = full.withColumn(c, N.plain_list(F.col(c)))
    for c in ("first_name", "last_name", "father_first_name", "father_last_name", "mother_first_name", "mother_last_name"):
        full = full.withColumn(c, N.strip_brackets(F.col(c)))
    return full.select(*[F.col(f"`{c}`") for c in COLLECTED])


# The first profile's table: output column, the side it comes from (c: census, b: baptisms), and the column there.
COLLECTED_V0 = (
    ("last_name", "c", "Last"), ("first_name", "c", "First"), ("father_last_name", "c", "Father_Last"), ("father_first_name", "c", "Father_First"), ("mother_last_name", "c", "Mother_Last"),
    ("mother_first_name", "c", "Mother_First"), ("father_origin", "b", "FOrigin"), ("mother_origin", "b", "MOrigin"), ("father_military_status", "b", "FMilitaryStatus"), ("sex", "b", "Sex"),
    ("race_1790", "c", "Race"), ("ethnicity", "b", "Ethnicity"), ("baptismal_date", "b", "FmtdDate"), ("location_ecpp_baptism", "b", "DMission"), ("location_1790_census", "c", "Current_Location"),
    ("origin_parish_1790_census", "c", "Origin Parish"), ("location_other_race", "c", "Location Other Race"),
)
RACE_FIELDS_V0 = ("race_1790", "ethnicity")


def enrich_v0(matches: DataFrame, baptisms: DataFrame, census: DataFrame, literal: bool = False) -> DataFrame:
    """Matches (``pc_id``, ``ecpp_id``, ``#ID``) with the columns of the first profile, races and ethnicities as cleaned lists; columns that a side lacks are null.

    Keys of either side are unique. ``literal`` takes the mother's origin from the father's column, as the first profile's own table does.
    """
    side = lambda df, key, p: df.select(F.col(f"`{key}`").alias(f"__{p}"), *[F.col(f"`{c}`").alias(f"__{p}_{c}") for c in df.columns if c != key])
    joined = matches.join(side(census, "ecpp_id", "c"), F.col("ecpp_id") == F.col("__c"), "left").join(side(baptisms, "#ID", "b"), F.col("`#ID`") == F.col("__b"), "left")
    out = []
    for name, p, column in COLLECTED_V0:
        column = "FOrigin" if literal and name == "mother_origin" else column
        value = F.col(f"`__{p}_{column}`").cast("string") if f"__{p}_{column}" in joined.columns else F.lit(None).cast("string")
        out.append((F.array_join(N.race_list(value), ", ") if name in RACE_FIELDS_V0 else value).alias(name))
    return joined.select("pc_id", F.col("ecpp_id").alias("1790_ecpp_id"), F.col("`#ID`").alias("baptisms_id"), *out)
