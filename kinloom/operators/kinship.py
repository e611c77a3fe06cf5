"""Families of integrated people: relations of persons carried over to entities, their conflicts settled, and timelines of relations.

A person is one line of one census; an entity is what several persons were found to be. Relations are resolved by name inside a census, because that is where
a name means someone. Carrying the edges over contracts them: members of one entity may name different parents. Votes decide, then the earlier
census, then the smaller id, and what lost is counted.

Persons: id, name, father, mother, spouse, gender, race, birth_year, age, census_year. A null year counts as year 0, a census of its own. Entities: id, entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .graph import NAME_LIMIT, valid_parent_child, valid_spouses
from .linkage import name_pairs

RELATIONS = ("father", "mother", "spouse")
_ABOUT = ("name", "gender", "birth_year", "age")


def _year(c: str = "census_year") -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("int")


def link_censuses(persons: DataFrame, k: int = NAME_LIMIT) -> DataFrame:
    """(census_year, src, dst, rel) between persons of one census: parents to children, spouses both ways.

    A name means the person of that name, else the nearest within ``k`` edits, then the smallest id. References to oneself and relations that ages forbid are left out.
    All censuses and relations go through one set of joins on distinct names.
    """
    persons = persons.withColumn("census_year", _year())
    named = F.array(*[F.struct(F.lit(r).alias("rel"), F.col(r).cast("string").alias("ref")) for r in RELATIONS])
    refs = persons.select("census_year", "id", "name", F.inline(named)).where("ref is not null and ref <> name").select("census_year", "id", "rel", "ref")
    own = persons.groupBy("census_year", "name").agg(F.min("id").alias("target"))
    wanted = refs.select("census_year", "ref").distinct()
    near = name_pairs(wanted, own, "ref", "name", k).toDF("ref", "name", "distance")
    best = F.min(F.struct(F.col("name") != F.col("ref"), "distance", "target").alias("b")).alias("b")
    found = wanted.join(near, "ref").join(own, ["census_year", "name"]).groupBy("census_year", "ref").agg(best).select("census_year", "ref", F.col("b.target").alias("target"))
    me = persons.select("id", *[F.col(c).alias(f"c_{c}") for c in _ABOUT])
    other = persons.select(F.col("id").alias("target"), *[F.col(c).alias(f"p_{c}") for c in _ABOUT])
    pairs = refs.join(found, ["census_year", "ref"]).where("id <> target").join(other, "target").join(me, "id")
    pairs = pairs.where(F.when(F.col("rel") == "spouse", valid_spouses("p_", "c_")).otherwise(valid_parent_child("p_", "c_")))
    down = pairs.select("census_year", F.col("target").alias("src"), F.col("id").alias("dst"), "rel")
    back = pairs.where("rel = 'spouse'").select("census_year", F.col("id").alias("src"), F.col("target").alias("dst"), "rel")
    return down.unionByName(back).distinct()


def carried(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(census_year, src, dst, rel, votes): edges between entities, a vote for each edge between their members; none from an entity to itself."""
    of = lambda end: entities.select(F.col("id").alias(end), F.col("entity").alias(f"{end}_entity"))
    both = edges.join(of("src"), "src").join(of("dst"), "dst").where("src_entity <> dst_entity")
    return both.groupBy("census_year", F.col("src_entity").alias("src"), F.col("dst_entity").alias("dst"), "rel").agg(F.count(F.lit(1)).alias("votes"))


def about_entities(persons: DataFrame, entities: DataFrame) -> DataFrame:
    """``id``, ``name``, ``gender``, ``birth_year``, ``age`` of each entity: its founder's name, the first known gender, the mean year of birth of its census ages, else of the years given."""
    joined = persons.withColumn("census_year", _year()).join(entities, "id")
    known = lambda c, order: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    years = joined.groupBy("entity", "census_year").agg(
        F.min(F.struct((F.col("id") != F.col("entity")).alias("later"), "id", "name")).alias("founder"), F.min_by("age", "id").alias("age"),
        F.min(F.when(F.col("gender").isNotNull(), F.struct("id", "gender")))["gender"].alias("gender"), F.sum("birth_year").alias("born"), F.count("birth_year").alias("births"),
    )
    by_age = F.avg(F.when(F.col("census_year") > 0, F.col("census_year") - F.col("age")))
    return years.groupBy(F.col("entity").alias("id")).agg(
        F.min("founder")["name"].alias("name"), known("gender", F.col("census_year")).alias("gender"), F.coalesce(by_age, F.try_divide(F.sum("born"), F.sum("births"))).alias("birth_year"),
        F.max(F.when(F.col("age").isNotNull(), F.struct("census_year", "age")))["age"].alias("age"),
    )


def contract(edges: DataFrame, entities: DataFrame, about: DataFrame) -> DataFrame:
    """(src, dst, rel, votes, rivals, first_year): one father, mother and spouse at most for each entity.

    Of the entities that members name, the one of most votes stands, then of the earliest census, then of the smallest id; ``rivals`` counts the
    others. A spouse stands if each of the two is the other's choice. Relations that the entities' own years of birth forbid are left out before the choice.
    """
    all_years = carried(edges, entities).groupBy("src", "dst", "rel").agg(F.sum("votes").alias("votes"), F.min("census_year").alias("first_year"))
    side = lambda end, p: about.select(F.col("id").alias(end), *[F.col(c).alias(f"{p}{c}") for c in _ABOUT])
    pairs = all_years.join(side("src", "p_"), "src").join(side("dst", "c_"), "dst")
    pairs = pairs.where(F.when(F.col("rel") == "spouse", valid_spouses("p_", "c_")).otherwise(valid_parent_child("p_", "c_")))
    first = F.min(F.struct((-F.col("votes")).alias("less"), "first_year", "src")).alias("b")
    best = pairs.groupBy("dst", "rel").agg(first, (F.count(F.lit(1)) - 1).alias("rivals")).select(F.col("b.src").alias("src"), "dst", "rel", (-F.col("b.less")).alias("votes"), "rivals", F.col("b.first_year").alias("first_year"))
    best = settle(best, "choices")
    couples = best.where("rel = 'spouse'")
    mutual = couples.join(couples.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")
    return best.where("rel <> 'spouse'").unionByName(mutual)


def integrated_family(persons: DataFrame, entities: DataFrame, k: int = NAME_LIMIT) -> DataFrame:
    """:func:`contract` of the relations of all censuses."""
    return contract(link_censuses(persons, k), entities, about_entities(persons, entities))


def relation_rows(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, census_year, rel, other, votes): whom each entity was related to in each census, children as relations too; the long form, with no group that grows with a family."""
    votes = settle(carried(edges, entities), "votes")
    own = votes.select(F.col("dst").alias("entity"), "census_year", "rel", F.col("src").alias("other"), "votes")
    children = votes.where("rel <> 'spouse'").groupBy(F.col("src").alias("entity"), "census_year", F.col("dst").alias("other")).agg(F.sum("votes").alias("votes"))
    return own.unionByName(children.select("entity", "census_year", F.lit("child").alias("rel"), "other", "votes"))


def timeline(persons: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row for each entity and census: age and race of its member of the smallest id, the father, mother and spouse of that census, its children then, and what is known by then.

    ``known_father``, ``known_mother`` and ``known_spouse`` are the first ever named (of the earliest census, by votes, then id); ``n_children`` counts those of the census, ``all_children`` those of it and all before.
    """
    joined = persons.withColumn("census_year", _year()).join(entities, "id")
    lines = joined.groupBy("entity", "census_year").agg(F.min_by("age", "id").alias("age"), F.min_by("race", "id").alias("race"))
    chosen = lambda r: F.min(F.when(F.col("rel") == r, F.struct((-F.col("votes")).alias("less"), "other")))["other"].alias(r)
    kin = relations.groupBy("entity", "census_year").agg(*[chosen(r) for r in RELATIONS], F.count_if(F.col("rel") == "child").alias("n_children"))
    fresh = relations.where("rel = 'child'").groupBy("entity", "other").agg(F.min("census_year").alias("census_year")).groupBy("entity", "census_year").agg(F.count(F.lit(1)).alias("fresh"))
    so_far = Window.partitionBy("entity").orderBy("census_year")
    rows = lines.join(kin, ["entity", "census_year"], "left").join(fresh, ["entity", "census_year"], "left")
    known = {f"known_{r}": F.first(r, ignorenulls=True).over(so_far) for r in RELATIONS}
    return rows.withColumns(known | {"n_children": F.coalesce("n_children", F.lit(0)), "all_children": F.sum(F.coalesce("fresh", F.lit(0))).over(so_far)}).drop("fresh")


def nested_timeline(rows: DataFrame, relations: DataFrame) -> DataFrame:
    """``entity`` and ``timeline``: year to age, race, father, mother, spouse and sorted children, and ``children``, the union over all years. A row holds one family."""
    kids = relations.where("rel = 'child'").groupBy("entity", "census_year").agg(F.array_sort(F.collect_set("other")).alias("children"))
    none = F.array().cast("array<bigint>")
    record = F.struct("age", "race", *RELATIONS, F.coalesce(F.col("children").cast("array<bigint>"), none).alias("children"))
    line = F.array_sort(F.collect_list(F.struct("census_year", record.alias("record"))))
    out = rows.join(kids, ["entity", "census_year"], "left").groupBy("entity").agg(line.alias("line"))
    union = F.array_sort(F.array_distinct(F.flatten(F.transform("line", lambda x: x["record"]["children"]))))
    return out.select("entity", F.map_from_entries("line").alias("timeline"), union.alias("children"))


def flat_nodes(about: DataFrame, family: DataFrame) -> DataFrame:
    """``id`` and a flat JSON document of each entity: name, the names of father, mother, spouse and children in place of the nodes themselves, and ``info``, its own attributes. A row holds one family."""
    names = about.select(F.col("id").alias("src"), F.col("name").alias("other"))
    up = family.join(names, "src").groupBy(F.col("dst").alias("id")).agg(*[F.max(F.when(F.col("rel") == r, F.col("other"))).alias(r) for r in RELATIONS])
    child = family.where("rel <> 'spouse'").select("src", "dst").distinct().join(about.select(F.col("id").alias("dst"), F.col("name").alias("child")), "dst")
    down = child.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dst", "child"))), lambda c: c["child"]).alias("children"))
    rows = about.join(up, "id", "left").join(down, "id", "left")
    none = F.array().cast("array<string>")
    info = F.struct(*[c for c in about.columns if c != "id"]).alias("info")
    return rows.select("id", F.to_json(F.struct("name", *RELATIONS, F.coalesce("children", none).alias("children"), info)).alias("json"))
