"""Entity resolution into a family graph, and recursive tree metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..session import scratch, settle
from .components import components
from .linkage import name_pairs

# Limits of the compatibility rules.
NAME_LIMIT, SPOUSE_LIMIT, BIRTH_SLACK = 2, 3, 5
PARENT_YOUNGEST, PARENT_OLDEST, SPOUSE_GAP = 13, 60, 25


def _both(a: Column, b: Column, rule: Column) -> Column:
    """The rule where both sides are known, else true."""
    return F.when(a.isNull() | b.isNull(), True).otherwise(rule)


def compatible(a: str, b: str) -> Column:
    """Whether the nodes under prefixes ``a`` and ``b`` agree on birth year, gender, race and spouse; cheap rules first."""
    c = lambda p, f: F.col(f"{p}{f}")
    races = c(a, "race").contains(";") | c(b, "race").contains(";") | (c(a, "race") == c(b, "race"))
    return (
        _both(c(a, "birth_year"), c(b, "birth_year"), F.abs(c(a, "birth_year") - c(b, "birth_year")) <= BIRTH_SLACK)
        & _both(c(a, "gender"), c(b, "gender"), c(a, "gender") == c(b, "gender"))
        & _both(c(a, "race"), c(b, "race"), races)
        & _both(c(a, "spouse"), c(b, "spouse"), N.within(c(a, "spouse"), c(b, "spouse"), SPOUSE_LIMIT))
    )


FIELDS = ("gender", "race", "birth_year", "spouse")


def classes(nodes: DataFrame) -> DataFrame:
    """One node, that of the smallest id, for all of equal name and attributes."""
    return nodes.groupBy("name", *FIELDS).agg(F.min("id").alias("id"))


def compatible_pairs(a: DataFrame, b: DataFrame, k: int = NAME_LIMIT) -> DataFrame:
    """(a_id, b_id, distance) of compatible nodes of two tables with names within ``k``.

    Namesakes are not compared all with all. Two known spouses must be near, so such pairs meet on both names. Where a spouse is unknown, two known
    years of birth must be near, so these meet on the name and a band of years: bands are one year wider than the slack, and each node looks into three. Only nodes without
    spouse and year meet all their namesakes, and of those there are few once equal nodes are one.
    """
    near = name_pairs(a, b, "name", "name", k).toDF("a_name", "b_name", "distance")
    spouses = name_pairs(a, b, "spouse", "spouse", SPOUSE_LIMIT).select(F.col("l").alias("a_spouse"), F.col("r").alias("b_spouse"))
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in ("id", "name", *FIELDS)])
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in ("id", "name", *FIELDS)])
    band = lambda y: F.floor(y / (BIRTH_SLACK + 1))
    around = lambda kind: F.transform(F.sequence(band(F.col("a_birth_year")) - 1, band(F.col("a_birth_year")) + 1), lambda k: F.concat(F.lit(kind), k.cast("string")))
    own = lambda kind, when, key=F.lit(""): F.when(when, F.concat(F.lit(kind), key))
    free, year = F.col("a_spouse").isNull(), F.col("a_birth_year").isNotNull()
    # Each pair has one way to meet: by spouses if both are known; else by the left one's lack of a spouse, or by the right one's, each with both years known, the left one unknown or only the right one.
    ways = F.when(free & year, F.concat(around("free:"), F.array(F.lit("free, no year right")))).when(free, F.array(F.lit("free, no year left")))
    ways = ways.when(year, F.concat(around("tied:"), F.array(F.lit("tied, no year right")))).otherwise(F.array(F.lit("tied, no year left")))
    left = left.withColumn("way", F.explode(ways)).unionByName(left.join(spouses, "a_spouse").withColumn("way", F.concat(F.lit("spouse:"), "b_spouse")).drop("b_spouse"))
    free, year = F.col("b_spouse").isNull(), F.col("b_birth_year").isNotNull()
    place = band(F.col("b_birth_year")).cast("string")
    taken = F.array(
        own("free:", year, place), own("free, no year right", ~year), own("free, no year left", F.lit(True)),
        own("tied:", free & year, place), own("tied, no year right", free & ~year), own("tied, no year left", free), own("spouse:", ~free, F.col("b_spouse")),
    )
    right = right.withColumn("way", F.explode(F.array_compact(taken)))
    return left.join(near, "a_name").join(right, ["b_name", "way"]).where(compatible("a_", "b_")).select("a_id", "b_id", "distance")


def node_edges(nodes: DataFrame, k: int = NAME_LIMIT) -> DataFrame:
    """(u, v) edges that join what compatible nodes with names within ``k`` join: equal nodes through the one of the smallest id, and compatible pairs of unequal ones.

    nodes: id, name, gender, race, birth_year, spouse.
    """
    one = settle(classes(nodes), "classes")
    same = nodes.select("id", "name", *FIELDS).join(one.withColumnRenamed("id", "v").toDF(*[f"o_{c}" for c in ("name", *FIELDS)], "v"), F.expr(" AND ".join(f"{c} <=> o_{c}" for c in ("name", *FIELDS))))
    copies = same.where("id <> v").select(F.col("id").alias("u"), "v")
    return copies.unionByName(compatible_pairs(one, one, k).where("a_id < b_id").select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))


def resolve(nodes: DataFrame, k: int = NAME_LIMIT) -> DataFrame:
    """``id`` and ``entity`` of every node: the smallest id of its component."""
    roots = components(node_edges(nodes, k))
    return nodes.select("id").join(roots, nodes.id == roots.node, "left").select("id", F.coalesce("root", "id").alias("entity"))


def integrate(censuses: Sequence[tuple[int | None, DataFrame]], k: int = NAME_LIMIT) -> DataFrame:
    """``id`` and ``entity`` of the nodes of several censuses (year, nodes), joined one census after the other in order of year, an unknown year first.

    Each node joins the compatible entity nearest in name (then of the smallest id) among those so far, or founds one. An entity keeps
    its founder's name and takes what attributes it lacks from the node of the smallest id that joins it in a census. Nodes have distinct
    ids: id, name, gender, race, birth_year, spouse. The loop is over censuses, a handful; each step is a set of joins.
    """
    fields = FIELDS
    base = placed = None
    for _, nodes in sorted(censuses, key=lambda c: c[0] or 0):
        nodes = nodes.select("id", "name", *fields)
        if base is None:
            placed, base = nodes.select("id", F.col("id").alias("entity")), settle(nodes, "entities")
            continue
        ours = settle(classes(nodes), "classes")
        pairs = compatible_pairs(ours, classes(base), k)
        best = pairs.groupBy(F.col("a_id").alias("id")).agg(F.min(F.struct("distance", "b_id")).alias("m")).select("id", F.col("m.b_id").alias("entity"))
        best = ours.join(best, "id").select("entity", *[F.col(c).alias(f"o_{c}") for c in ("name", *fields)])
        best = nodes.join(best, F.expr(" AND ".join(f"{c} <=> o_{c}" for c in ("name", *fields)))).select("id", "entity")
        found = settle(nodes.join(best, "id", "left"), "joined")
        gains = found.where("entity is not null").groupBy("entity").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"new_{c}") for c in fields])
        kept = base.join(gains, base.id == gains.entity, "left").select("id", "name", *[F.coalesce(c, f"new_{c}").alias(c) for c in fields])
        base = settle(kept.unionByName(found.where("entity is null").drop("entity")), "entities")
        placed = placed.unionByName(found.select("id", F.coalesce("entity", "id").alias("entity")))
    return placed


def merge_nodes(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """One row for each entity: the alternatives of every attribute, and a timeline of one record for each census year."""
    joined = nodes.join(entities, "id")
    first = Window.partitionBy("entity", "census_year").orderBy("id")
    line = joined.where("census_year is not null").withColumn("rank", F.row_number().over(first)).where("rank = 1")
    line = line.groupBy("entity").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("census_year", F.struct("age", "race"))))).alias("timeline"), F.avg(F.col("census_year") - F.col("age")).alias("mean_birth_year")
    )
    sets = joined.groupBy("entity").agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("name", "gender", "race", "father", "mother", "spouse")], F.avg("birth_year").alias("given_birth_year"))
    return sets.join(line, "entity", "left").withColumn("birth_year", F.coalesce("mean_birth_year", "given_birth_year")).drop("mean_birth_year", "given_birth_year")


def estimated_birth_year(birth_year: Column, of_1821: Column, latest_year: Column, latest_age: Column) -> Column:
    return F.coalesce(birth_year, of_1821, latest_year - latest_age)


def birth_year_of_timeline(birth_year: Column, timeline: Column, given_in: int = 1821) -> Column:
    """The year of birth given, else that recorded in the census of ``given_in``, else the latest census with an age less that age; timeline: map of year to a struct with ``age`` and perhaps ``birth_year``."""
    entries = F.filter(F.map_entries(timeline), lambda e: e["value"]["age"].isNotNull())
    latest = F.array_max(F.transform(entries, lambda e: F.struct(e["key"].alias("year"), e["value"]["age"].alias("age"))))
    recorded = F.try_element_at(timeline, F.lit(given_in))["birth_year"]
    return estimated_birth_year(F.nullif(birth_year, F.lit(0.0)), recorded, latest["year"], latest["age"])


def valid_parent_child(parent: str, child: str) -> Column:
    """Names differ; 13 to 60 years between births, or else 13 years between census ages; unknown is accepted."""
    c = lambda p, f: F.col(f"{p}{f}")
    gap = c(child, "birth_year") - c(parent, "birth_year")
    born = F.when(gap.isNotNull(), gap.between(PARENT_YOUNGEST, PARENT_OLDEST))
    aged = F.when(c(parent, "age").isNotNull() & c(child, "age").isNotNull(), c(parent, "age") >= c(child, "age") + PARENT_YOUNGEST)
    return (c(parent, "name") != c(child, "name")) & F.coalesce(born, aged, F.lit(True))


def valid_spouses(a: str, b: str) -> Column:
    """Genders differ and births are 25 years apart at most, where known."""
    c = lambda p, f: F.col(f"{p}{f}")
    return _both(c(a, "gender"), c(b, "gender"), c(a, "gender") != c(b, "gender")) & _both(c(a, "birth_year"), c(b, "birth_year"), F.abs(c(a, "birth_year") - c(b, "birth_year")) <= SPOUSE_GAP)


def valid_child_surname(parent: Column, child: Column) -> Column:
    """Whether a child's surname fits a parent's; a missing name and a name of one token fit.

    A token of the child is within two edits of the parent's last one; or, for a child of three tokens or more,
    its paternal surname (the last but one) is within two of the parent's (which is the last where there is one surname only).
    """
    own, other = (F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+") for c in (child, parent))
    near = lambda x, y: N.weighted_distance(x, y) <= NAME_LIMIT
    last = F.element_at(other, -1)
    paternal = F.when(F.size(other) > 2, F.try_element_at(other, F.lit(-2))).otherwise(last)
    by_paternal = F.when(F.size(own) > 2, near(F.try_element_at(own, F.lit(-2)), paternal)).otherwise(False)
    return F.when((F.size(own) < 2) | (F.size(other) < 2), True).otherwise(F.exists(own, lambda t: near(t, last)) | by_paternal)


def cross_census(left: DataFrame, right: DataFrame, years: int) -> DataFrame:
    """Scored matches of persons in two censuses ``years`` apart, best first for each left person.

    Accepted within two edits, or three with a fitting age or spouse; score = distance + 5 without age + 3 if spouses are known and differ.
    Both sides: id, name, age, spouse.
    """
    near = name_pairs(left, right, "name", "name", 3)
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    pairs = a.join(near, F.col("a_name") == F.col("l")).join(b, F.col("b_name") == F.col("r"))
    age = F.coalesce(F.abs(F.col("a_age") + years - F.col("b_age")) <= min(3, years / 2), F.lit(False))
    known = F.col("a_spouse").isNotNull() & F.col("b_spouse").isNotNull()
    family = F.when(known, N.within(F.col("a_spouse"), F.col("b_spouse"), 2)).otherwise(False)
    pairs = pairs.withColumns({"age_fits": age, "family_fits": family})
    ok = (F.col("distance") <= 2) | ((F.col("distance") <= 3) & (F.col("age_fits") | F.col("family_fits")))
    score = F.col("distance") + F.when(F.col("age_fits"), 0).otherwise(5) + F.when(~F.col("family_fits") & known, 3).otherwise(0)
    out = pairs.where(ok).withColumn("score", score.cast("long"))
    rank = F.row_number().over(Window.partitionBy("a_id").orderBy("score", "b_id"))
    return out.select("a_id", "b_id", F.col("distance").cast("long").alias("distance"), "age_fits", "family_fits", "score", rank.cast("long").alias("rank"))


def find_or_create(wanted: DataFrame, nodes: DataFrame, k: int = NAME_LIMIT) -> DataFrame:
    """For each wanted name the node of that name, else the nearest within ``k`` (distance, then id), else null and ``created``."""
    names = wanted.select("name").distinct()
    own = nodes.groupBy("name").agg(F.min("id").alias("id"))
    exact = names.join(own, "name")
    rest = names.join(own, "name", "left_anti")
    near = name_pairs(rest, own, "name", "name", k).join(own, F.col("r") == own["name"]).select(F.col("l").alias("name"), "distance", "id")
    best = near.groupBy("name").agg(F.min(F.struct("distance", "id")).alias("m")).select("name", F.col("m.id").alias("id"))
    fuzzy = rest.join(best, "name", "left")
    return exact.unionByName(fuzzy).withColumn("created", F.col("id").isNull())


def link_relationships(persons: DataFrame, k: int = NAME_LIMIT) -> DataFrame:
    """Edges (src, dst, rel) between person ids: parents and spouses by name, without self references, validated; spouse edges run both ways.

    persons: id, name, father, mother, spouse, gender, birth_year, age.
    """
    parts = []
    for rel in ("father", "mother", "spouse"):
        refs = persons.where(F.col(rel).isNotNull() & (F.col(rel) != F.col("name")))
        found = find_or_create(refs.select(F.col(rel).alias("name")), persons, k).where("not created").toDF("ref", "target", "created").drop("created")
        other = persons.select(F.col("id").alias("target"), *[F.col(c).alias(f"p_{c}") for c in ("name", "gender", "birth_year", "age")])
        me = refs.select("id", F.col(rel).alias("ref"), *[F.col(c).alias(f"c_{c}") for c in ("name", "gender", "birth_year", "age")])
        pairs = me.join(found, "ref").join(other, "target").where("id <> target")
        if rel == "spouse":
            ok = pairs.where(valid_spouses("p_", "c_"))
            parts += [ok.select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit(rel).alias("rel")), ok.select(F.col("target").alias("src"), F.col("id").alias("dst"), F.lit(rel).alias("rel"))]
        else:
            parts.append(pairs.where(valid_parent_child("p_", "c_")).select(F.col("target").alias("src"), F.col("id").alias("dst"), F.lit(rel).alias("rel")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (root, node, parent, depth, path, circular) of the trees under ``roots`` (column ``id``).

    A node that its own path already holds ends the path as a circular reference, so every path ends. Levels
    are joins, each written beside the others to one folder of the shared one, until a level is empty: the result is one scan at any depth.
    """
    spark = edges.sparkSession
    edges = settle(edges.select(F.col("src").cast("long").alias("from"), F.col("dst").cast("long").alias("to")).distinct(), "edges")
    own = F.col("id").cast("long")
    level = roots.select(own.alias("root"), own.alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(1).alias("depth"), F.array(own).alias("path"), F.lit(False).alias("circular"))
    base, k = scratch(spark, "closure"), 1
    schema = level.schema
    while True:
        level.write.parquet(f"{base}/level={k}")
        done = spark.read.schema(schema).parquet(f"{base}/level={k}")
        if done.isEmpty():
            return spark.read.schema(schema).parquet(base)
        k += 1
        level = done.where("not circular").join(edges, F.col("node") == F.col("from")).select(
            "root", F.col("to").alias("node"), F.col("from").alias("parent"), F.lit(k).alias("depth"),
            F.concat("path", F.array("to")).alias("path"), F.array_contains("path", F.col("to")).alias("circular"),
        )


def tree_metrics(tree: DataFrame) -> DataFrame:
    """One row of numbers over trees (root, node, depth, age), circular references left out."""
    one = tree.where("not circular").groupBy("root").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("nodes"))
    whole = one.agg(
        F.count(F.lit(1)).alias("total_trees"), F.avg("depth").alias("average_depth"), F.min("depth").cast("long").alias("shortest_tree"),
        F.avg("nodes").alias("average_number_of_nodes"), F.max("nodes").alias("highest_number_of_nodes"), F.avg(F.col("nodes") - 1).alias("average_number_of_children"),
    )
    oldest = tree.where("not circular").agg(F.max("age").alias("oldest_node_age"))
    return whole.crossJoin(oldest)


def at_least_age(tree: DataFrame, least: float) -> DataFrame:
    """Flattened nodes of that age or more."""
    return tree.where(F.col("age") >= least)


def roots_of(persons: DataFrame, edges: DataFrame, parents: Sequence[str] = ("father", "mother")) -> DataFrame:
    """Persons that no parent edge reaches."""
    return persons.join(edges.where(F.col("rel").isin(*parents)).select(F.col("dst").alias("id")), "id", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """``src`` and its sorted distinct ``children``."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("children"))


def _json_number(c: str) -> Column:
    """``"c":number`` of a column of doubles, null where it is null: from ten million on, where Spark would write 1.0E7, in plain digits, and from 1e16 on with an exponent, as SQL casts it."""
    text, size = F.col(c).cast("string"), F.abs(c)
    plain = F.regexp_replace(F.regexp_replace(text.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    number = F.when(size >= 1e16, F.regexp_replace(text, r"(\.0)?E", "e+")).otherwise(plain)
    return F.when((size >= 1e7) & (size < float("inf")), F.concat(F.lit(f'"{c}":'), number)).otherwise(_json_field(F.col(c)))


def _json_field(c: Column) -> Column:
    """The column with its name as in JSON; null where it is null."""
    whole = F.to_json(F.struct(c))
    return F.nullif(F.substring(whole, F.lit(2), F.length(whole) - 2), F.lit(""))


def tree_json(tree: DataFrame, persons: DataFrame) -> DataFrame:
    """``root`` and the nested JSON of its tree; a tree is assembled level by level from the leaves, so a row holds one subtree."""
    info = persons.select(F.col("id").alias("node"), *[c for c in ("name", "race", "gender", "birth_year", "timeline", "spouse", "age") if c in persons.columns])
    rows = tree.join(info, "node").withColumn("key", F.array_join("path", "/")).withColumn("up", F.array_join(F.slice("path", F.lit(1), F.size("path") - 1), "/"))
    top = rows.agg(F.max("depth")).first()[0] or 0
    below = None
    for k in range(top, 0, -1):
        level = rows.where(F.col("depth") == k)
        level = level.join(below, level.key == below.under, "left") if below is not None else level.withColumn("kids", F.lit("[]"))
        fields = [_json_number(c) if kind == "double" else _json_field(F.col(c)) for c, kind in info.dtypes if c != "node"]
        own = F.concat_ws(",", _json_field(F.col("node").alias("id")), *fields)
        body = F.concat(F.lit("{"), own, F.lit(',"children":'), F.coalesce("kids", F.lit("[]")), F.lit("}"))
        cycle = F.to_json(F.struct(F.col("node").alias("id"), "name", F.lit(True).alias("circular_reference")))
        made = level.withColumn("json", F.when(F.col("circular"), cycle).otherwise(body))
        if k == 1:
            return made.select("root", "json")
        # Written at every level: a plan of all levels would grow with the depth.
        below = made.groupBy(F.col("up").alias("under")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "json"))), lambda s: s["json"]), ","), F.lit("]")).alias("kids"))
        below = settle(below, "subtrees")
    return rows.select("root", F.lit("{}").alias("json"))
