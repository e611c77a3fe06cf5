"""Family units: people with looked-up spouses, parents and children as nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import blank_to_null, space_commas
from ..sources.tabular import add_identifiers


def full_name(first: Column, last: Column) -> Column:
    """Both names joined where both are known, else null."""
    a, b = blank_to_null(first), blank_to_null(last)
    return F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" "), b))


def children_of(columns: Sequence[str]) -> Column:
    """Non-blank child columns in order."""
    return F.filter(F.array(*[blank_to_null(F.col(f"`{c}`")) for c in columns]), lambda x: x.isNotNull())


def family_units(people: DataFrame, census: DataFrame, baptisms: DataFrame, children: Sequence[str]) -> DataFrame:
    """One unit (``fid``) for each matched person, with nested ``members``; ids of persons in a unit follow their place: person, spouse, parents.

    people: ecpp_id, id (baptism), name, sex, race, ethnicity, baptismal_date, match_prob. census: ecpp_id, spouse_first, spouse_last and child columns.
    baptisms: id, father_first, father_last, mother_first, mother_last.
    """
    c = census.select("ecpp_id", full_name(F.col("spouse_first"), F.col("spouse_last")).alias("spouse"), children_of(children).alias("kids"))
    b = baptisms.select("id", full_name(F.col("father_first"), F.col("father_last")).alias("father"), full_name(F.col("mother_first"), F.col("mother_last")).alias("mother"))
    joined = people.join(c, "ecpp_id", "left").join(b, "id", "left")
    parents = F.array_distinct(F.filter(F.array("father", "mother"), lambda x: x.isNotNull()))
    member = F.struct(
        F.lit(1).alias("pid"), "name", "sex", space_commas(F.col("race")).alias("race"), "ethnicity", "baptismal_date", "match_prob",
        F.array_distinct(F.coalesce("kids", F.array().cast("array<string>"))).alias("potential_children"), F.col("spouse").alias("potential_spouse"), parents.alias("potential_parents"),
    )
    out = joined.select(F.col("ecpp_id").alias("__e"), F.col("id").alias("__i"), F.array(member).alias("members"))
    return add_identifiers(out, "fid", ("__e", "__i")).select("fid", "members")


def units_by_household(persons: DataFrame, household: str, name: str = "name", order: str = "id") -> DataFrame:
    """Distinct members of each household as a sorted list of structs."""
    member = F.struct(F.col(order).alias("pid"), F.col(name).alias("name"))
    return persons.groupBy(household).agg(F.array_sort(F.array_distinct(F.collect_list(member))).alias("members"))
