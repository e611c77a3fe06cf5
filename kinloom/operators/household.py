"""Households in a record list, as gaps and islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import blank_to_null


def group_households(records: DataFrame, order: Sequence[str], within: Sequence[str], name: str = "name", father: str = "father", mother: str = "mother") -> DataFrame:
    """``records`` of two name tokens or more, with ``surname`` and ``household`` (from 0 in each list).

    ``within`` are the columns that tell lists apart (dataset, page); lists are worked on in parallel, and only a list's own order counts. A record without
    parents that is not the first of its list is a candidate; a candidate opens a household if it is the first or its
    surname differs from that of the candidate before.
    """
    tokens = F.filter(F.split(F.trim(F.col(name)), r"\s+"), lambda t: t != "")
    kept = records.withColumn("surname", F.when(F.size(tokens) >= 2, F.element_at(tokens, -1))).where("surname is not null")
    run = Window.partitionBy(*within).orderBy(*order)
    orphan = blank_to_null(F.col(father)).isNull() & blank_to_null(F.col(mother)).isNull()
    kept = kept.withColumn("__candidate", orphan & (F.row_number().over(run) > 1))
    before = F.last(F.when(F.col("__candidate"), F.col("surname")), ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("__break", F.when(F.col("__candidate") & (before.isNull() | (before != F.col("surname"))), 1).otherwise(0))
    return kept.withColumn("household", F.sum("__break").over(run.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__candidate", "__break")
