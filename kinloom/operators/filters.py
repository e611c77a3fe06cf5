"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: terms for people of African descent in the censuses.
RACE_TERMS = (
    "negro", "negra", "mulato", "mulata", "moreno", "morena", "color quebrado", "color quebrada",
    "pardo", "parda", "morizco", "morizca", "prieto", "prieta", "triguñeo", "triguñea",
)


def any_term(df: DataFrame, column: str, terms: Sequence[str] = RACE_TERMS) -> DataFrame:
    """Rows whose column holds one of the terms, in any case; null does not."""
    return df.where(F.coalesce(F.col(column).rlike("(?iu)" + "|".join(terms)), F.lit(False)))


def above(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Rows with a score strictly above the threshold."""
    return df.where(F.col(score) > threshold)


def split_by_sex(df: DataFrame, sex: str) -> tuple[DataFrame, DataFrame]:
    """Male rows and female rows."""
    s = F.lower(F.trim(F.col(sex)))
    return df.where(s == "m"), df.where(s == "f")


def at_most_age(df: DataFrame, age: str, most: float) -> DataFrame:
    return df.where(F.col(age) <= most)


def named(df: DataFrame, name: str = "name") -> DataFrame:
    return df.where(F.col(name).isNotNull() & (F.trim(F.col(name)) != ""))


def matched_rows(rows: DataFrame, matches: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Rows that some match names, each once; ``keys`` maps columns of ``rows`` to those of ``matches``."""
    on = [F.col(f"`{a}`").eqNullSafe(F.col(f"`__{b}`")) for a, b in keys.items()]
    return rows.join(matches.select(*[F.col(f"`{b}`").alias(f"__{b}") for b in keys.values()]), on, "left_semi")
