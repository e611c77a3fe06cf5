"""Sinks: delimited files, key-value metrics, JSON documents and separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the line between entries of a grant file.
RULE = "-" * 80


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, escape='"')


def write_matches(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def as_metrics(df: DataFrame) -> DataFrame:
    """One row of numbers as (Metric, Value) rows."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in df.columns)
    return df.select(F.expr(f"stack({len(df.columns)}, {pairs}) as (Metric, Value)"))


def write_metrics(df: DataFrame, path: str) -> None:
    write_csv(as_metrics(df), path, single=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON document for each row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def pretty(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value"))


def entries_text(grants: DataFrame, *keys: str) -> DataFrame:
    """Grants in the separated text form that :func:`kinloom.operators.extract.parse_entries` reads, with the columns ``keys``."""
    head = F.concat(F.lit("Grant Name: "), F.col("name"), F.lit(", Grant Number: "), F.col("number").cast("string"))
    return grants.select(*keys, F.concat_ws("\n", head, F.concat(F.lit("Description: "), F.col("description")), F.lit(RULE)).alias("value"))


def write_entries(grants: DataFrame, path: str) -> None:
    entries_text(grants).write.mode("overwrite").text(path)
