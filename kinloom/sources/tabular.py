"""Delimited files with drifting headers, and schema mappings."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import blank_to_null, safe_int
from ..session import settle

#: Canonical person fields.
FIELDS = ("name", "race", "gender", "father", "mother", "spouse", "age")


def clean_header(name: str) -> str:
    """Without byte-order mark, outer white space and blanks after an underscore; lower case; blanks collapsed."""
    return re.sub(r"_ ", "_", re.sub(r"\s+", " ", name.lstrip("﻿").strip())).lower()


def standardize(df: DataFrame) -> DataFrame:
    """Cleaned headers; a header that repeats gets its position appended."""
    seen: set[str] = set()
    out = []
    for k, c in enumerate(df.columns):
        c = clean_header(c) or f"column {k}"
        out.append(f"{c} {k}" if c in seen else c)
        seen.add(out[-1])
    return df.toDF(*out)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", clean: bool = True, ordinal: bool = True) -> DataFrame:
    """All columns as text; cells may hold line ends; ``ordinal`` is the row's place in the file."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = standardize(df) if clean else df
    return df.withColumn("ordinal", F.monotonically_increasing_id()) if ordinal else df


def read_csv(spark: SparkSession, path: str, **more) -> DataFrame:
    return read_delimited(spark, path, ",", **more)


def read_tsv(spark: SparkSession, path: str, **more) -> DataFrame:
    return read_delimited(spark, path, "\t", **more)


def catalog(spark: SparkSession, paths: Mapping[str, str], views: bool = True) -> dict[str, DataFrame]:
    """Named frames, lazily read, each also a temporary view. A path that can't be read fails that name only when it is used."""
    out = {}
    for name, path in paths.items():
        out[name] = read_tsv(spark, path) if path.endswith((".tsv", ".txt")) else read_csv(spark, path)
        if views:
            out[name].createOrReplaceTempView(name)
    return out


def drop_blank_rows(df: DataFrame, keep: Sequence[str] = ("ordinal",)) -> DataFrame:
    """Without rows whose every column (but ``keep``) is null or white."""
    filled = [F.coalesce(blank_to_null(F.col(f"`{c}`").cast("string")).isNotNull(), F.lit(False)) for c in df.columns if c not in keep]
    some = filled[0]
    for f in filled[1:]:
        some = some | f
    return df.where(some)


def add_identifiers(df: DataFrame, column: str, order: Sequence[str] = ("ordinal",), whole: bool = False) -> DataFrame:
    """``column`` numbers rows from 1 in the given order.

    Rows are range-partitioned by the order, sorted and numbered inside each partition, and shifted by the sizes of
    the partitions before, so no partition holds all rows. The placed rows are written once: bounds of ranges come from a sample, and a second run may draw
    others, so sizes taken from it would not be those of the numbered partitions. ``whole`` numbers by one global window, for small tables.
    """
    if whole:
        return df.withColumn(column, F.row_number().over(Window.orderBy(*order)).cast("long"))
    placed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    parts = placed.withColumns({"__part": F.shiftright("__at", 33), "__row": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1})
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    shift = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return parts.join(F.broadcast(shift), "__part").withColumn(column, F.col("__row") + F.col("__before")).drop("__at", "__part", "__row", "__before")


def ensure_column(df: DataFrame, name: str, kind: str = "double") -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def id_column(dataset: str) -> str:
    return "ecpp_id" if "padron" in dataset or "census" in dataset else "#ID"


def last_name(df: DataFrame, paternal: str, maternal: str, out: str, null_propagating: bool = False) -> DataFrame:
    """Both surnames joined; without ``null_propagating`` two nulls give an empty text."""
    p, m = F.col(f"`{paternal}`"), F.col(f"`{maternal}`")
    return df.withColumn(out, F.concat(p, F.lit(" "), m) if null_propagating else F.trim(F.concat_ws(" ", blank_to_null(p), blank_to_null(m))))


def _field(df: DataFrame, source: str | Sequence[str | None] | None) -> Column:
    names = [source] if isinstance(source, str) or source is None else list(source)
    names = [clean_header(n) for n in names if n]
    have = [F.trim(F.col(f"`{n}`")) for n in names if n in df.columns]
    return blank_to_null(F.concat_ws(" ", *have)) if have else F.lit(None).cast("string")


def to_persons(df: DataFrame, mapping: Mapping[str, str | Sequence[str | None]], dataset: str | None = None, year: int | None = None) -> DataFrame:
    """Canonical person rows from cleaned columns; list entries of the mapping are joined with a blank; blank results are null; age is an integer or null."""
    cols = [(_field(df, mapping.get(f)) if f != "age" else safe_int(_field(df, mapping.get(f)))).alias(f) for f in FIELDS]
    extra = [F.col("ordinal")] if "ordinal" in df.columns else []
    return df.select(*cols, F.lit(dataset).cast("string").alias("dataset"), F.lit(year).cast("int").alias("census_year"), *extra)
