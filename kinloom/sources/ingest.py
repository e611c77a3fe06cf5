"""Ingest of many datasets, each apart from the others: what can't be read is reported, what is malformed is kept aside, and what was read is kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .tabular import clean_header, standardize, to_persons

_BAD = "__malformed"


@dataclass(frozen=True)
class Dataset:
    """A delimited file or folder: mapping of person fields to its columns, separator, names of the columns where it has no header, and census year."""

    path: str
    mapping: Mapping[str, str | Sequence[str | None]] = field(default_factory=dict)
    sep: str = ","
    columns: Sequence[str] | None = None
    year: int | None = None


class Ingest:
    """Person rows of named datasets, read when first asked for and kept in the shared folder.

    A dataset fails alone: an absent path, an unreadable file, or a mapping none of whose columns exist ends up in :meth:`errors`. Rows whose number of cells differs from that of the columns are no
    persons; their text is in :meth:`rejected`. Asking again reads nothing again, until :meth:`forget` was called.
    """

    def __init__(self, spark: SparkSession, datasets: Mapping[str, Dataset]):
        self.spark, self.datasets = spark, dict(datasets)
        self._rows: dict[str, DataFrame] = {}
        self._failed: dict[str, str] = {}

    def _read(self, d: Dataset) -> DataFrame:
        options = {"sep": d.sep, "multiLine": True, "escape": '"', "header": d.columns is None}
        names = list(d.columns or self.spark.read.options(**options).csv(d.path).columns)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BAD]])
        raw = self.spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=_BAD).schema(schema).csv(d.path)
        clean = standardize(raw.drop(_BAD)).columns
        wanted = {clean_header(c) for v in d.mapping.values() for c in ([v] if isinstance(v, str) else v) if c}
        if not wanted & set(clean):
            raise ValueError(f"none of the columns {sorted(wanted)} is among {clean}")
        return raw.toDF(*clean, _BAD).withColumn("ordinal", F.monotonically_increasing_id())

    def _load(self, name: str) -> DataFrame | None:
        """Rows as read, malformed ones marked; None if the dataset failed. Written before use, so that what only shows when rows are read fails here too."""
        if name not in self._rows and name not in self._failed:
            try:
                self._rows[name] = settle(self._read(self.datasets[name]), f"ingest_{name}")
            except (PySparkException, Py4JError, ValueError) as e:
                self._failed[name] = next((x for x in str(e).splitlines() if x.strip()), type(e).__name__)
        return self._rows.get(name)

    def forget(self, name: str) -> None:
        """Reads the dataset anew when it is next asked for."""
        self._rows.pop(name, None)
        self._failed.pop(name, None)

    def persons(self, name: str) -> DataFrame:
        """Person rows of one dataset; none if it failed."""
        d, rows = self.datasets[name], self._load(name)
        if rows is None:
            blank = self.spark.createDataFrame([], T.StructType([T.StructField("ordinal", T.LongType())]))
            return to_persons(blank, {}, name, d.year)
        return to_persons(rows.where(F.col(_BAD).isNull()).drop(_BAD), d.mapping, name, d.year)

    def all_persons(self) -> DataFrame:
        """Person rows of all datasets that could be read."""
        out = None
        for name in self.datasets:
            out = self.persons(name) if out is None else out.unionByName(self.persons(name))
        return out

    def rejected(self) -> DataFrame:
        """(dataset, record): the text of every malformed row."""
        out = self.spark.createDataFrame([], "dataset string, record string")
        for name in self.datasets:
            if (rows := self._load(name)) is not None:
                out = out.unionByName(rows.where(F.col(_BAD).isNotNull()).select(F.lit(name).alias("dataset"), F.col(_BAD).alias("record")))
        return out

    def errors(self) -> DataFrame:
        """(dataset, error): what could not be read, with the first line of why."""
        for name in self.datasets:
            self._load(name)
        return self.spark.createDataFrame(sorted(self._failed.items()), "dataset string, error string")
