"""Text and JSON sources."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import normalize_grant_number, word_count
from ..functions.names import blank_to_null


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``text`` of whole files: UTF-8, or ISO-8859-1 where the bytes are no UTF-8."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1")).alias("text"))


def corpus_words(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.agg(F.coalesce(F.sum(word_count(F.col(text))), F.lit(0)).alias("words"))


def read_records(spark: SparkSession, path: str, name: str = "Grant Name", number: str = "Grant Number") -> DataFrame:
    """Records of a JSON list, or of an object of records, that have a name and a number; values as text, persons under one name."""
    whole = spark.read.text(path, wholetext=True)
    body = F.trim("value")
    listed = F.from_json(F.when(body.startswith("["), body), "array<map<string,string>>")
    keyed = F.map_values(F.from_json(F.when(body.startswith("{"), body), "map<string,map<string,string>>"))
    rows = whole.select(F.explode(F.coalesce(listed, keyed)).alias("r"))
    persons = F.coalesce(F.col("r")["Persons (entities)"], F.col("r")["Persons"])
    good = blank_to_null(F.col("r")[name]).isNotNull() & blank_to_null(F.col("r")[number]).isNotNull()
    fields = ("County", "Year", "Land Size (Acres)", "Land Size (Sq. Leagues)", "Coordinates", "Notes", "Buyer", "Seller")
    return rows.where(good).select(
        F.col("r")[name].alias(name), normalize_grant_number(F.col("r")[number]).alias(number), persons.alias("Persons (entities)"), *[F.col("r")[f].alias(f) for f in fields]
    )


def golden(df: DataFrame, number: str = "Grant Number") -> DataFrame:
    """All columns as text, null as empty, numbers without a leading mark."""
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    return out.withColumn(number, normalize_grant_number(F.col(f"`{number}`")))


TREE = "file string, root long, node long, parent long, depth int, id long, name string, race string, gender string, birth_year double, age double, spouse string, timeline string, circular boolean, children int"


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """Nested trees of JSON files as rows (file, root, node, parent, depth ...); ``root`` and ``node`` are numbered in reading order inside each file.

    A file's list is cut into its trees by the JVM and flattened one tree at a time, so a task holds the nodes of one tree. The text of a file must fit in a row.
    """

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in TREE.split(", ")]
        for batch in batches:
            for file, trees in zip(batch["file"], batch["trees"], strict=True):
                root = 0
                for text in trees:
                    rows: list[tuple] = []
                    stack = [(json.loads(text), None, 1)]
                    while stack:
                        t, parent, depth = stack.pop()
                        node = root + len(rows)
                        kids = [c for c in t.get("children") or [] if isinstance(c, dict)]
                        spouse, timeline = t.get("spouse"), t.get("timeline")
                        rows.append(
                            (file, root, node, parent, depth, t.get("id"), t.get("name"), t.get("race"), t.get("gender"), t.get("birth_year"), t.get("age"), None if spouse is None else str(spouse), None if timeline is None else json.dumps(timeline), bool(t.get("circular_reference")), len(kids))
                        )
                        stack += [(c, node, depth + 1) for c in reversed(kids)]
                    root += len(rows)
                    yield pd.DataFrame(rows, columns=names).astype({"parent": "Int64", "id": "Int64", "birth_year": "float64", "age": "float64"})

    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("value"))
    trees = F.when(F.col("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return whole.select("file", trees.alias("trees")).mapInPandas(flatten, TREE)
