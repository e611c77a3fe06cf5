"""The corpus pipeline: five stages from raw documents to a training mix.

1. ``language_id`` drops documents whose language can't be told;
2. ``line_dedup`` takes the boilerplate lines of a source out of its documents;
3. ``near_dedup`` keeps one document, that of the smallest id, of each near-duplicate group;
4. ``decontamination`` drops documents that contain a benchmark passage;
5. ``mixing`` gives the surviving documents to training passes by source weight and sorts them by training position.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; :func:`run` writes each stage's result as Parquet
in the shared folder and reads it again. The first four return the columns of ``documents``; the last one adds ``epoch``, ``taken`` and ``position``,
in place of columns of these names.

Null texts and texts without letters leave in the first stage. Rows that repeat a doc_id go or stay together in ``near_dedup``, and are judged each for itself
in the other filters. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinloom.llm import decontam, langid, lines, minhash, mixing
from kinloom.llm.common import settle, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_language(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.clean_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
]

#: Language identification and the MinHash stage are not SQL. Tests hold the stages, on planted cases, against what brute force keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
