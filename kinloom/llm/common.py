"""Shared helpers: table access and lineage cuts in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster set, or a local one where nothing is set and all runs on one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="kinloom-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a scan of it.

    This cuts the lineage, so that a lost executor costs one scan and not the whole
    job so far, and it gives the next plan a measured size. Files go when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (the split used for held-out rows)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def fresh(*frames: DataFrame) -> str:
    """A prefix that no column of the frames begins with, whatever the case of its letters."""
    prefix = "__"
    while any(c.startswith(prefix) for df in frames for c in df.columns):
        prefix += "_"
    return prefix


#: Scripts written without blanks between words.
SOLID_SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"


def plain_words(text: Column) -> Column:
    """``text`` so that its tokens are runs of anything but ASCII other than letters and digits: in lower case by Unicode, with blanks for all but letters, marks and digits,
    and each character of a script without blanks as a word of its own. ASCII texts stay as they are."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")
    words = F.when(words.rlike(f"[{SOLID_SCRIPTS}]"), F.regexp_replace(words, f"([{SOLID_SCRIPTS}])", " $1 ")).otherwise(words)
    return F.when(text.rlike(r"[^\x00-\x7F]"), words).otherwise(text)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: A DuckDB table ``crc`` with the 256 remainders of CRC-32 as one list ``t``.
SQL_CRC = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def sql_crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB SQL, beside the table of SQL_CRC."""
    bits = f"hex(encode({text}))"
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr({bits}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295)"
