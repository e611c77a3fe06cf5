"""Makes the library importable in Python workers, and intermediate results in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what the cluster set, or a local one where nothing is set and all runs on one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="kinloom-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the session ends."""
    path = f"{shared_dir(spark)}/kinloom/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Sends this library to the executors once for each context, unless their path already has it."""
    sc = spark.sparkContext
    if str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_kinloom_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="kinloom-")) / "kinloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    sc.addPyFile(str(path))
    sc._kinloom_shipped = True
