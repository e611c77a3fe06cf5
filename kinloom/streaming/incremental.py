"""Incremental linkage: a stream of records against a fixed set of names, or against the names seen earlier in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import names as N
from ..operators.linkage import name_pairs


def link_stream(records: DataFrame, known: DataFrame, name: str = "name", k: int = 2) -> DataFrame:
    """Each record of a stream (or table) with known names within ``k`` edits, and their distance.

    A table goes through its distinct names. A stream, whose names can't be made distinct without state, joins the known names on pieces without any: of the pieces
    that a pair shares, the first of the known name's gives it, so no pair comes twice.
    """
    fixed = known.select(F.col("name").alias("known")).where("known is not null").distinct()
    if not records.isStreaming:
        near = name_pairs(records, fixed, name, "known", k).toDF("__name", "known", "distance")
        return records.join(near, F.col(name) == F.col("__name")).drop("__name")
    own = fixed.withColumn("__own", N.own_keys(F.col("known"), k)).withColumn("__key", F.explode(F.array_distinct("__own")))
    probe = records.withColumn("__probe", N.probe_keys(F.col(name), k)).withColumn("__key", F.explode("__probe"))
    met = probe.join(own, "__key").where(F.col("__key") == F.get(F.filter("__own", lambda x: F.array_contains("__probe", x)), F.lit(0)))
    near = met.where(F.levenshtein(N.canon(F.col(name)), N.canon(F.col("known")), k) >= 0).drop("__key", "__own", "__probe")
    return near.withColumn("distance", N.weighted_distance(F.col(name), F.col("known"))).where(F.col("distance") <= k)


def _first_shared(plain: str, known: str, k: int) -> str | None:
    """The first piece key of ``known`` that :func:`N.probe_keys` gives for ``plain``; both in canonical letters."""
    n, m = len(plain), len(known)
    for i in range(k + 1):
        low, high = m * i // (k + 1), m * (i + 1) // (k + 1)
        size = high - low
        first, last = max(0, low + -(-(n - m - k) // 2)), min(low + (n - m + k) // 2, n - size)
        if any(plain[at : at + size] == known[low:high] for at in range(first, last + 1)):
            return f"{m}:{i}:{known[low:high]}"
    return None


def _gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each name of a piece of the input, with the ids of its records there."""
    for f in frames:
        if len(f):
            yield f.groupby("name", sort=False)["id"].agg(list).rename("ids").reset_index()


_MET = "name string, known_id long, known string, distance int, ids array<long>"


class _Seen(StatefulProcessor):
    """For one piece: the names that own it, each with the id that first brought it. Records probe what is there before them; names that are new are left behind.

    Rows hold the ids of several records of one name, so that each two names are compared once in a batch.
    """

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "name string", "id long")

    def _near(self, name: str, known: str, piece: str) -> int | None:
        """Their distance, if it is within the limit and this is the first piece that they share."""
        canon = str.maketrans(N.CLASS_FROM, N.CLASS_TO)
        if abs(len(known) - len(name)) > self.k or _first_shared(name.translate(canon), known.translate(canon), self.k) != piece:
            return None
        distance = N._dp(name, known)
        return distance if distance <= self.k else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        seen = {x[0]: y[0] for x, y in self.names.iterator()}
        new: dict[str, int] = {}
        probes = []
        for batch in rows:
            for name, ids, own in zip(batch["name"], batch["ids"], batch["own"], strict=True):
                ids = np.asarray(ids, dtype=np.int64)
                if not own:
                    probes.append((name, ids))
                elif name not in seen:
                    new[name] = min(new.get(name, ids[0]), ids[0])
        for name, first in new.items():
            self.names.updateValue((name,), (int(first),))
        near: dict[str, list] = {}
        out = []
        for name, ids in probes:
            if name not in near:
                both = [(x, int(n), self._near(name, x, key[0]), fresh) for known, fresh in ((seen, False), (new, True)) for x, n in known.items()]
                near[name] = [x for x in both if x[2] is not None]
            for known, known_id, distance, fresh in near[name]:
                after = ids[ids > known_id] if fresh else ids[ids != known_id]
                if len(after):
                    out.append((name, known_id, known, distance, after))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["name", "known_id", "known", "distance", "ids"])
                out = []
        yield pd.DataFrame(out, columns=["name", "known_id", "known", "distance", "ids"])

    def close(self) -> None:
        pass


def link_seen(records: DataFrame, k: int = 2) -> DataFrame:
    """Each record (id, name) of a stream with the distinct names within ``k`` edits that were seen before it: (id, name, known_id, known, distance).

    A name gets the id of the record that first brings it. Records count as seen in the order of batches, and inside a batch in that of ids; so with ids that rise from batch to batch the result does not depend on how the
    stream was cut, and equals :func:`link_earlier` over all records. State is kept by name piece: a record's own pieces take its name in, and the pieces that a near name may have are
    asked. Each state holds the distinct names with one piece; it grows with names, not with records. Records of one name travel together, as many as one Arrow batch holds. Needs the RocksDB state store.
    """
    named = records.where(F.col("name").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "name")
    key = lambda keys, own, ids: F.transform(F.array_distinct(keys), lambda x: F.struct(x.alias("key"), F.lit(own).alias("own"), ids.alias("ids")))
    ids = F.col("all_ids")
    met = named.mapInPandas(_gather, "name string, ids array<long>").withColumnRenamed("ids", "all_ids")
    rows = met.select("name", F.inline(F.concat(key(N.own_keys(F.col("name"), k), True, F.array(F.array_min(ids))), key(N.probe_keys(F.col("name"), k), False, ids))))
    pairs = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Seen(k), outputStructType=_MET, outputMode="Append", timeMode="None")
    return pairs.select(F.explode("ids").alias("id"), "name", "known_id", "known", "distance")


def link_earlier(records: DataFrame, k: int = 2) -> DataFrame:
    """:func:`link_seen` of a table, all at once: pairs of distinct names, each name with its smallest id, joined to the later records."""
    named = records.where(F.col("name").isNotNull() & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "name")
    first = named.groupBy(F.col("name").alias("known")).agg(F.min("id").alias("known_id"))
    near = name_pairs(named, first, "name", "known", k).toDF("name", "known", "distance")
    return named.join(near, "name").join(first, "known").where("known_id < id").select("id", "name", "known_id", "known", "distance")


_STORE = "spark.sql.streaming.stateStore.providerClass"


def advance(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, timeout: int = 3600) -> DataFrame:
    """Runs ``transform`` over what the folder ``source`` has got since the last call with this ``checkpoint``, appends the result to ``out`` and returns all of that. All are in shared storage."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = transform(spark.readStream.schema(schema).parquet(source))
        run = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        if not run.awaitTermination(timeout):
            run.stop()
            raise TimeoutError(f"the stream did not finish in {timeout} s")
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)
    return spark.read.schema(stream.schema).parquet(out)


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Matches for each key in tumbling windows, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
