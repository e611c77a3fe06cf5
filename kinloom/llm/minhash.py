"""MinHash near-duplicate detection.

Method: distinct word shingles, many universal-hash minima with banding, a signature check,
an exact check on the full sets, and connected components by alternating stars.

Rows never pair off inside a bucket. Documents with the same set are one class, which a
representative stands for. Each band bucket compares its members with a centre, the member
that shares buckets with most others (an unedited original, as a rule). Where that leaves members in
different components, they are also compared with up to seven further members, the next most shared and ones drawn by hash.
A bucket of five members at most is thereby compared in full. The members of larger buckets that still hold several components
go through an exact join: two sets at the threshold share a shingle among their rarest ones (a prefix that the threshold and the sizes give), so
documents of different components meet on these shingles, a frequent shingle's documents in salted blocks. No pair that banding gives is left untested.

Defined cases: a null, empty or white text has an empty set, is linked with nothing and is kept.
A text of fewer words than a shingle has its whole word sequence as its one shingle.
Rows that repeat a doc_id count once, with the smallest of their texts; what is decided holds for all of them. Null ids are left out of the result, and
:func:`deduplicate` keeps their rows. Equal fame goes to the smaller id. Other columns, whatever their names, are left alone by :func:`deduplicate`.
An empty table gives an empty result. A text of any length is hashed in slices; its set takes 8 bytes for each shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import fresh, settle, text_of
from .components import components

ROWS = 5
#: Share of true links at the threshold that banding may miss.
MISS = 1e-6
#: Members of a bucket, besides its centre, that all others are compared with: so many of the most shared and as many drawn by hash.
MORE_CENTRES = 4
#: Documents of one shingle that a block of the exact join compares others with.
BLOCK = 1000
#: Bits of a shingle that its frequency is counted by; the counts set the order of shingles only, so collisions cost time and no links.
SLOT_BITS = 20


def band_count(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands for which a pair at the threshold shares none with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def _family(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(5))
    return r.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, k, dtype=np.uint32)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part, data, off in tk.chunks(batch, "text"):
        hashes, first = tk.words(data, off)
        grams, start = tk.shingles(hashes, first, size)
        yield part, [np.unique(grams[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]


def _signer(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _family(bands * rows)
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for part, sets in _sets(batch, size):
                counts = np.array([len(s) for s in sets], np.int64)
                minima = np.zeros((len(sets), bands * rows), np.uint32)
                full = np.flatnonzero(counts)
                if len(full):
                    flat = (np.concatenate([sets[i] for i in full]) >> np.uint64(16)).astype(np.uint32)
                    at = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                    for k in range(bands * rows):
                        minima[full, k] = np.minimum.reduceat(flat * a[k] + b[k], at)
                key = np.zeros((len(sets), bands), np.uint64) + salt
                for j in range(rows):
                    key = tk.mix64(key ^ minima[:, j::rows].astype(np.uint64))
                key[counts == 0] = 0
                ids = [pa.array(tk.as_long(np.array([f(s) for s in sets], np.uint64))) for f in (lambda s: np.add.reduce(s), lambda s: np.bitwise_xor.reduce(tk.mix64(s)))]
                marks = np.ascontiguousarray((minima & np.uint32(255)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(counts),
                        *ids,
                        pa.array([m.tobytes() for m in marks], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(tk.as_long(key.reshape(-1)))),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "marks", "bands"],
                )

    return run


def _set_column(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, size):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "members"])

    return run


def _likely(k: int, threshold: float):
    """Keeps pairs whose signatures agree often enough: six standard deviations below the threshold."""
    least = threshold - 6 * math.sqrt(threshold * (1 - threshold) / k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, k) for c in (2, 3))
            keep = (x == y).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["u", "v"])

    return run


def _linked(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(den * both >= num * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    return run


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose signatures agree well enough and whose full sets meet the threshold."""
    marks = classes.select("doc_id", "marks")
    both = pairs.join(marks.toDF("u", "mu"), "u").join(marks.toDF("v", "mv"), "v").select("u", "v", "mu", "mv")
    likely = settle(both.mapInArrow(_likely(k, num / den), "u long, v long"), "likely")
    full = likely.join(sets.toDF("u", "su"), "u").join(sets.toDF("v", "sv"), "v").select("u", "v", "su", "sv")
    return settle(full.mapInArrow(_linked(num, den), "u long, v long"), "links")


def _spokes(rows: DataFrame, centres: DataFrame, num: int, den: int, apart: str = "true") -> DataFrame:
    """Pairs of a bucket's members with its centres that fit in size."""
    fits = F.expr(f"{den} * least(n_shingles, cn) >= {num} * greatest(n_shingles, cn) and doc_id <> centre and {apart}")
    return rows.join(centres, "band").where(fits).select(F.least("doc_id", "centre").alias("u"), F.greatest("doc_id", "centre").alias("v")).distinct()


def _slots(members: np.ndarray) -> np.ndarray:
    return (members >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        for v in batch.column(0):
            np.add.at(total, _slots(np.frombuffer(v.as_buffer(), np.uint64)), 1)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["slot", "c"])


def _prefixes(frequency, num: int, den: int):
    """The rarest shingles of each set, one of which any set that is not larger and meets the threshold has among its own; ``at`` is the place by rarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, sizes = [], []
            for v in batch.column(2):
                s = np.frombuffer(v.as_buffer(), np.uint64)
                tokens.append(s[np.lexsort((s, frequency.value[_slots(s)]))][: len(s) + 1 + (-num * len(s)) // den])
                sizes.append(len(s))
            lengths = np.array([len(t) for t in tokens])
            owner = np.repeat(np.arange(len(tokens)), lengths)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tk.as_long(np.concatenate(tokens))), batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(np.array(sizes)[owner]), pa.array(at)],
                names=["token", "id", "root", "n", "at"],
            )

    return run


def _apart(open_: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs (u, v) of ``open_`` (id, root) with different roots that can meet the threshold.

    Of two sets at the threshold, the smaller one has a shared shingle in the part of its prefix that an equal size leaves (its index), and
    the larger one anywhere in its prefix. The documents of a shingle's largest component never meet each other.
    """
    spark = sets.sparkSession
    held = settle(sets.join(open_, "id").select("id", "root", "members"), "held")
    tally = held.select("members").mapInArrow(_tally, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    frequency = np.zeros(1 << SLOT_BITS, np.int64)
    frequency[tally.column("slot").to_numpy()] = tally.column("c").to_numpy()
    prefix = settle(held.mapInArrow(_prefixes(spark.sparkContext.broadcast(frequency), num, den), "token long, id long, root long, n long, at long"), "prefixes")
    index = F.expr(f"(n - at) * {den + num} >= {2 * num} * n")
    by_root = prefix.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"), F.count_if(index).alias("ci"))
    most = F.struct("c", "root")
    crowds = by_root.groupBy("token").agg(
        F.max_by("root", most).alias("largest"), F.max_by("ci", most).alias("inside"), F.sum("ci").alias("all"), F.count(F.lit(1)).alias("roots")
    ).where("roots > 1")
    prefix = settle(prefix.join(crowds, "token"), "crowded")
    small = prefix.where(index)
    fits = F.expr(
        f"root <> proot and {den} * n >= {num} * pn and (n < pn or n = pn and id < pid) and {den + num} * least(n - at, pn - pat) >= {num} * (n + pn)"
    )
    found = []
    for mine, theirs, crowd in (("root <> largest", "true", "all - inside"), ("root = largest", "root <> largest", "inside")):
        blocks = F.expr(f"greatest(1, ceil(({crowd}) / {BLOCK}))").cast("int")
        dealt = small.where(mine).select("token", F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "id", "root", "n", "at")
        meets = prefix.where(theirs).where(f"{crowd} > 0").select(
            "token", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("id").alias("pid"), F.col("root").alias("proot"), F.col("n").alias("pn"), F.col("at").alias("pat")
        )
        found.append(dealt.join(meets, ["token", "block"]).where(fits).select(F.least("id", "pid").alias("u"), F.greatest("id", "pid").alias("v")))
    return found[0].unionByName(found[1]).distinct()


def _once(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with one row for each id. Only ids are shuffled, and the texts of ids that repeat."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    ids = settle(ids, "repeated")
    if ids.isEmpty():
        return docs
    one = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return docs.join(ids, "doc_id", "left_anti").unionByName(settle(one, "repeated_texts"))


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every document.

    Two documents are linked if den * intersection >= num * union of their sets of ``size``-word shingles.
    ``component_id`` is the smallest id that links reach. Ids must be integers; rows without one are left out.
    """
    bands = band_count(num / den)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).where("doc_id is not null")
    docs = _once(docs)
    signed = settle(
        docs.mapInArrow(_signer(size, bands, ROWS), "doc_id long, n_shingles long, f1 long, f2 long, marks binary, bands array<long>"),
        "signatures",
    )
    one = F.struct("doc_id", "marks", "bands")
    classes = settle(
        signed.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min(one).alias("r")).select("n_shingles", "f1", "f2", "r.*"), "classes"
    )
    member = signed.select("doc_id", "n_shingles", "f1", "f2").join(classes.select("n_shingles", "f1", "f2", F.col("doc_id").alias("rep")), ["n_shingles", "f1", "f2"], "left")

    rows = classes.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    rows = settle(rows.join(shared, "band"), "buckets")
    fame = rows.groupBy("doc_id").agg(F.sum("crowd").alias("fame"))
    rows = settle(rows.join(fame, "doc_id").select("band", "doc_id", "n_shingles", "fame"), "famed")
    centre = rows.groupBy("band").agg(F.max_by("doc_id", F.struct("fame", -F.col("doc_id"))).alias("centre"), F.max_by("n_shingles", F.struct("fame", -F.col("doc_id"))).alias("cn"))
    wanted = rows.select("doc_id").distinct()
    # The hint keeps one way at every size: a broadcast of ids would grow with the corpus.
    sets = settle(docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_set_column(size), "id long, members binary"), "sets")
    found = _confirm(_spokes(rows, centre, num, den), classes, sets, bands * ROWS, num, den)

    # Further centres matter only where they join two components.
    roots = components(found).toDF("doc_id", "root")
    placed = settle(rows.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "placed")
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    placed = placed.join(split, "band")
    more = [placed.withColumn("rank", F.row_number().over(Window.partitionBy("band").orderBy(*by, "doc_id"))).where(F.col("rank") <= MORE_CENTRES) for by in ([F.desc("fame")], [F.xxhash64("band", "doc_id")])]
    further = more[0].unionByName(more[1]).select("band", F.col("doc_id").alias("centre"), F.col("n_shingles").alias("cn"), F.col("root").alias("cr")).distinct()
    extra = _confirm(_spokes(placed, further, num, den, "root <> cr"), classes, sets, bands * ROWS, num, den)
    found = found.unionByName(extra)
    roots = components(found).toDF("doc_id", "root")

    # What larger buckets still hold apart is compared in full.
    placed = rows.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    split = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("crowd")).where(f"lo < hi and crowd > {MORE_CENTRES + 1}").select("band")
    rest = settle(placed.join(split, "band").select(F.col("doc_id").alias("id"), "root").distinct(), "rest")
    if not rest.isEmpty():
        last = _confirm(_apart(rest, sets, num, den), classes, sets, bands * ROWS, num, den)
        roots = components(found.unionByName(last))
    roots = roots.toDF("rep", "root")
    return member.join(roots, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id"), (F.col("doc_id") == F.coalesce("root", "rep", "doc_id")).alias("kept")
    )


def deduplicate(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each near-duplicate group; columns unchanged."""
    dropped = near_duplicates(docs, size, num, den).where("not kept").select(F.col("doc_id").alias(fresh(docs) + "dropped"))
    return docs.join(dropped, docs.doc_id.cast("long") == F.col(dropped.columns[0]), "left_anti")
