"""Importance resampling of documents towards a target distribution.

Documents and target texts are counted as bags of hashed features: all runs of 1 to ``size`` consecutive words. Each bucket's gain is the scaled log
ratio of its smoothed share in the target to that in the corpus; the gains are one array of ``buckets`` numbers, which the score of a document
indexes by its features' buckets. Gumbel noise that depends on the id alone makes the highest scores a draw without replacement.

The number to draw is taken exactly, without a sort of the corpus: the composite key (score falling, id, features, row) is selected by radix. One pass
counts the values of the next ``DIGIT_BITS`` bits among the rows that still tie with the prefix found so far, so that the driver sees a few thousand counts at most,
and a key ends as soon as its ties are all drawn. Only the drawn rows are then range-sorted and ranked: the rank is a row's place in its range and the rows in the ranges before it.

Texts are read twice, for the counts and for the scores; what is written in between is one narrow row for each document. A task
counts into one array, so at most ``buckets`` rows of it are shuffled. No step groups by word, source or score, so a hot one costs nothing.

Defined cases: a null, empty or wordless text has no feature and weight 0; it still has a score. A null id stands as the empty string in the noise, and after all others in ties.
Rows that repeat an id are documents of their own; where they tie, the one of fewer features goes first, and what still ties is alike in all returned columns.
With empty ``docs`` the result is empty; with an empty target every gain compares with a uniform one. Texts of any length go through in slices. Extra columns, whatever their
names, are not read, and other columns of the target neither. ``doc_id`` may be any integer type.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import SQL_CRC, fresh, settle, sql_crc, text_of

BUCKETS = 10_000
SIZE = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
DIGIT_BITS = 12
#: Words longer than this many bytes are hashed one by one, so that the loop over byte places stays short.
_LONG = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges: one step for each byte place over all ranges that reach it."""
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    size = ends - starts
    for k in np.flatnonzero(size > _LONG):
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes()) ^ 0xFFFFFFFF
    live = np.flatnonzero((size <= _LONG) & (size > 0))
    at, left, crc = starts[live], size[live], out[live]
    while len(live):
        crc = _CRC[(crc ^ data[at]) & np.uint32(255)] ^ (crc >> np.uint32(8))
        on = left > 1
        out[live[~on]] = crc[~on]
        live, at, left, crc = live[on], at[on] + 1, left[on] - 1, crc[on]
    return out ^ np.uint32(0xFFFFFFFF)


def feature_buckets(data: np.ndarray, off: np.ndarray, size: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every run of 1 to ``size`` words of all texts, slice by slice; the last words of a slice begin runs that end in the next one."""
    back = 0
    for a, b in tk.slices(data, tk.NON_WORD):
        low = min(back, a) if size > 1 else a
        inner = off[np.searchsorted(off, low, "right") : np.searchsorted(off, b, "left")]
        starts, ends, _ = tk.spans(data[low:b], np.concatenate([[low], inner, [b]]) - low, tk.NON_WORD)
        text = np.searchsorted(off, starts + low, "right") - 1
        carried = int(np.searchsorted(starts, a - low))
        plain, length = tk.LOWER[data[low:b]], ends - starts
        if size > 1:
            # Words side by side with one blank between, so that a run is one range.
            own = np.cumsum(length + 1) - length - 1
            joined = np.full(int((length + 1).sum()), 32, np.uint8)
            flat = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            joined[flat + np.repeat(own, length)] = plain[flat + np.repeat(starts, length)]
            plain, starts_of = joined, own
        else:
            starts_of = starts
        n = len(starts)
        for k in range(1, size + 1):
            first = np.arange(max(0, n - k + 1))
            last = first + k - 1
            first = first[(last >= carried) & (text[first] == text[last])]
            last = first + k - 1
            crc = crc32(plain, starts_of[first], starts_of[last] + length[last])
            yield text[first], (crc % np.uint32(buckets)).astype(np.int64)
        keep = n - (size - 1)
        back = int(starts[keep]) + low if 0 <= keep < n else low if n else b


def counts(texts: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``, the features of all texts that fall into it."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, off in tk.chunks(batch, "text"):
                for _, b in feature_buckets(data, off, size, buckets):
                    total += np.bincount(b, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select(text_of().alias("text")).mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln(share in the target / share in the corpus)) of every bucket, shares smoothed by one count a bucket."""
    seen = []
    for df in (corpus, target):
        n = [0] * buckets
        for r in counts(df, size, buckets).collect():  # one row a bucket at most
            n[r["bucket"]] = r["n"]
        seen.append((n, sum(n)))
    (s, all_s), (t, all_t) = seen
    return [math.floor(1000 * math.log(float(t[b] + 1) * float(all_s + buckets) / (float(s[b] + 1) * float(all_t + buckets)))) for b in range(buckets)]


def weights(docs: DataFrame, gain: Sequence[int], size: int = SIZE) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight``, the floored mean of the gains of a document's features (none: 0)."""
    table = np.array(gain, np.int64)
    rows = docs.select("doc_id", text_of().alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in tk.chunks(batch, "text"):
                n, total, words = (np.zeros(part.num_rows, np.int64) for _ in range(3))
                for k, (text, bucket) in enumerate(feature_buckets(data, off, size, len(table))):
                    seen = np.bincount(text, minlength=len(n))
                    n += seen
                    words += seen if k % size == 0 else 0
                    np.add.at(total, text, table[bucket])
                mean = total // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(n), pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) for a Gumbel variable g that the id and the seed fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def first_k(rows: DataFrame, keys: Sequence[Column], k: int) -> Column:
    """Whether a row is among the first ``k`` by ``keys``, long columns without nulls of which the last tells all rows apart.

    Radix selection over the bits of one key after the other. ``rows`` is read once for each digit, so it should be a written table.
    """
    if k <= 0:
        return F.lit(False)
    below, tied, ties = [], [], rows
    for key in keys:
        low, high, n = ties.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if n <= k:
            break
        shift, prefix = 64, None  # all values share the empty prefix
        while shift and low >> (shift - 1) == high >> (shift - 1):
            shift, prefix = shift - 1, low >> (shift - 1)
        while shift and n > k:
            finer = max(0, shift - DIGIT_BITS)
            known = ties if prefix is None else ties.where(F.shiftright(key, shift) == prefix)
            shift = finer
            for prefix, n in sorted(map(tuple, known.groupBy(F.shiftright(key, finer).alias("digit")).count().collect())):
                if n >= k:
                    break
                k -= n
        head = F.shiftright(key, shift)
        below.append(head < prefix)
        tied.append(head == prefix)
        if n <= k:
            break
        ties = ties.where(head == prefix)
    chosen = F.lit(True)
    for less, same in zip(reversed(below), reversed(tied), strict=True):
        chosen = less | (same & chosen)
    return chosen


def ranked(rows: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3 … in the order of ``keys``: a range sort, and the rows of the ranges before each."""
    own = fresh(rows)
    at = own + "at"
    placed = settle(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "ranges")
    sizes, total = [], 0
    for part, n in sorted(map(tuple, placed.groupBy(F.shiftright(at, 33)).count().collect())):  # one row a range
        sizes.append((part, total))
        total += n
    starts = placed.sparkSession.createDataFrame(sizes, f"{own}part long, {own}start long")
    out = placed.join(F.broadcast(starts), F.shiftright(at, 33) == F.col(own + "part"))
    return out.withColumn("rank", F.col(own + "start") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(at, own + "part", own + "start")


def resample(docs: DataFrame, target: DataFrame, size: int = SIZE, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (null where not drawn) of every document.

    Of the N documents with ``least_words`` words, floor(percent * N / 100) are drawn.
    """
    gain = gains(docs, target, size, buckets)
    scored = weights(docs, gain, size).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = settle(scored, "scores")
    able = scored.where(F.col("n_words") >= least_words)
    keys = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("n_features"), F.col("row")]
    chosen = (F.col("n_words") >= least_words) & first_k(able, keys, percent * able.count() // 100)
    out = ("doc_id", "n_features", "weight", "score", "rank")
    rest = scored.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(chosen), keys).select(*out).unionByName(rest.select(*out))


def resampled_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns and ``rank``, in place of a column of that name. Rows that repeat an id come with the first of its ranks."""
    own = fresh(docs)
    drawn = resample(docs, target, **options).where("rank is not null").groupBy(F.col("doc_id").alias(own + "id")).agg(F.min("rank").alias("rank"))
    docs = docs.drop("rank")
    return docs.join(drawn, docs.doc_id.eqNullSafe(F.col(own + "id"))).drop(own + "id")


def oracle(buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> str:
    """:func:`resample` with single words over ``documents`` and ``benchmark`` in DuckDB SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH {SQL_CRC},
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
q AS (SELECT unnest({words}) AS w FROM benchmark),
e AS (SELECT r, unnest(w) AS w FROM d),
u AS (SELECT w FROM e UNION SELECT w FROM q),
b AS (SELECT w, {sql_crc("w")} % {buckets} AS b FROM u, crc),
s AS (SELECT b, count(*) AS n FROM e JOIN b USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM q JOIN b USING (w) GROUP BY b),
a AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
g AS (SELECT s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (a.s + {buckets}) / ((s.n + 1)::DOUBLE * (a.t + {buckets}))))::BIGINT AS g FROM s LEFT JOIN t USING (b), a),
m AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM e JOIN b USING (w) JOIN g USING (b) GROUP BY r),
z AS (SELECT r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {percent} * n // 100 THEN rank END AS rank FROM z LEFT JOIN k USING (r)"""
