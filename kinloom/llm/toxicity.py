"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are binary: single words, pairs of neighbours, and pairs with one word between, of the text in lower case without
punctuation, both by Unicode (of scripts without blanks, each character is a word), hashed to 64 bits. Per-coordinate learning rates and a constant L1 term, in units of one document's
gradient, leave few weights, which are broadcast as two short arrays. Their number is bounded by the features of the fitting sample.

Fitting sample: at most ``sample`` labelled rows outside the held-out remainder, those of the smallest MD5 of the id. A feature of fewer
than LEAST_ROWS rows of the sample tells nothing of other documents and is left out.

Defined cases: null, empty and white texts have no feature and score the intercept. Repeated rows are scored each for itself; for the
fit, an id labelled twice has its larger label. Without any labelled row every score is 0.5. Null labels and ids are left out of the fit.
Equal MD5 keys go by id. An empty table gives an empty result. Extra columns, whatever their names, are not read. ``doc_id`` may be any integer type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import id_remainder, plain_words, text_of

SAMPLE = 12_000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 8.0, 1.0, 3.0, 0.0
#: Rows of the sample that a feature must be in.
LEAST_ROWS = 3
_BITS = 22
_TALLY_BITS = 26
THRESHOLD = 0.7


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts with the text of each: words, neighbours, skip-grams."""
    h, first = tk.words(data, off, tk.NON_WORD)
    text = np.repeat(np.arange(len(off) - 1), np.diff(first))
    place, owner = [h], [text]
    for gap in (1, 2):
        if len(h) > gap:
            same = text[gap:] == text[:-gap]
            pair = tk.mix64(h[:-gap] * np.uint64(3) + h[gap:] * np.uint64(5) + np.uint64(gap))
            place.append(pair[same])
            owner.append(text[:-gap][same])
    return np.concatenate(place), np.concatenate(owner)


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, modulus: int = 3, held: int = 1) -> list[tuple[str, int]]:
    """At most ``most`` (text, label) rows outside the held-out remainder, those of the smallest MD5 of the id; of an id's texts, the smallest."""
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), modulus) != held))
    first = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).alias(label)).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(most)
    chosen = {r[0]: int(r[1]) for r in first.collect()}
    ids = docs.sparkSession.createDataFrame([(k,) for k in chosen] or [], "chosen long")
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("chosen")).groupBy("chosen").agg(F.min("text")).collect()
    return [(t, chosen[d]) for d, t in sorted((r[0], r[1]) for r in rows)]


def _proximal(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _slots(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _distinct(texts: list[str]) -> Iterator[np.ndarray]:
    """Each text's features, sorted, without repeats."""
    for a in range(0, len(texts), 256):
        part = texts[a : a + 256]
        h, owner = features(*tk.buffers(pa.array(part, pa.large_string())))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h = h[new]
        yield from np.split(h, np.searchsorted(owner[new], np.arange(1, len(part))))


def _examples(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features (sorted) of LEAST_ROWS texts or more, and for each text the numbers of those it has."""
    seen = np.zeros(1 << _TALLY_BITS, np.uint8)
    for x in _distinct(texts):
        at = _slots(x, _TALLY_BITS)
        seen[at] = np.minimum(seen[at], 254) + 1
    own = [x[seen[_slots(x, _TALLY_BITS)] >= LEAST_ROWS] for x in _distinct(texts)]
    del seen
    names = np.zeros(0, np.uint64)
    for a in range(0, len(own), 1000):
        names = np.union1d(names, np.concatenate(own[a : a + 1000]))
    for k, x in enumerate(own):
        own[k] = np.searchsorted(names, x).astype(np.int32)
    count = np.zeros(len(names), np.int32)
    for x in own:
        count[x] += 1
    good = count >= LEAST_ROWS
    place = np.cumsum(good, dtype=np.int32) - 1
    return names[good], [place[x[good[x]]] for x in own]


def fit(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Intercept, feature hashes (sorted) and weights of a model learned online, one document at a time."""
    if not rows:
        return 0.0, np.zeros(0, np.uint64), np.zeros(0)
    names, own = _examples([t for t, _ in rows])
    z, n = np.zeros(len(names)), np.zeros(len(names))
    z0 = n0 = 0.0
    intercept = lambda: -z0 / ((BETA + n0**0.5) / ALPHA)
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, y = own[k], rows[k][1]
            zx, nx = z[x], n[x]
            w = _proximal(zx, nx)
            bias = intercept()
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
            n[x] = nx + g * g
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / ALPHA * bias
            n0 += g * g
    w = _proximal(z, n)
    kept = np.flatnonzero(w)
    return float(intercept()), names[kept], w[kept]


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id``, ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, names, weights = shared.value
        may = np.zeros(1 << _BITS, bool)
        may[_slots(names, _BITS)] = True
        for batch in batches:
            for part, data, off in tk.chunks(batch, "text"):
                h, owner = features(data, off)
                hit = np.flatnonzero(may[_slots(h, _BITS)])
                k = np.minimum(np.searchsorted(names, h[hit]), max(len(names) - 1, 0))
                good = names[k] == h[hit] if len(names) else np.zeros(0, bool)
                pair = np.unique(owner[hit][good] * max(len(names), 1) + k[good])
                total = np.bincount(pair // max(len(names), 1), weights=weights[pair % max(len(names), 1)], minlength=part.num_rows) + bias
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    docs = docs.select("doc_id", plain_words(text_of()).alias("text"))
    out = score(docs, fit(sample(docs, labels, "toxic", most)))
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
