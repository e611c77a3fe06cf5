"""Quality classifier: a sparse rule ensemble.

Shallow boosted trees over text statistics are taken apart into conjunctive rules, one for each path from the root; a logistic
model with a lasso penalty over the rules leaves few of them; these are compiled into a Spark column expression over
the statistics, so that scoring is a projection.

Fitting sample: at most ``SAMPLE`` labelled rows outside the held-out remainder, those of the smallest MD5 of the id.

Defined cases: null, empty and white texts have all statistics 0 and are scored as such. Repeated rows are scored each for itself. Without
any labelled row every score is 0.5. For the fit, an id labelled twice has its larger label and an id of several texts the smallest; null labels
and ids are left out, and equal MD5 keys go by id. An empty table gives an empty result. Extra columns, whatever their names, are not read. ``doc_id`` may be
any integer type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import id_remainder, text_of
from .toxicity import sample

SAMPLE = 6000
TREES, DEPTH, LEAF = 24, 3, 12
PENALTY = 0.004
THRESHOLD = 0.5

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>",
    "stop": b".?",
    "bang": b"!",
    "comma": b",;:",
    "other": b"()[]{}@_=+/\\~^`\"'-",
}
STATISTICS = ["words", "lines", "word_bytes", *_CLASSES, "wide", "copies", "variety", "repeats", "line_words"]


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct hashes in each text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(first) - 1)


_LINE = tk._flags(b"\n")


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(off) - 1
    size = np.diff(off)
    full = np.flatnonzero(size)
    at = off[:-1][full]

    def count(flags: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        if len(full):
            out[full] = np.add.reduceat(flags[data], at, dtype=np.int64)
        return out

    h, first = tk.words(data, off)
    words = np.diff(first).astype(float)
    lines_h, line_first = tk.words(data, off, _LINE, lower=False)
    lines = np.diff(line_first).astype(float)
    grams, start = tk.shingles(h, first, 5)
    bytes_ = np.maximum(size - count(tk.SPACE), 0)
    per = np.maximum(bytes_, 1)
    w = np.maximum(words, 1)
    wide = np.zeros(256, bool)
    wide[128:] = True
    cols = [words, lines, bytes_ / w, *(count(tk._flags(c)) / per for c in _CLASSES.values()), count(wide) / per]
    cols += [1 - _distinct(lines_h, line_first) / np.maximum(lines, 1), _distinct(h, first) / w, 1 - _distinct(grams, start) / np.maximum(np.diff(start), 1), words / np.maximum(lines, 1)]
    for k in (-4, -2):  # no line or window: nothing is repeated
        cols[k] = np.where(words > 0, cols[k], 0.0)
    return np.stack(cols, axis=1)


Rule = tuple[tuple[int, bool, float], ...]


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], path: Rule, depth: int, out: list[Rule], step: np.ndarray) -> None:
    """Grows one tree on gradients; adds the path of every node but the root to ``out`` and leaf values to ``step``."""
    if path:
        out.append(path)
    best = (1e-6, -1, 0.0)
    if depth and len(rows) >= 2 * LEAF:
        gs, hs = g[rows].sum(), h[rows].sum()
        base = gs * gs / (hs + 1)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            place = np.searchsorted(cut, x[rows, j], "left")
            gl, hl, nl = (np.cumsum(np.bincount(place, weights=v, minlength=len(cut) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - base
            gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(cut[k]))
    if best[1] < 0:
        step[rows] = g[rows].sum() / (h[rows].sum() + 1)
        return
    left = x[rows, best[1]] <= best[2]
    for side, part in ((True, rows[left]), (False, rows[~left])):
        _tree(x, g, h, part, cuts, (*path, (best[1], side, best[2])), depth - 1, out, step)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, low, cut in rule:
        out &= (x[:, j] <= cut) == low
    return out


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules."""
    if not len(y):
        return 0.0, []
    x, y = np.asarray(x, float), np.asarray(y, float)
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 48))) for c in x.T]
    r = np.random.Generator(np.random.PCG64(3))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    f = np.full(len(y), np.log(rate / (1 - rate)))
    rules: list[Rule] = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        rows = np.sort(r.choice(len(y), max(1, len(y) // 2), replace=False))
        step = np.zeros(len(y))
        grown: list[Rule] = []
        _tree(x, y - p, p * (1 - p), rows, cuts, (), DEPTH, grown, step)
        rules += grown
        # Rows left out of the half follow the same leaves; their paths are the longest rules.
        for rule in grown:
            on = holds(rule, x)
            seen = np.intersect1d(rows, np.flatnonzero(on))
            if len(seen):
                step[on] = (y - p)[seen].sum() / ((p * (1 - p))[seen].sum() + 1)
        f += 0.3 * step
    rules = sorted(set(rules))
    if not rules:
        return float(np.log(rate / (1 - rate))), []
    z = np.stack([holds(k, x) for k in rules], axis=1).astype(float)
    scale = np.sqrt(np.maximum(z.mean(axis=0) * (1 - z.mean(axis=0)), 1e-4))
    z = (z - z.mean(axis=0)) / scale
    mean = np.stack([holds(k, x) for k in rules], axis=1).mean(axis=0)
    lipschitz = 0.25 * (np.linalg.norm(z, 2) ** 2 / len(y) + 1)
    w, b, v, c, t = np.zeros(z.shape[1]), float(np.log(rate / (1 - rate))), np.zeros(z.shape[1]), float(np.log(rate / (1 - rate))), 1.0
    for _ in range(400):
        e = (1 / (1 + np.exp(-(z @ v + c))) - y) / len(y)
        new = v - z.T @ e / lipschitz
        new = np.sign(new) * np.maximum(np.abs(new) - PENALTY / lipschitz, 0)
        bias = c - e.sum() / lipschitz
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / s * (new - w), bias + (t - 1) / s * (bias - b)
        w, b, t = new, bias, s
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    own = w[kept] / scale[kept]
    return float(b - (own * mean[kept]).sum()), [(rules[k], float(a)) for k, a in zip(kept, own, strict=True)]


def compiled(bias: float, rules: list[tuple[Rule, float]]) -> Column:
    """The score as a column expression over the statistics."""
    total = F.lit(bias)
    for rule, weight in rules:
        on = F.lit(True)
        for j, low, cut in rule:
            on = on & ((F.col(STATISTICS[j]) <= cut) if low else (F.col(STATISTICS[j]) > cut))
        total = total + F.when(on, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and its STATISTICS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in tk.chunks(batch, "text"):
                s = statistics(data, off)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in s.T)], names=["doc_id", *STATISTICS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


def quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    rows = sample(docs, labels, "quality", most)
    x = [np.zeros((0, len(STATISTICS)))]
    for k in range(0, len(rows), 256):
        part = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows[k : k + 256]], pa.large_string())], names=["text"])
        x += [statistics(data, off) for _, data, off in tk.chunks(part, "text", 1 << 20)]
    bias, rules = fit(np.concatenate(x), np.array([y for _, y in rows]))
    out = described(docs).select("doc_id", compiled(bias, rules).alias("score"))
    return out.select("doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
