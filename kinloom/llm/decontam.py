"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose the token positions of a window that are hashed, so a substituted token at an ignored position does
not hide a passage. Test windows form a hash index; training windows are looked up in it; each hit fixes an alignment (document, item, offset),
along which the tokens are compared. The best stretch with at most one substitution in four tokens decides.

Tokens are runs of Unicode letters, marks and digits in lower case, so punctuation of any kind and case do not matter; of scripts without blanks, each character is a
token. A document is contaminated by an item if the stretch matches at least ``cover`` of the item's tokens and ``min_words`` of them. An item of
fewer than ``min_words`` tokens is matched whole; of one with SHORT_TOLERANT tokens at least, any one may be substituted: its masks are all those that ignore one position.
:func:`decontaminate` passes over items of fewer than ``least_words`` tokens, since one or two common words would drop clean documents.

Items of the same tokens are one class, for which its smallest item_id stands; :func:`item_classes` says which item is of which class.

The test set is read in blocks of at most ``block_words`` tokens (a longer item is a block of its own), one at a time. Each
block is one pass over the documents with that block broadcast; no training window is shuffled. Where the seeds of a chunk of texts hit more than HITS places, its texts are
taken a few at a time, and a single text with more goes through ranges of items; so what is held is bounded by HITS, and a passage that many items share costs time by its hits.

Defined cases: null, empty or white texts match nothing, and such items are of no class. Null item ids are left out. Rows that repeat a doc_id are judged each for
itself. Of two stretches of a document that match an item equally, the first counts. Empty tables give empty results. Extra columns, whatever their names, are
not read, and :func:`decontaminate` returns them unchanged. A text of any length is hashed in slices; its tokens take 8 bytes each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import fresh, plain_words, settle, text_of

#: Six sampled positions each; 0 is ignored.
MASKS = ("111111", "1110111", "11011011", "1101011001", "1011001101")
MIN_WORDS = 8
COVER = 0.5
#: Share of matching tokens below which a stretch loses score.
IDENTITY = 0.75
BLOCK_WORDS = 1 << 19
#: Shortest item that makes :func:`decontaminate` drop a document.
LEAST_WORDS = 4
#: Items of at least so many tokens, but fewer than MIN_WORDS, may have one substituted.
SHORT_TOLERANT = 6
#: Seed hits, and tokens of alignments, worked on together.
HITS = 1 << 20
#: An alignment has fewer tokens than this.
_SPAN = 27
_BITS = 20


def _windows(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Seed hash at every position where the mask still fits (across text ends too)."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for j, bit in enumerate(mask):
        if bit == "1":
            out += (hashes[j : j + n] ^ (hashes[j : j + n] >> np.uint64(31))) * tk._STEP[100 + j]
    return out ^ (out >> np.uint64(29))


def _short_masks(size: int) -> list[str]:
    """Masks over a whole short item: all its tokens, and, from SHORT_TOLERANT on, all but one of them."""
    whole = "1" * size
    return [whole] + [whole[:k] + "0" + whole[k + 1 :] for k in range(size if size >= SHORT_TOLERANT else 0)]


@dataclass
class Index:
    """One block of the test set: tokens of its items, for each mask its sorted seeds with their places, and short items by mask."""

    items: np.ndarray
    tokens: np.ndarray
    first: np.ndarray
    seeds: list[tuple[np.ndarray, np.ndarray]]
    bits: list[np.ndarray]
    short: dict[str, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int, bytes]], min_words: int = MIN_WORDS) -> Index:
        """From items with their token hashes."""
        tokens = np.frombuffer(b"".join(t for _, t in rows), np.uint64)
        size = np.array([len(t) // 8 for _, t in rows], np.int64)
        starts = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        item = np.repeat(np.arange(len(rows)), size)
        long = size >= min_words
        seeds, bits, short = [], [], {}
        for k, mask in enumerate(MASKS):
            h = _windows(tokens, mask, k)
            at = np.flatnonzero((item[: len(h)] == item[len(mask) - 1 :]) & long[item[: len(h)]]) if len(h) else np.zeros(0, np.int64)
            order = np.argsort(h[at], kind="stable")
            at, h = at[order].astype(np.int32), h[at][order]
            seen = np.zeros(1 << _BITS, bool)
            seen[h >> np.uint64(64 - _BITS)] = True
            seeds.append((h, at))
            bits.append(seen)
        for n in np.unique(size[~long & (size > 0)]).tolist():
            own = np.flatnonzero(size == n)
            for k, mask in enumerate(_short_masks(n)):
                h = _windows(tokens, mask, 64 * n + k)[starts[own]]
                order = np.argsort(h, kind="stable")
                short[mask] = h[order], own[order]
        return Index(np.array([k for k, _ in rows], np.int64), tokens, starts, seeds, bits, short)


def _expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of lo, lo + 1, ..., lo + n - 1, one after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _alignments(hashes: np.ndarray, first: np.ndarray, index: Index) -> Iterator[np.ndarray]:
    """Distinct (text, item, shift) rows in order, in portions no text and item of which are in another; a shift is a text's token position less the item's."""
    found = []
    for k, mask in enumerate(MASKS):
        h = _windows(hashes, mask, k)
        known, place = index.seeds[k]
        if not len(h) or not len(known):
            continue
        p = np.flatnonzero(index.bits[k][h >> np.uint64(64 - _BITS)])
        lo = np.searchsorted(known, h[p], "left")
        n = np.searchsorted(known, h[p], "right") - lo
        found.append((p[n > 0], lo[n > 0], n[n > 0], place))
    texts = len(first) - 1
    per_text = sum((np.bincount(np.searchsorted(first, p, "right") - 1, weights=n, minlength=texts) for p, _, n, _ in found), np.zeros(texts))
    group = ((np.cumsum(per_text) - per_text) // HITS).astype(np.int64)
    for g in np.unique(group[per_text > 0]):
        own = np.flatnonzero((group == g) & (per_text > 0))
        low, high = first[own[0]], first[own[-1] + 1]
        ranges = int(-(-per_text[own].sum() // (2 * HITS)))
        cuts = np.linspace(0, len(index.items), ranges + 1).astype(np.int64)
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            keys = []
            for p, lo, n, place in found:
                inside = (p >= low) & (p < high)
                p, lo, n = p[inside], lo[inside], n[inside]
                step = np.cumsum(n) // HITS
                for part in np.unique(step):
                    some = step == part
                    at = np.repeat(p[some], n[some])
                    q = place[_expand(lo[some], n[some])].astype(np.int64)
                    if ranges > 1:
                        some = (q >= index.first[begin]) & (q < index.first[end])
                        at, q = at[some], q[some]
                    # Item place and shift fix an alignment with the text: the position in the texts is that in the items plus the shift.
                    text, item = np.searchsorted(first, at, "right") - 1, np.searchsorted(index.first, q, "right") - 1
                    keys.append(np.unique(_packed(text, item, at - q, first, index)))
            if keys:
                yield _unpacked(np.unique(np.concatenate(keys)), first, index)


def _packed(text: np.ndarray, item: np.ndarray, shift: np.ndarray, first: np.ndarray, index: Index) -> np.ndarray:
    """One key for text, item and shift, ordered like them: a shift lies between the index's and the texts' tokens, so the three fit in 63 bits or two fields are taken."""
    width = int(first[-1] + index.first[-1] + 1)
    if (len(first) - 1) * len(index.items) * width < 1 << 63:
        return (text * len(index.items) + item) * width + shift + index.first[-1]
    return np.rec.fromarrays([text * len(index.items) + item, shift + index.first[-1]])


def _unpacked(keys: np.ndarray, first: np.ndarray, index: Index) -> np.ndarray:
    width = int(first[-1] + index.first[-1] + 1)
    both, shift = (keys["f0"], keys["f1"]) if keys.dtype.names else np.divmod(keys, width)
    return np.stack([both // len(index.items), both % len(index.items), shift - index.first[-1]], axis=1)


def _stretches(hashes: np.ndarray, first: np.ndarray, index: Index, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matching tokens and first token position of each alignment's best stretch, the first of equals."""
    reward, penalty = round(100 * (1 - IDENTITY)), round(100 * IDENTITY)
    d, i, shift = rows.T
    lo = np.maximum(first[d], index.first[i] + shift)
    size = np.minimum(first[d + 1], index.first[i + 1] + shift) - lo
    if len(size) and size.max() >= 1 << _SPAN:
        raise ValueError(f"an alignment of {size.max()} tokens; the limit is {1 << _SPAN}")
    matched, begin = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    group = np.cumsum(size) // (HITS >> 2)
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        # Each alignment is a run of size + 1 sums, the first of them 0; a run lies so far below the one before that its minima are its own.
        n = size[own] + 1
        at = np.cumsum(n) - n
        t = _expand(lo[own], size[own])
        equal = hashes[t] == index.tokens[t - np.repeat(shift[own], size[own])]
        step = np.zeros(int(n.sum()), np.int64)
        inner = np.ones(len(step), bool)
        inner[at] = False
        step[inner] = np.where(equal, reward, -penalty)
        hits = np.zeros(len(step), np.int64)
        hits[inner] = equal
        run = np.repeat(np.arange(len(own)), n)
        total = np.cumsum(step)
        total -= total[at][run]
        hits = np.cumsum(hits)
        far = np.cumsum(n * 2 * (reward + penalty))[run]
        low = np.minimum.accumulate(((total - far) << (_SPAN + 1)) + np.arange(len(step)))
        start = low & ((1 << (_SPAN + 1)) - 1)
        gain = total - total[start]
        best = np.maximum.reduceat(gain, at)
        end = np.flatnonzero(gain == best[run])
        end = end[np.searchsorted(end, at)]
        matched[own] = hits[end] - hits[start[end]]
        begin[own] = lo[own] + start[end] - at
    return matched, begin


def _matches(hashes: np.ndarray, first: np.ndarray, index: Index, cover: float, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, item place, matched, item words, token offset) of the best stretch of each text and item that reach the limits."""
    out = [np.zeros((0, 5), np.int64)]
    for rows in _alignments(hashes, first, index):
        matched, begin = _stretches(hashes, first, index, rows)
        words = index.first[rows[:, 1] + 1] - index.first[rows[:, 1]]
        good = matched >= np.maximum(min_words, np.ceil(cover * words))
        best = np.stack([rows[good, 0], rows[good, 1], matched[good], words[good], begin[good] - first[rows[good, 0]]], axis=1)
        out.append(_first_best(best))
    for mask, (known, own) in index.short.items():
        n = len(mask)
        h = _windows(hashes, mask, 64 * n + ([*_short_masks(n)].index(mask)))
        p = np.flatnonzero(np.isin(h, known))
        p = p[np.searchsorted(first, p, "right") == np.searchsorted(first, p + n - 1, "right")]
        lo, hi = np.searchsorted(known, h[p], "left"), np.searchsorted(known, h[p], "right")
        item, p = own[_expand(lo, hi - lo)], np.repeat(p, hi - lo)
        text, equal = np.searchsorted(first, p, "right") - 1, mask.count("1")
        if equal < n:  # the ignored token may be equal all the same
            gap = mask.index("0")
            equal = equal + (hashes[p + gap] == index.tokens[index.first[item] + gap])
        out.append(np.stack([text, item, np.broadcast_to(equal, len(p)), np.full(len(p), n), p - first[text]], axis=1))
    return tuple(_first_best(np.concatenate(out)).T)


def _first_best(out: np.ndarray) -> np.ndarray:
    """Of the rows of one text and item the one that matches most, the first of equals."""
    out = out[np.lexsort((out[:, 4], -out[:, 2], out[:, 1], out[:, 0]))]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:, 0] != out[:-1, 0]) | (out[1:, 1] != out[:-1, 1])
    return out[new]


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in tk.chunks(batch, "text"):
            h, first = tk.words(data, off, tk.NON_WORD)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["item_id", "tokens"])


def _tokenised(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain_words(text_of()).alias("text")).where("item_id is not null")
    return rows.mapInArrow(_item_tokens, "item_id long, tokens binary").where("length(tokens) > 0")


def item_classes(benchmark: DataFrame) -> DataFrame:
    """``item_id`` and ``class_id``, the smallest id of an item of the same tokens; items without tokens are absent."""
    rows = _tokenised(benchmark).select("item_id", F.sha2("tokens", 256).alias("key"))
    return rows.join(rows.groupBy("key").agg(F.min("item_id").alias("class_id")), "key").select("item_id", "class_id").distinct()


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, bytes]]]:
    """Classes of items with their tokens, read one partition at a time."""
    block, size = [], 0
    rows = settle(_tokenised(benchmark).groupBy(F.sha2("tokens", 256).alias("key")).agg(F.min(F.struct("item_id", "tokens")).alias("r")).select("r.*"), "items")
    for r in rows.toLocalIterator():
        n = len(r[1]) // 8
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], bytes(r[1])))
        size += n
    if block:
        yield block


def _found(texts: DataFrame, block: list, cover: float, min_words: int) -> DataFrame:
    """Contaminated pairs of ``texts`` (doc_id, mark, text) with one block."""
    shared = texts.sparkSession.sparkContext.broadcast(Index.of(block, min_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in tk.chunks(batch, "text"):
                d, i, *rest = _matches(*tk.words(data, off, tk.NON_WORD), shared.value, cover, min_words)
                if len(d):
                    at = pa.array(d)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(shared.value.items[i]), *map(pa.array, rest)], names=["doc_id", "mark", "item_id", "matched", "item_words", "at"])

    return texts.mapInArrow(run, "doc_id long, mark long, item_id long, matched long, item_words long, at long")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("mark"), plain_words(text_of()).alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id``, ``item_id`` (of the item's class), ``matched``, ``item_words``, ``at`` (token offset in the document) of every contaminated pair."""
    texts, out = _rows(docs), None
    blocks = _blocks(benchmark, block_words)
    block = next(blocks, [])
    for following in itertools.chain(blocks, [None]):
        one = _found(texts, block, cover, min_words).drop("mark")
        if following is None and out is None:
            return one
        # Written before the next block is read, so that one block is held at a time.
        one = settle(one, "contamination")
        out, block = one if out is None else out.unionByName(one), following
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without contaminated documents; columns unchanged.

    A test set of one block is a filter in one pass, without a shuffle. With more blocks, the ids and
    text hashes of contaminated rows are written for each block, and rows with them are dropped.
    """
    blocks = _blocks(benchmark, block_words)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        shared = docs.sparkSession.sparkContext.broadcast(Index.of([x for x in block if len(x[1]) >= 8 * least_words], min_words))

        @F.arrow_udf("boolean")
        def clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                parts = []
                for part, data, off in tk.chunks(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
                    keep = np.ones(part.num_rows, bool)
                    keep[_matches(*tk.words(data, off, tk.NON_WORD), shared.value, cover, min_words)[0]] = False
                    parts.append(pa.array(keep))
                yield pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())

        return docs.where(clean(plain_words(text_of())))
    bad = None
    for more in itertools.chain([block, following], blocks):
        one = settle(_found(_rows(docs), more, cover, min_words).where(F.col("item_words") >= least_words).select("doc_id", "mark").distinct(), "contaminated")
        bad = one if bad is None else bad.unionByName(one)
    own = fresh(docs)
    bad = bad.distinct().toDF(own + "id", own + "mark")
    return docs.join(bad, docs.doc_id.cast("long").eqNullSafe(F.col(own + "id")) & (F.xxhash64(text_of()) == F.col(own + "mark")), "left_anti")
