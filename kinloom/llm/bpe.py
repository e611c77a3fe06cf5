"""Byte-level BPE by the ranks of a public vocabulary: encoding by corpus-level merge replay, and decoding.

A text falls into pieces by the vocabulary's pattern. The pieces that a task has not met before are its small corpus: their bytes stand in one array with links to the
neighbours, and an inverted index holds, for the token that a pair of neighbours makes, the positions of all such pairs. Merges are replayed in rank order over all pieces at once: the lowest rank that
the index holds is applied at all its positions, and only the touched neighbours get new entries. A rank whose token can make a pair of a lower rank (the vocabulary says which) is applied at one position of
a piece at a time, the leftmost, so that each piece sees its merges in the order in which it would alone. Pieces longer than ``LONG`` bytes are replayed alone, by rank and position, in a heap.

Pieces met are kept, with their tokens, until they are ``KEPT`` or ``KEPT_BYTES``; then the task starts anew. The corpus is that of a task and not that of the cluster on purpose: a dictionary of all pieces grows with the
corpus, cannot be broadcast, and joining it would shuffle every occurrence of every piece. So there is no shuffle, a lost executor costs its own tasks, and a hot piece costs one look-up.
What is sent to the tasks is the vocabulary and the table of its pairs, a few megabytes that do not depend on the data.

Defined cases: a null text is empty; an empty text has no token. Bytes that are no UTF-8 are read as U+FFFD. A piece that is a token as a whole is that token. Strings of special tokens are ordinary text. Ids beyond the vocabulary are an
error in :func:`decode`, a null list is empty. Repeated rows and ids, and null ids, are rows like others; an empty table gives an empty result. Very long texts are cut into pieces
as they are read; besides the text itself, a few bytes for each piece are held. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import text_of

RANKS = "byte_bpe_50k.tiktoken"
#: Text bytes whose pieces are gathered before the new ones are replayed.
CHUNK_BYTES = 1 << 23
LONG = 96
KEPT, KEPT_BYTES = 1 << 19, 1 << 25
#: Pieces whose tokens are laid out at a time.
_RUN = 1 << 16
_NONE = np.int32(2**31 - 1)
_SHIFT = 24


class Vocabulary(NamedTuple):
    """Tokens by rank; for each pair of tokens that makes a third, its key (left << 24 | right, ascending) and the rank made; ranks that can make a pair of a lower rank."""

    tokens: list[bytes]
    keys: np.ndarray
    made: np.ndarray
    restless: np.ndarray


@cache
def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file (base64 token and rank on each line), read on the driver."""
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    pairs = []
    for token, rank in ranks.items():
        tokens[rank] = token
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs.append((left << _SHIFT | right, rank))
    pairs.sort()
    keys, made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    restless = np.zeros(len(tokens), bool)
    for side in (keys >> _SHIFT, keys & ((1 << _SHIFT) - 1)):
        restless[side[made < side]] = True
    return Vocabulary(tokens, keys, made.astype(np.int32), restless)


def _made(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left.astype(np.int64) << _SHIFT | right
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where(v.keys[at] == key, v.made[at], _NONE)


def _replay_alone(v: Vocabulary, pairs: dict[int, int], first: Sequence[int]) -> list[int]:
    """The tokens of one long piece, given as its bytes' tokens: a heap of (rank, position) in place of the index."""
    n = len(first)
    sym, after, before = list(first), [*range(1, n), -1], [-1, *range(n - 1)]
    rank = [pairs.get(sym[k] << _SHIFT | sym[k + 1], -1) for k in range(n - 1)] + [-1]
    heap = [(r, k) for k, r in enumerate(rank) if r >= 0]
    heapq.heapify(heap)
    while heap:
        r, p = heapq.heappop(heap)
        if rank[p] != r:
            continue
        q = after[p]
        s = after[p] = after[q]
        sym[p], sym[q], rank[q] = r, -1, -1
        if s >= 0:
            before[s] = p
        for x, y in ((p, s), (before[p], p)):
            if x >= 0:
                rank[x] = pairs.get(sym[x] << _SHIFT | sym[y], -1) if y >= 0 else -1
                if rank[x] >= 0:
                    heapq.heappush(heap, (rank[x], x))
    return [t for t in sym if t >= 0]


def replay(v: Vocabulary, pieces: Sequence[bytes], byte_token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all pieces, one after the other, and each piece's first index (one more at the end)."""
    size = np.array([len(p) for p in pieces], np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    n = int(off[-1])
    if not n:
        return np.zeros(0, np.int32), off
    sym = byte_token[np.frombuffer(b"".join(pieces), np.uint8)]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    some = size > 0
    after[off[1:][some] - 1] = -1
    before[off[:-1][some]] = -1
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
    made = np.full(n, _NONE, np.int32)
    left = np.flatnonzero(after >= 0)
    made[left] = _made(v, sym[left], sym[left + 1])
    live = np.ones(n, bool)
    # The index: for each rank the positions of the pairs that make it; those of the start are runs of one sorted array.
    order = np.flatnonzero(made != _NONE)
    order = order[np.argsort(made[order], kind="stable")]
    ranks, run = np.unique(made[order], return_index=True)
    start = dict(zip(ranks.tolist(), np.split(order, run[1:]), strict=True)) if len(order) else {}
    later: dict[int, list[int]] = {}
    heap = ranks.tolist()
    while heap:
        r = heapq.heappop(heap)
        at, more = start.pop(r, None), later.pop(r, None)
        if more is not None:
            at = np.unique(np.array(more, np.int64) if at is None else np.concatenate([at, np.array(more, np.int64)]))
        if at is None:
            continue
        at = at[made[at] == r]
        if len(at) > 1 and v.restless[r]:
            one = np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])
            if not one.all():
                later[r] = at[~one].tolist()
                heapq.heappush(heap, r)
                at = at[one]
        elif len(at) > 1:
            touching = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if touching.any():  # of a run of overlapping pairs, every other one from the left
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(touching, 0, place))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        follow = after[gone]
        sym[at], made[gone], live[gone], after[at] = r, _NONE, False, follow
        before[follow[follow >= 0]] = at[follow >= 0]
        back = before[at]
        touched = np.concatenate([at, back[back >= 0]])
        right = after[touched]
        found = np.full(len(touched), _NONE, np.int32)
        inner = right >= 0
        found[inner] = _made(v, sym[touched[inner]], sym[right[inner]])
        made[touched] = found
        some = found != _NONE
        for rank, p in zip(found[some].tolist(), touched[some].tolist(), strict=True):
            entries = later.get(rank)
            if entries is None:
                later[rank] = [p]
                if rank not in start:
                    heapq.heappush(heap, rank)
            else:
                entries.append(p)
    return sym[live], np.concatenate([[0], np.cumsum(live)])[off]


class _Pieces(dict):
    """The number of each piece met, and the tokens of those replayed."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v = v
        self.whole = {t: k for k, t in enumerate(v.tokens)}
        self.byte_token = np.array([self.whole.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.pairs: dict[int, int] | None = None
        self.start_anew()

    def start_anew(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.held = 0
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        self.held += len(piece)
        return number

    def full(self) -> bool:
        return len(self) > KEPT or self.held > KEPT_BYTES

    def settle(self) -> None:
        """Replays the pieces that are new."""
        if not self.new:
            return
        raw = [p.encode() for p in self.new]
        token = np.array([self.whole.get(b, -1) for b in raw], np.int32)
        short = np.flatnonzero((token < 0) & np.array([len(b) <= LONG for b in raw]))
        size = np.ones(len(raw), np.int64)
        ids, off = replay(self.v, [raw[k] for k in short], self.byte_token)
        size[short] = np.diff(off)
        alone = {}
        for k in np.flatnonzero((token < 0) & np.array([len(b) > LONG for b in raw])):
            if self.pairs is None:
                self.pairs = dict(zip(self.v.keys.tolist(), self.v.made.tolist(), strict=True))
            alone[k] = _replay_alone(self.v, self.pairs, self.byte_token[np.frombuffer(raw[k], np.uint8)].tolist())
            size[k] = len(alone[k])
        end = np.cumsum(size)
        flat = np.empty(int(end[-1]), np.int32)
        flat[end[token >= 0] - 1] = token[token >= 0]
        flat[np.arange(len(ids)) + np.repeat(end[short] - size[short] - off[:-1], np.diff(off))] = ids
        for k, tokens in alone.items():
            flat[end[k] - size[k] : end[k]] = tokens
        self.flat, self.off = np.concatenate([self.flat, flat]), np.concatenate([self.off, end + self.off[-1]])
        self.new = []

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        first, size = self.off[numbers], self.off[numbers + 1] - self.off[numbers]
        end = np.cumsum(size)
        return self.flat[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(first - end + size, size)]


class _Bytes:
    """Decodes by laying the tokens' bytes side by side."""

    def __init__(self, v: Vocabulary):
        self.raw = np.frombuffer(b"".join(v.tokens), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in v.tokens])])

    def __call__(self, ids: np.ndarray) -> bytes:
        size = self.off[ids + 1] - self.off[ids]
        end = np.cumsum(size)
        return self.raw[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.off[ids] - end + size, size)].tobytes()


def _encoded(batches: Iterator[pa.RecordBatch], v: Vocabulary, pattern: str) -> Iterator[tuple[pa.RecordBatch, list[Iterator[np.ndarray]]]]:
    """Slices of the batches and, for each of their texts, runs of tokens."""
    known, split = _Pieces(v), regex.compile(pattern)

    def runs(numbers: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(0, len(numbers), _RUN):
            yield known.tokens(numbers[k : k + _RUN])

    for batch in batches:
        for part, data, off in tk.chunks(batch, "text", CHUNK_BYTES):
            if known.full():
                known.start_anew()
            numbers = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                text = data[a:b].tobytes().decode("utf-8", "replace")
                pieces = split.findall(text) if b - a < CHUNK_BYTES else (m.group() for m in split.finditer(text))
                numbers.append(np.fromiter(map(known.__getitem__, pieces), np.int32))
            known.settle()
            yield part, [runs(x) for x in numbers]


def _mapped(docs: DataFrame, path: str | None, pattern: str, schema: str, rows: Callable[[pa.RecordBatch, list, Vocabulary], pa.RecordBatch]) -> DataFrame:
    v = load(path)
    frame = docs.select("doc_id", text_of().alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _encoded(batches, v, pattern):
            yield rows(part, texts, v)

    return frame.mapInArrow(work, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, {schema}")


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id`` and ``ids``, the tokens of the whole text."""

    def rows(part: pa.RecordBatch, texts: list, _: Vocabulary) -> pa.RecordBatch:
        ids = [np.concatenate([np.zeros(0, np.int32), *runs]) for runs in texts]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _mapped(docs, path, pattern, "ids array<int>", rows)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of ``ids``. Ids that end inside a character give U+FFFD there."""
    v = load(path)
    frame = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = _Bytes(v)
        for batch in batches:
            texts = [plain(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return frame.mapInArrow(work, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, text string")


def digest(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``doc_id``, ``n_tokens``, and SHA-256 of the ids (little-endian, 32 bits) and of the bytes that the ids decode to."""

    def rows(part: pa.RecordBatch, texts: list, v: Vocabulary) -> pa.RecordBatch:
        plain, n, ids, decoded = _Bytes(v), [], [], []
        for runs in texts:
            a, b, count = hashlib.sha256(), hashlib.sha256(), 0
            for tokens in runs:
                a.update(tokens.astype("<u4").tobytes())
                b.update(plain(tokens))
                count += len(tokens)
            n.append(count)
            ids.append(a.hexdigest())
            decoded.append(b.hexdigest())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
