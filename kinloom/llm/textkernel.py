"""Vectorised text primitives over Arrow buffers.

A batch of texts is one byte buffer and an offset array. Words are found with
look-up tables, and each word gets a 64-bit hash from prefix sums of a polynomial
with a random value for each byte, so the cost is a few array passes for each byte
and no Python call for each word. A hash stands for its word: two of a billion random
words collide with a probability of about 0.03. (Words made for the purpose can collide: the polynomial's base is fixed.)

Texts of any length are hashed in slices that end at separators, so temporary arrays are bounded and
what grows with a text is 16 bytes for each of its words. Only a single word longer than a slice needs more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)

#: Text bytes of the rows worked on together (one row at least).
CHUNK_BYTES = 1 << 20
#: Text bytes hashed at a time; temporary arrays take about 40 times as much.
SLICE_BYTES = 1 << 19


def _flags(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: White space of the word pattern.
SPACE = _flags(b" \t\n\v\f\r")
#: White space, control characters and ASCII punctuation: leaves letters, digits and bytes of longer characters.
NON_WORD = _flags(bytes(c for c in range(128) if not chr(c).isalnum()))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _codes(seed: int) -> np.ndarray:
    r = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 256, dtype=np.uint64)
    return (r << np.uint64(1)) | np.uint64(1)


_CODE = _codes(11)
_CODE_LOWER = _CODE[LOWER]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _IPOW
    if len(_POW) < n:
        size = max(n, 2 * len(_POW))
        for name, step in (("_POW", _BASE), ("_IPOW", _INV)):
            a = np.full(size, np.uint64(step & _M64))
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _POW, _IPOW


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    dtype = np.int64 if wide else np.int32
    n = len(column)
    offsets = np.frombuffer(off, dtype, count=n + 1, offset=column.offset * np.dtype(dtype).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of ``batch`` of about ``limit`` bytes of ``column`` (one row at least), each with its bytes and offsets."""
    data, off = buffers(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, "right")) - 1
        end = min(n, max(row + 1, end))
        yield batch.slice(row, end - row), data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def spans(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside = ~separators[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = off[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off).astype(np.int64)


def prefix(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows; the first is 0."""
    out = np.zeros(len(data) + 1, np.uint64)
    power, _ = _powers(len(data) + 1)
    np.cumsum((_CODE_LOWER if lower else _CODE)[data] * power[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(sums))
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def slices(data: np.ndarray, separators: np.ndarray = SPACE) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SLICE_BYTES that cover ``data`` and cut no word."""
    begin, n = 0, len(data)
    while begin < n:
        end = min(n, begin + SLICE_BYTES)
        while end < n:
            cut = np.flatnonzero(separators[data[end : end + 4096]])
            if len(cut):
                end += int(cut[0])
                break
            end = min(n, end + 4096)
        yield begin, end
        begin = end


def words(data: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (ASCII letters in lower case), and each text's first word index."""
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in slices(data, separators):
        inner = off[np.searchsorted(off, a, "right") : np.searchsorted(off, b, "left")]
        starts, ends, _ = spans(data[a:b], np.concatenate([[a], inner, [b]]) - a, separators)
        hashes.append(range_hash(prefix(data[a:b], lower), starts, ends))
        places.append(starts + a)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), off).astype(np.int64)


def hash_bytes(word: bytes) -> int:
    """The hash that :func:`words` gives to one word."""
    data = np.frombuffer(word, np.uint8)
    return int(range_hash(prefix(data), np.array([0]), np.array([len(data)]))[0])


_STEP = _codes(23)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles and each text's first index.

    A text of fewer words (but one at least) has its whole sequence as its only shingle.
    """
    counts = np.diff(first)
    n = len(hashes)
    own = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    start = np.zeros(len(first), np.int64)
    np.cumsum(own, out=start[1:])
    total = int(start[-1])
    if not total:
        return np.zeros(0, np.uint64), start
    at = np.arange(total) + np.repeat(first[:-1] - start[:-1], own)
    length = np.repeat(np.minimum(counts, size), own)
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    short = bool((length < size).any())
    for j in range(size):
        part = padded[at + j] * _STEP[j]
        part ^= part >> np.uint64(29)
        if short:
            part[length <= j] = 0
        out += part * _STEP[j + 64]
    return mix64(out + length.astype(np.uint64)), start


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed longs, bit for bit."""
    return x.astype(np.uint64, copy=False).view(np.int64)
