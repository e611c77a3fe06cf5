"""Language-model scoring with a gated recurrent network.

The output is factored into classes: the ``TOP`` most frequent tokens form classes of ``WITHIN`` by rank, and all other tokens form
one more class, inside which a token has its add-one share of the class's count. A network of one gated recurrent layer, whose output biases
start at the logarithms of the counts, is trained by truncated backpropagation in numpy; its state runs through a document's windows, in training and in
scoring, so a document's score is the log-probability of all of it, its end included.

Counts and network cover all training documents, each of which the network reads once. The documents are dealt to ``ROUNDS`` rounds and in
each round to shards of about ``SHARD_TOKENS`` tokens by the hash of the id; every shard trains a copy of the weights so far, and the
copies are averaged, weighted by tokens. A shard is a stream of windows: a trainer holds LANES documents at a time, fewer where the corpus is small. Averages are summed on executors;
the driver reads ``SUMS`` of them at most.

Texts are read twice: once for the counts, once for token numbers (two bytes a token) and the sums of the base score, which are written. The
``KNOWN`` most frequent tokens are broadcast (a bounded table); only occurrences of rarer tokens are shuffled, as hashes, and meet
their counts in a join.

Defined cases: a null, empty or white text is its end token alone. Without training documents every token is unseen: N and V are 0, and the
model's score equals the base score. Rows that repeat a doc_id are scored, and learned from, each for itself; a null id is held out if the remainder of
the empty text says so. Tokens of equal count go by hash. An empty table gives an empty result. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import id_remainder, settle, text_of

TOP, WITHIN, HIDDEN = 2048, 64, 24
KNOWN = 1 << 17
WINDOW, LANES = 20, 384
SHARD_TOKENS = 4_000_000
ROUNDS = 2
SUMS = 32
#: Windows that a shard should give at least: one of few tokens has so many fewer lanes, LEAST_LANES at least.
STEPS, LEAST_LANES = 300, 16
#: Step of the optimiser after WARM steps. A step takes half the tokens of a full window at least; where few long documents are left, their windows are gathered until it has them.
RATE, WARM = 0.015, 20
END = tk.hash_bytes(b"\n")
_LN10 = float(np.log(10.0))


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end token included, and first indexes."""
    h, first = tk.words(data, off)
    n = len(off) - 1
    start = first + np.arange(n + 1)
    out = np.full(len(h) + n, np.uint64(END))
    if len(h):
        out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))] = h
    return out, start


def token_counts(texts: DataFrame) -> DataFrame:
    """``token`` (hash) and ``c`` over all texts, counted in each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(_tokens(data, off)[0], return_counts=True) for _, data, off in tk.chunks(batch, "text")]
            if found:
                keys, inverse = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                counts = np.bincount(inverse, weights=np.concatenate([c for _, c in found])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(tk.as_long(keys)), pa.array(counts)], names=["token", "c"])

    return texts.select("text").mapInArrow(run, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Lexicon:
    """Known tokens by hash; the first TOP of them, by rank, are the network's."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(hashes)
        self.hashes, self.rank = hashes[order], order.astype(np.int32)
        self.log = np.log10(counts + 1.0)[order]
        self.total, self.distinct = total, distinct
        self.top = min(TOP, len(hashes))
        self.classes = -(-self.top // WITHIN) + 1
        #: Number of every token that is not among the top ones.
        self.rest = (self.classes - 1) * WITHIN
        #: Counts by number; what no token has stays at 0.
        self.counts = np.zeros(self.rest + 1)
        self.counts[: self.top] = counts[: self.top]
        self.counts[self.rest] = max(total - int(counts[: self.top].sum()), 0)
        self.norm = float(np.log10(total + distinct + 1))
        rest = total - int(counts[: self.top].sum()) + distinct - self.top + 1
        self.rest_norm = float(np.log10(max(rest, 1)))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the sorted table (or -1) and number for the network."""
        if not len(self.hashes):
            return np.full(len(h), -1), np.full(len(h), self.rest, np.int32)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        k[self.hashes[k] != h] = -1
        number = np.where(k >= 0, self.rank[k], self.top)
        return k, np.where(number < self.top, number, self.rest).astype(np.int32)


def start(counts: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights whose output is the unigram distribution of ``counts`` (by number, the class of the rest last), whatever the state."""
    r = np.random.Generator(np.random.PCG64(seed))
    h, classes = HIDDEN, (len(counts) - 1) // WITHIN + 1
    small = lambda *s: (r.standard_normal(s) * (0.5 / np.sqrt(h))).astype(np.float32)
    own = np.maximum(counts[:-1].reshape(classes - 1, WITHIN), 1e-6)
    bias = np.log(np.concatenate([own.sum(axis=1), [counts[-1] + 1]]))
    return {
        "x": small(len(counts) + 1, h) * np.float32(2), "i": small(h, 3 * h), "u": small(h, 3 * h), "b": np.zeros(3 * h, np.float32), "c": small(h, classes) * np.float32(0.1), "cb": (bias - bias.max()).astype(np.float32),
        "w": small(classes - 1, h, WITHIN) * np.float32(0.1), "wb": np.log(own / own.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def _step(p: dict, a: np.ndarray, s: np.ndarray):
    """One step of the gated layer from its input's part of the gates: (new state, gates, state's part of the candidate, candidate)."""
    h = HIDDEN
    m = s @ p["u"]
    # The logistic function of the reset and update gates, by way of tanh.
    g = a[:, : 2 * h] + m[:, : 2 * h]
    g *= 0.5
    np.tanh(g, out=g)
    g *= 0.5
    g += 0.5
    q = m[:, 2 * h :]
    n = g[:, :h] * q
    n += a[:, 2 * h :]
    np.tanh(n, out=n)
    new = s - n
    new *= g[:, h:]
    new += n
    return new, g, q, n


def _softmax(a: np.ndarray) -> np.ndarray:
    """Rows of ``a`` to probabilities, in place; logits beyond 60 in size count as 60."""
    np.clip(a, -60, 60, out=a)
    np.exp(a, out=a)
    a *= (1 / (a @ np.ones(a.shape[1], a.dtype)))[:, None]
    return a


def _within(p: dict, states: np.ndarray, y: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose token is not of the last class, in order of class; their states; each class's first row; probabilities within the class."""
    cls = y // WITHIN
    order = np.argsort(cls.astype(np.int16), kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(classes))
    order = order[: cuts[-1]]
    own = states[order]
    out = np.empty((len(order), WITHIN), states.dtype)
    for k in range(classes - 1):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            np.add(own[a:b] @ p["w"][k], p["wb"][k], out=out[a:b])
    return order, own, cuts, _softmax(out)


def log_probabilities(p: dict, states: np.ndarray, y: np.ndarray, classes: int) -> np.ndarray:
    """Natural log-probability of each next token given its state; for the rest class, that of the class."""
    of_class = states @ p["c"]
    of_class += p["cb"]
    of_class = _softmax(of_class)[np.arange(len(y)), y // WITHIN]
    order, _, _, within = _within(p, states, y, classes)
    out = np.log(np.maximum(of_class, 1e-30), dtype=np.float64)
    out[order] += np.log(np.maximum(within[np.arange(len(order)), y[order] % WITHIN], 1e-30))
    return out


def _window(p: dict, xs: np.ndarray, ys: np.ndarray, live: np.ndarray, s: np.ndarray, classes: int) -> tuple[dict, np.ndarray, np.ndarray, int]:
    """Gradients over one window of steps (for ``x``, those of its rows that the window has, and these), last state, live steps; gradients stop at the window's start."""
    h, (steps, lanes) = HIDDEN, xs.shape
    kind = p["u"].dtype
    entered = p["x"][xs.reshape(-1)]
    a = entered @ p["i"]
    a += p["b"]
    a = a.reshape(steps, lanes, 3 * h)
    states = np.empty((steps + 1, lanes, h), kind)
    gates, qs, ns = (np.empty((steps, lanes, k), kind) for k in (2 * h, h, h))
    states[0] = s
    for t in range(steps):
        states[t + 1], gates[t], qs[t], ns[t] = _step(p, a[t], states[t])
    flat, y, on = states[1:].reshape(-1, h), ys.reshape(-1), live.reshape(-1)
    every = np.arange(len(y))
    e = flat @ p["c"]
    e += p["cb"]
    e = _softmax(e)
    e[every, y // WITHIN] -= 1
    e *= on[:, None]
    g = {"c": flat.T @ e, "cb": np.ones(len(e), kind) @ e, "w": np.zeros_like(p["w"]), "wb": np.zeros_like(p["wb"])}
    d = e @ p["c"].T
    rest = (classes - 1) * WITHIN
    order, own, cuts, v = _within(p, flat, np.where(on > 0, y, rest), classes)
    v[np.arange(len(order)), y[order] % WITHIN] -= 1
    down = np.empty_like(own)
    for k in range(classes - 1):
        i, j = cuts[k], cuts[k + 1]
        if i < j:
            g["w"][k], g["wb"][k] = own[i:j].T @ v[i:j], np.ones(j - i, kind) @ v[i:j]
            np.matmul(v[i:j], p["w"][k].T, out=down[i:j])
    d[order] += down
    d = d.reshape(steps, lanes, h)
    r, z = gates[:, :, :h], gates[:, :, h:]
    # What does not depend on later steps is computed for all steps at once.
    keep = 1 - z
    to_n, to_z = keep * (1 - ns * ns), (states[:-1] - ns) * (z * keep)
    to_r = qs * (r * (1 - r))
    into, inner = np.empty((steps, lanes, 3 * h), kind), np.empty((steps, lanes, h), kind)
    back = np.zeros((lanes, h), kind)
    to_gates, to_inner = np.ascontiguousarray(p["u"][:, : 2 * h].T), np.ascontiguousarray(p["u"][:, 2 * h :].T)
    for t in reversed(range(steps)):
        back += d[t]
        dn = np.multiply(back, to_n[t], out=into[t, :, 2 * h :])
        np.multiply(dn, to_r[t], out=into[t, :, :h])
        np.multiply(back, to_z[t], out=into[t, :, h : 2 * h])
        np.multiply(dn, r[t], out=inner[t])
        back *= z[t]
        back += into[t, :, : 2 * h] @ to_gates
        back += inner[t] @ to_inner
    into = into.reshape(-1, 3 * h)
    before = states[:-1].reshape(-1, h).T
    g["u"], g["b"] = np.concatenate([before @ into[:, : 2 * h], before @ inner.reshape(-1, h)], axis=1), np.ones(len(into), kind) @ into
    x = xs.reshape(-1)
    order = np.argsort(x.astype(np.int16 if len(p["x"]) < 1 << 15 else np.int32), kind="stable")
    cut = np.flatnonzero(np.diff(x[order], prepend=-1))
    g["i"] = entered.T @ into
    g["x"] = np.add.reduceat((into @ p["i"].T)[order], cut)
    return g, x[order][cut], states[-1], int(on.sum())


def _windows(d: np.ndarray, begin: int) -> list[np.ndarray]:
    """A document's windows: the token before, WINDOW tokens, and -1 where it is over."""
    n = -(-len(d) // WINDOW)
    padded = np.full(n * WINDOW + 1, -1, np.int64)
    padded[0], padded[1 : len(d) + 1] = begin, d
    return [padded[k : k + WINDOW + 1] for k in range(0, n * WINDOW, WINDOW)]


def lanes_of(tokens: float) -> int:
    """Documents to hold at a time for a shard of so many tokens."""
    return int(min(LANES, max(LEAST_LANES, tokens / (WINDOW * STEPS))))


def _gathered(held: tuple[dict, np.ndarray, int] | None, g: dict, rows: np.ndarray, n: int, height: int) -> tuple[dict, np.ndarray, int]:
    """Gradients added to those held: (gradients, input rows with one, tokens)."""
    if held is None:
        return g, rows, n
    total, seen, m = held
    x = np.zeros((height, HIDDEN), g["x"].dtype)
    x[seen] = total["x"]
    x[rows] += g["x"]
    every = np.union1d(seen, rows)
    return {k: x[every] if k == "x" else total[k] + v for k, v in g.items()}, every, m + n


def train(p: dict, texts: Iterable[np.ndarray], classes: int, width: int | None = None) -> tuple[dict, int]:
    """Adam over windows of WINDOW tokens; ``width`` documents run side by side, each state through its document's windows. Input rows change only in steps that have them.

    All tokens are learned from, and a step never rests on a few: the last windows of a shard, in which only its longest documents go on, are gathered,
    and what is left at the end is a step smaller by what it lacks.
    """
    width = LANES if width is None else width
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    seen, t, more, held, full = 0, 0, True, None, WINDOW * width
    begin = (classes - 1) * WITHIN + 1
    queue = iter(texts)
    lanes: list[Iterator[np.ndarray]] = []
    s = np.zeros((0, HIDDEN), np.float32)
    while True:
        # A lane whose document is over takes the next one; when there is none, it is given up.
        parts = [next(lane, None) for lane in lanes]
        on = [k for k, v in enumerate(parts) if v is not None]
        lanes, parts = [lanes[k] for k in on], [parts[k] for k in on]
        while more and len(lanes) < width:
            d = next(queue, None)
            if d is None:
                more = False
            elif len(d):
                lanes.append(iter(_windows(d, begin)))
                parts.append(next(lanes[-1]))
        if lanes:
            s = np.concatenate([s[on], np.zeros((len(lanes) - len(on), HIDDEN), np.float32)])
            both = np.ascontiguousarray(np.concatenate(parts).reshape(len(parts), WINDOW + 1).T)
            live = both[1:] >= 0
            np.maximum(both, 0, out=both)
            g, rows, s, n = _window(p, both[:-1], both[1:], live.astype(np.float32), s, classes)
            seen, held = seen + n, _gathered(held, g, rows, n, len(p["x"]))
            if 2 * held[2] < full:
                continue
        elif held is None:
            break
        (g, rows, n), held, t = held, None, t + 1
        step = RATE * min(1.0, t / WARM) / (1 + t / 400) ** 0.5 * min(1.0, 2 * n / full)
        for k, v in g.items():
            v /= n
            at = rows if k == "x" else slice(None)
            m = first[k][at]
            m += 0.1 * (v - m)
            v *= v
            w = second[k][at]
            w += 0.01 * (v - w)
            np.sqrt(w, out=v)
            v *= (1 - 0.99**t) ** -0.5
            v += 1e-6
            np.divide(m, v, out=v)
            v *= step / (1 - 0.9**t)
            if k == "x":
                first[k][at], second[k][at] = m, w
            p[k][at] -= v
    return p, seen


def _pack(p: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def _unpack(b: bytes) -> dict:
    with np.load(io.BytesIO(b)) as f:
        return {k: f[k] for k in f.files}


def _width(lexicon: Lexicon) -> type:
    return np.int16 if lexicon.rest < 1 << 15 else np.int32


def _trainer(now, lex, width: int):
    """Trains one copy over the shard that a partition holds, document by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _width(lex.value)
        texts = (np.frombuffer(v.as_buffer(), kind) for batch in batches for v in batch.column(0))
        p, seen = train(_unpack(now.value), texts, lex.value.classes, width)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(p)], pa.binary()), pa.array([seen], pa.int64())], names=["weights", "seen"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all copies of a partition: their mean by tokens, and the tokens."""
    total, mean = 0, {}
    for batch in batches:
        for w, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            for k, v in _unpack(w.as_buffer().to_pybytes()).items():
                mean[k] = mean.get(k, 0) + v.astype(np.float64) * n
            total += n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([_pack({k: v / total for k, v in mean.items()})], pa.binary()), pa.array([total], pa.int64())], names=["weights", "seen"])


def learn(numbered: DataFrame, lexicon: Lexicon) -> dict:
    """Weights from all rows of ``numbered`` (doc_id, numbers): a round's shards are trained side by side and averaged."""
    spark = numbered.sparkSession
    p = start(lexicon.counts)
    lex = spark.sparkContext.broadcast(lexicon)
    shards = max(1, round(lexicon.total / SHARD_TOKENS / ROUNDS))
    dealt = numbered.select("numbers", F.pmod(F.xxhash64("doc_id", F.xxhash64("numbers")), F.lit(ROUNDS * shards)).alias("deal"), F.xxhash64("numbers", F.lit(2)).alias("order"))
    schema = "weights binary, seen long"
    for k in range(ROUNDS):
        now = spark.sparkContext.broadcast(_pack(p))
        own = dealt.where(F.col("deal") % ROUNDS == k).repartitionByRange(shards, "deal") if shards > 1 else dealt.where(F.col("deal") % ROUNDS == k).coalesce(1)
        # The longest first, so that none is left to run alone at the end; the others by hash.
        own = own.sortWithinPartitions(F.desc(F.greatest(F.length("numbers"), F.lit(8192))), "order", "numbers").select("numbers")
        parts = settle(own.mapInArrow(_trainer(now, lex, lanes_of(lexicon.total / ROUNDS / shards)), schema), "weights")
        sums = settle(parts.repartition(min(SUMS, shards)).mapInArrow(_summed, schema), "averages")
        rows = sums.collect()
        total = sum(r["seen"] for r in rows)
        if total:
            own_p = [(r["seen"], _unpack(bytes(r["weights"]))) for r in rows]
            p = {name: (sum(v[name] * n for n, v in own_p) / total).astype(np.float32) for name in p}
    return p


def score_texts(p: dict, numbers: np.ndarray, first: np.ndarray, classes: int, lanes: int = 1024) -> np.ndarray:
    """Natural log-probability of every whole text; texts of like length run side by side, and a state runs through all of its text."""
    n = len(first) - 1
    out = np.zeros(n)
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    inputs = p["x"] @ p["i"] + p["b"]
    for a in range(0, n, lanes):
        docs = order[a : a + lanes]
        size = length[docs]
        s = np.zeros((len(docs), HIDDEN), np.float32)
        x = np.full(len(docs), (classes - 1) * WITHIN + 1)
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        for t, m in enumerate(active):
            s, *_ = _step(p, inputs[x[:m]], s[:m])
            x = numbers[first[docs[:m]] + t]
            held.append((s, x, docs[:m]))
            rows += m
            if rows >= 8192:
                _flush(p, held, classes, out)
                held, rows = [], 0
        if held:
            _flush(p, held, classes, out)
    return out


def _flush(p: dict, held: list, classes: int, out: np.ndarray) -> None:
    s, y, d = (np.concatenate([h[k] for h in held]) for k in range(3))
    out += np.bincount(d, weights=log_probabilities(p, s, y, classes), minlength=len(out))


def _numbered(lex):
    """Each row's token numbers, the sums of its base score over known tokens, and the hashes of its other tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = lex.value
        kind = _width(lexicon)
        for batch in batches:
            for part, data, off in tk.chunks(batch, "text"):
                h, first = _tokens(data, off)
                place, number = lexicon.find(h)
                owner = np.repeat(np.arange(part.num_rows), np.diff(first))
                seen, tail = place >= 0, number == lexicon.rest
                log = np.where(seen, lexicon.log[place] if len(lexicon.log) else 0.0, 0.0)
                fold = lambda w: np.bincount(owner, weights=w, minlength=part.num_rows)
                rare = np.zeros(part.num_rows + 1, np.int32)
                np.cumsum(np.bincount(owner[~seen], minlength=part.num_rows), out=rare[1:])
                packed = number.astype(kind)
                places = pa.array((first * packed.itemsize).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(fold(seen).astype(np.int64)), pa.array(fold(tail).astype(np.int64)), pa.array(fold(log)), pa.array(fold(np.where(tail, log, 0.0))),
                        pa.Array.from_buffers(pa.binary(), part.num_rows, [None, places.buffers()[1], pa.py_buffer(packed.tobytes())]), pa.ListArray.from_arrays(pa.array(rare), pa.array(tk.as_long(h[~seen]))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "known", "tail", "log_all", "log_tail", "numbers", "rare"],
                )

    return run


def _network(shared):
    """Adds ``net``, the network's log10 probability, in place of ``numbers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, kind, packed = shared.value
        p = _unpack(packed)
        for batch in batches:
            data, off = tk.buffers(batch.column(batch.num_columns - 1))
            numbers = data.copy().view(kind).astype(np.int64)
            net = score_texts(p, numbers, off // np.dtype(kind).itemsize, classes) if p else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(net / _LN10)], names=[*batch.schema.names[:-1], "net"])

    return run


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent tokens, KNOWN at most, in order; no more than these reach the driver.

    All tokens of a count are in or out, unless fewer than TOP would be in.
    """
    above, least = 0, 1 << 62
    for c, n in sorted(map(tuple, counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
        if above + n > KNOWN:
            break
        above, least = above + n, c
    known = counts.where(F.col("c") >= least) if above >= min(TOP, KNOWN) else counts.orderBy(F.desc("c"), "token").limit(KNOWN)
    known = known.toArrow()
    token, c = known.column("token").to_numpy(), known.column("c").to_numpy()
    order = np.lexsort((token, -c))
    return token[order].view(np.uint64), c[order]


def score(docs: DataFrame, modulus: int = 7, held: int = 2) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(F.col("doc_id"), modulus) == held).alias("held_out"), text_of().alias("text"))
    counts = settle(token_counts(rows.where("not held_out")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    lexicon = Lexicon(*_most_frequent(counts), int(total[0]), int(total[1]))
    sums = "doc_id long, held_out boolean, n_tokens long, known long, tail long, log_all double, log_tail double"
    numbered = rows.mapInArrow(_numbered(spark.sparkContext.broadcast(lexicon)), f"{sums}, numbers binary, rare array<long>")
    numbered = settle(numbered.withColumn("row", F.monotonically_increasing_id()), "numbered")
    weights = learn(numbered.where("not held_out").select("doc_id", "numbers"), lexicon) if lexicon.top else {}
    shared = spark.sparkContext.broadcast((lexicon.classes, _width(lexicon), _pack(weights)))
    scored = numbered.select("row", *[c.split()[0] for c in sums.split(", ")], "numbers").mapInArrow(_network(shared), f"row long, {sums}, net double")
    rare = numbered.select("row", F.explode("rare").alias("token"))
    found = rare.join(counts, "token").groupBy("row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_log"))
    out = scored.join(found, "row", "left").na.fill({"more": 0, "more_log": 0.0})
    base = F.col("log_all") + F.col("more_log") - F.col("n_tokens") * F.lit(lexicon.norm)
    net = F.col("net") + F.col("log_tail") + F.col("more_log") - F.col("tail") * F.lit(lexicon.rest_norm)
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).cast("long").alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (net if lexicon.top else base).alias("score"),
    )
