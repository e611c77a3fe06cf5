"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary, and each language has a probability for every piece. The probability of a
word is the sum over all its segmentations into pieces, by a forward pass over its bytes in logarithms, whatever its length; that of a text is
the product over its words. Probabilities come from expectation-maximisation (forward and backward passes) over the words of a sample.

Words are runs of letters with their marks, by Unicode class, in lower case; Spark makes them. A pass works on the distinct words
of a slice at once. From every byte, prefixes grow as long as some piece begins so; edges of the lattice come from those that are pieces.
Words already scored in a task are looked up in a table of at most CACHE words.

Fitting sample: at most ``per_language`` documents for each language, those of the smallest MD5 of the id. Their number for each
language and MD5 prefix is counted first, and only ids below the prefix that suffices are ranked.

Defined cases: a text without a letter, empty or null, is ``und`` with score 0. A tie goes to the language that sorts first.
Without any training text every document is ``und``. Rows that repeat a doc_id are judged each for itself; in the sample, an id counts once for
each language, with its smallest text. Null ids are not learned from. An empty table gives an empty result. Extra columns, whatever their names, are
not read, and :func:`known_language` returns them unchanged. A text's words are scored in slices; only a single word longer than a slice needs memory by its length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import id_remainder, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PER_LANGUAGE = 400
ROUNDS = 4
UND = "und"
CACHE = 1 << 17
#: Distinct words scored together.
BLOCK = 1 << 13


def words_of(text: Column) -> Column:
    """``text`` in lower case with only its letters, their marks, and blanks between words."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "), r"(^| )\p{M}+", " ")


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Byte pieces of a rank file that can stand in a word (lower case, a leading blank off), and all single bytes so that any word has a segmentation."""
    with open(path, "rb") as f:
        known = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    inside = lambda p: p and all(c >= 128 or chr(c).isalpha() for c in p)
    return sorted({p for p in (k.removeprefix(b" ").lower() for k in known) if inside(p)} | {bytes([b]) for b in range(256)})


class Vocabulary:
    """Hash index of all prefixes of the pieces, with the piece that a prefix is, or -1."""

    def __init__(self, pieces: list[bytes]):
        number = {p: k for k, p in enumerate(pieces)}
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        flat = pa.array(prefixes, pa.large_binary())
        data, off = tk.buffers(flat)
        h = tk.range_hash(tk.prefix(data), off[:-1], off[1:])
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array([number.get(p, -1) for p in prefixes], np.int32)[order]
        self.seen = None

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Piece number, -1 for a mere prefix, -2 where no piece begins so."""
        if self.seen is None:
            self.seen = np.zeros(1 << 22, bool)
            self.seen[self.hashes >> np.uint64(42)] = True
        out = np.full(len(h), -2, np.int32)
        may = np.flatnonzero(self.seen[h >> np.uint64(42)])
        k = np.minimum(np.searchsorted(self.hashes, h[may]), len(self.hashes) - 1)
        good = self.hashes[k] == h[may]
        out[may[good]] = self.ids[k[good]]
        return out


Group = tuple[int, int, np.ndarray, np.ndarray]


def _lattice(sums: np.ndarray, starts: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> list[Group]:
    """(end, size, words, pieces) of all edges, in order of end and size; a word occurs once in a group."""
    row = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    found, size = [], 0
    while len(row):
        size += 1
        s = starts[row] + at
        piece = vocab.lookup(tk.range_hash(sums, s, s + size))
        have = piece >= 0
        found.append((at[have] + size, np.full(int(have.sum()), size), row[have], piece[have]))
        on = (piece > -2) & (at + size < lengths[row])
        row, at = row[on], at[on]
    if not found:
        return []
    end, sizes, row, piece = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((sizes, end))
    end, sizes, row, piece = end[order], sizes[order], row[order], piece[order]
    cuts = np.flatnonzero(np.r_[True, (np.diff(end) != 0) | (np.diff(sizes) != 0), True])
    return [(int(end[a]), int(sizes[a]), row[a:b], piece[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _forward(groups: list[Group], lengths: np.ndarray, log: np.ndarray) -> np.ndarray:
    """Logarithm of the summed probability of every word's first bytes: [byte position, word, language]."""
    alpha = np.full((int(lengths.max(initial=0)) + 1, len(lengths), log.shape[1]), -np.inf)
    alpha[0] = 0
    for end, size, rows, piece in groups:
        alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - size, rows] + log[piece])
    return alpha


def _bounded(order: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of words, given in order of length: BLOCK words of up to 32 bytes, and fewer the longer they are, so that no table of a block outgrows it."""
    a = 0
    while a < len(order):
        b = min(len(order), a + BLOCK)
        while b > a + 1 and (b - a) * int(lengths[order[b - 1]]) > 32 * BLOCK:
            b = a + (b - a) // 2
        yield order[a:b]
        a = b


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language; words of like length are worked on together."""
    sums, log = tk.prefix(data), np.log(prob)
    out = np.zeros((len(starts), prob.shape[1]))
    lengths = ends - starts
    for rows in _bounded(np.argsort(lengths, kind="stable"), lengths):
        n = lengths[rows]
        alpha = _forward(_lattice(sums, starts[rows], n, vocab), n, log)
        out[rows] = alpha[n, np.arange(len(rows))]
    return out


class Scorer:
    """Scores texts; remembers the words it has scored, CACHE of them at most."""

    def __init__(self, vocab: Vocabulary, prob: np.ndarray):
        self.vocab, self.prob = vocab, prob
        self._forget()

    def _forget(self) -> None:
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, self.prob.shape[1]))

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Scores of distinct words by hash."""
        out = np.zeros((len(h), self.prob.shape[1]))
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        old = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        out[old] = self.scores[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            out[new] = word_scores(data, starts[new], ends[new], self.vocab, self.prob)
            if len(self.known) + len(new) > CACHE:
                self._forget()
            both = np.concatenate([self.known, h[new]])[: CACHE]
            order = np.argsort(both)
            self.known, self.scores = both[order], np.concatenate([self.scores, out[new]])[order]
        return out

    def texts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text in each language, and its number of words."""
        n = len(off) - 1
        total, count = np.zeros((n, self.prob.shape[1])), np.zeros(n, np.int64)
        for a, b in tk.slices(data):
            piece = data[a:b]
            i = int(np.searchsorted(off, a, "right")) - 1
            j = int(np.searchsorted(off, b, "left"))
            starts, ends, first = tk.spans(piece, np.clip(off[i : j + 1], a, b) - a)
            if not len(starts):
                continue
            h = tk.range_hash(tk.prefix(piece), starts, ends)
            distinct, one, each = np.unique(h, return_index=True, return_inverse=True)
            own = self._words(piece, starts[one], ends[one], distinct)[each]
            sums = np.zeros((len(starts) + 1, own.shape[1]))
            np.cumsum(own, axis=0, out=sums[1:])
            total[i:j] += sums[first[1:]] - sums[first[:-1]]
            count[i:j] += np.diff(first)
        return total, count


def fit(rows: list[tuple[str, str]], pieces: list[bytes], rounds: int = ROUNDS, floor: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of every piece in each: EM over the (language, text) rows, whose texts :func:`words_of` made."""
    vocab = Vocabulary(pieces)
    langs = sorted({x for x, _ in rows})
    prob = np.full((len(pieces), len(langs)), 1 / len(pieces))
    short = 0.3 ** np.minimum([len(p) for p in pieces], 3).astype(float)[:, None]
    for k, lang in enumerate(langs):
        data, off = tk.buffers(pa.array([t for x, t in rows if x == lang], pa.large_string()))
        starts, ends, _ = tk.spans(data, off)
        if not len(starts):
            continue
        sums = tk.prefix(data)
        _, one, count = np.unique(tk.range_hash(sums, starts, ends), return_index=True, return_counts=True)
        n = (ends - starts)[one]
        order = np.argsort(n, kind="stable")
        blocks = []
        for part in np.array_split(order, -(-len(order) // BLOCK)):
            for own in _bounded(part, n):
                blocks.append((_lattice(sums, starts[one][own], n[own], vocab), n[own], count[own]))
        p = short / short.sum()
        for _ in range(rounds):
            got = np.zeros(len(pieces))
            for groups, length, weight in blocks:
                log = np.log(p)
                here = np.arange(len(length))
                alpha = _forward(groups, length, log)[:, :, 0]
                beta = np.full_like(alpha, -np.inf)
                beta[length, here] = 0
                whole = alpha[length, here]
                for end, size, r, piece in reversed(groups):
                    back = beta[end, r] + log[piece, 0]
                    got += np.bincount(piece, weights=np.exp(alpha[end - size, r] + back - whole[r]) * weight[r], minlength=len(pieces))
                    beta[end - size, r] = np.logaddexp(beta[end - size, r], back)
            p = ((got + floor) / (got.sum() + floor * len(pieces)))[:, None]
        prob[:, k] = p[:, 0]
    return langs, prob


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, modulus: int = 5, held: int = 0) -> list[tuple[str, str]]:
    """At most ``per_language`` (lang, words) rows of each language outside the held-out remainder."""
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    own = own.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id"), modulus) != held))
    ids = own.select("lang", "doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("key"))
    prefix = F.substring("key", 1, 3)
    enough: dict[str, str] = {}
    so_far: dict[str, int] = {}
    for lang, head, n in sorted(map(tuple, ids.groupBy("lang", prefix.alias("head")).agg(F.approx_count_distinct("doc_id").alias("n")).collect())):
        # Twice the wanted number by the sketch, so that its error leaves none out.
        if so_far.get(lang, 0) < 2 * per_language:
            so_far[lang] = so_far.get(lang, 0) + n
            enough[lang] = head
    if not enough:
        return []
    spark = docs.sparkSession
    upto = spark.createDataFrame(sorted(enough.items()), "lang string, upto string")
    near = ids.join(F.broadcast(upto), "lang").where(prefix <= F.col("upto")).select("lang", "doc_id", "key").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))
    chosen = [tuple(r) for r in near.withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "doc_id").collect()]
    few = spark.createDataFrame(chosen, "lang string, doc_id long")
    rows = own.join(F.broadcast(few), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    return sorted((r[0], r[1]) for r in rows.select("lang", words_of(F.col("text"))).collect())


def _verdicts(shared) -> Iterator:
    """A function from a batch with a column ``words`` to its row slices, labels (the last one: none) and scores."""
    langs, prob, vocab = shared.value
    scorer = Scorer(vocab, prob)

    def judge(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for part, data, off in tk.chunks(batch, "words"):
            label, score = np.full(part.num_rows, len(langs)), np.zeros(part.num_rows)
            if langs:
                logs, n = scorer.texts(data, off)
                some = n > 0
                label[some] = logs[some].argmax(axis=1)
                score[some] = 1 / np.exp(logs[some] - logs[some].max(axis=1, keepdims=True)).sum(axis=1)
            yield part, label, score

    return judge


def _model(docs: DataFrame, path: str, per_language: int):
    pieces = load_pieces(path)
    langs, prob = fit(training_rows(docs, per_language), pieces)
    return docs.sparkSession.sparkContext.broadcast((langs, prob, Vocabulary(pieces)))


def identify(docs: DataFrame, path: str = VOCABULARY, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (posterior of the prediction under equal priors) of every document."""
    shared = _model(docs, path, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, names = _verdicts(shared), np.array([*shared.value[0], UND])
        for batch in batches:
            for part, label, score in judge(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names[label], pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), words_of(text_of()).alias("words"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, least: float = 0.5, path: str = VOCABULARY, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` without the documents whose language is undetermined or less likely than ``least``; columns unchanged."""
    shared = _model(docs, path, per_language)

    @F.arrow_udf("boolean")
    def known(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge, und = _verdicts(shared), len(shared.value[0])
        for column in columns:
            parts = [pa.array((label != und) & (score >= least)) for _, label, score in judge(pa.RecordBatch.from_arrays([column], names=["words"]))]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.bool_())

    return docs.where(known(words_of(text_of())))
