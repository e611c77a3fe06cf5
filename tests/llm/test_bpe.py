"""Merge replay against the tiktoken library, over all kinds of characters, vocabularies made to be awkward, and round trips."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kinloom.llm import bpe

SCHEMA = "doc_id long, text string, ids int, n_tokens string"


def library(path=None):
    with open(path or public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_of(seed, n=200):
    r = random.Random(seed)
    scripts = ["abcdefghij THE the ing er  on's", "äöüßéèçñ ", "漢字仮名交じり文", "0123456789 ¼²", "\n\r\t   ", "!?…—“”#$%", "😀👩‍👩‍👧🏽", "हिन्दी العربية", "<|endoftext|>", "\x00\x1c\x85​"]
    word = lambda: "".join(r.choice(r.choice(scripts[:2]) if r.random() < 0.7 else r.choice(scripts)) for _ in range(r.randint(1, 9)))
    out = ["".join(word() + r.choice([" ", "", "  ", "\n\n", "'s ", "'ve", ", "]) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return out + ["a" * 5000, "ab" * 2000, "漢字" * 900, " " * 3000, "\n" * 50 + " x", "the" * 40, "=-" * 700, "".join(chr(r.choice([*range(32, 0xD7FF)])) for _ in range(4000))]


def check(rows, want):
    got = {r["doc_id"]: r for r in rows}
    for k, text in enumerate(want):
        ids = LIBRARY.encode_ordinary(text or "")
        assert (got[k]["n_tokens"], got[k]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), repr(text)[:80]
        assert got[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


LIBRARY = library()


def test_digest_is_the_librarys(spark):
    texts = [*texts_of(1), None, "", "same", "same"]
    df = bpe.digest(spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], SCHEMA).repartition(3))
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    check(df.collect(), texts)
    assert bpe.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_limits_change_nothing(monkeypatch):
    import pyarrow as pa

    texts = texts_of(2, 60)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    for name, value in (("CHUNK_BYTES", 500), ("KEPT", 30), ("_RUN", 7), ("LONG", 6)):
        monkeypatch.setattr(bpe, name, value)
        got = [np.concatenate([np.zeros(0, np.int32), *runs]).tolist() for _, each in bpe._encoded(iter([batch]), bpe.load(), public_tokenizers.PATTERN) for runs in each]
        assert got == [LIBRARY.encode_ordinary(t) for t in texts], name


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("long", [0, 1000])
def test_vocabularies_in_any_order(tmp_path, monkeypatch, seed, long):
    """Ranks dealt at random: merges that make pairs of lower ranks, one token from several pairs, overlaps."""
    r = random.Random(seed)
    tokens = {bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(40)}
    order = [bytes([b]) for b in range(256)] + r.sample(sorted(tokens), len(tokens))
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(order)))
    monkeypatch.setattr(bpe, "LONG", long)
    known, own = bpe._Pieces(bpe.load(str(path))), library(str(path))
    texts = ["".join(r.choice("abc") for _ in range(r.randint(1, 60))) for _ in range(300)] + ["a" * 77, "abc" * 30, "abab" * 20 + "c"]
    numbers = np.array([known[t] for t in texts])
    known.settle()
    assert bpe.load(str(path)).restless.any()
    assert [known.tokens(numbers[k : k + 1]).tolist() for k in range(len(texts))] == [own.encode_ordinary(t) for t in texts]


def test_round_trip(spark):
    texts = [*texts_of(3, 40), "", None]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], SCHEMA)
    encoded = bpe.encode(docs)
    assert {r[0]: list(r[1]) for r in encoded.collect()} == {k: LIBRARY.encode_ordinary(t or "") for k, t in enumerate(texts)}
    assert {r[0]: r[1] for r in bpe.decode(encoded).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert bpe.decode(spark.sql("SELECT 1 AS doc_id, CAST(NULL AS array<int>) AS ids")).first()["text"] == ""


def test_a_text_of_megabytes(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 1 << 20)
    texts = ["word and other words, " * 200_000, "x" * 300_000]
    check(bpe.digest(spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], SCHEMA)).collect(), texts)
