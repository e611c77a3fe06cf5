"""Every operator on small tables against brute force, with the awkward cases: null, empty and long texts, ties, repeats, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinloom.llm import decontam, langid, lines, lm, minhash, mixing, pii, quality_model, quality_rules, textkernel, toxicity
from kinloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken int"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def prose(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join("".join(LETTERS[(k * 7 + j * j) % 26] for j in range(2 + k % 5)) for k in (int(vocabulary * r.random() ** 2) for _ in range(n)))


def corpus(r: random.Random, n: int = 60) -> list[tuple]:
    rows = [(k, prose(r, r.randint(20, 120)), "en" if k % 2 else "de", f"s{k % 3}", 0, k) for k in range(n)]
    rows += [(n, None, "en", None, 0, 0), (n + 1, "", None, "s0", 0, 0), (n + 2, " \n\t ", "en", "s1", 0, 0), (n + 3, "one", "en", "s1", 0, 0), (n + 4, "x" * 50_000, "de", "s2", 0, 0), (n + 5, prose(r, 6000), "de", "s2", 0, 0)]
    rows += [(n + 6, rows[3][1], "en", "s0", 0, 0), (n + 7, rows[3][1] + " extra", "en", "s0", 0, 0), (n + 8, rows[3][1].upper(), "de", "s1", 0, 0)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus(random.Random(1))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().lower().split()


# ---- kernel ------------------------------------------------------------------------------------------


def test_word_hashes_tell_words_apart():
    texts = ["Ab c\x0bd", "", "  ", "ab é", "x y z"]
    h, first = textkernel.words(*textkernel.buffers(pa.array(texts)))
    got = [[int(x) for x in h[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [[textkernel.hash_bytes(w) for w in words(t)] for t in texts]
    assert len(set(sum(got, []))) == len({w for t in texts for w in words(t)})


def test_shingles_and_chunks():
    texts = ["a b c d", "a b", "", "a b c d"]
    h, first = textkernel.words(*textkernel.buffers(pa.array(texts)))
    g, start = textkernel.shingles(h, first, 3)
    assert list(np.diff(start)) == [2, 1, 0, 2] and list(g[:2]) == list(g[-2:]) and g[2] not in g[:2]
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None])], names=["text"])
    assert [p.num_rows for p, _, _ in textkernel.chunks(batch, "text", 7)] == [1, 2, 2] or sum(p.num_rows for p, _, _ in textkernel.chunks(batch, "text", 7)) == 5


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 30)] + [(50, 40), (40, 50), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(31)}, 40: 40, 50: 40} and components(edges.limit(0)).count() == 0


# ---- 1 mixing -------------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows, none):
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    size = {d: len(words(t)) for d, t, *_ in rows}
    source = {d: s for d, _, _, s, *_ in rows}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    total = {s: sum(size[d] for d in size if source[d] == s) for s in names}
    goal, open_, left = {}, list(names), float(sum(total.values()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            goal.update(share)
            break
        for s in over:
            goal[s] = 3.0 * total[s]
            left -= goal[s]
            open_.remove(s)
    for d in size:
        assert got[d]["size"] == size[d] and got[d]["source_size"] == total[source[d]] and got[d]["target"] == pytest.approx(goal[source[d]]) and got[d]["taken"] <= 3 * size[d]
    for s in names:
        assert abs(sum(got[d]["taken"] for d in size if source[d] == s) - goal[s]) <= 1
    assert mixing.mix(none).count() == 0
    uses = mixing.mixed_documents(docs).collect()
    per = defaultdict(int)
    for r in uses:
        per[r["doc_id"]] += r["taken"]
    assert dict(per) == {d: r["taken"] for d, r in got.items() if r["taken"]} and all(0 <= r["position"] <= 1 for r in uses)


# ---- 2 personal data ------------------------------------------------------------------------------------------


def test_pii_against_plain_patterns(spark):
    import re

    r = random.Random(4)
    bits = ["a.b@c.de", "@x.y", "a@b", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (499) 555-6503", "+12", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "é", "a@b..c", "tel 555-123-4567", "GB82 WEST 1234 5698 7654 32", "-", " "]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", ",", "\n"]) for _ in range(r.randint(0, 14))) for _ in range(300)] + ["9" * 3000, "a" * 30_000 + "@b.c", "+1" + "(" * 5000]
    for t in texts:
        want = []
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t if len(t) < 20_000 else ""):
            want.append((m.start(), m.end(), "email"))
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t if len(t) < 2500 else ""):
            if all(int(x) <= 255 for x in m.group().split(".")):
                want.append((m.start(), m.end(), "ip"))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"[^0-9]", "", m.group())
            if 14 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
                want.append((m.start(), m.end(), "card"))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
                want.append((m.start(), m.end(), "phone"))
        if len(t) < 20_000:
            got = [(s, e, k) for s, e, k, _ in pii.find(t) if k in pii.BASE]
            assert got == sorted(want, key=lambda x: (x[0], pii.KINDS.index(x[2]))), t
    assert [k for *_, k, _ in pii.find("a" * 30_000 + "@b.c")] == ["email"]
    assert "iban" in [k for *_, k, _ in pii.find("iban GB82 WEST 1234 5698 7654 32 ok")] and not pii.find("iban GB83 WEST 1234 5698 7654 32 ok")
    assert [k for *_, k, _ in pii.find("GB82 WEST 1234 5698 7654 32 and GB82WEST12345698765432")] == ["iban"] * 2
    odd = "GB82WE ST1234 569876 5432"
    assert not pii.find(f"see {odd}") and [k for *_, k, _ in pii.find(f"my bank account {odd}")] == ["iban"] and not pii.find(f"order GB82 WEST 1234 5698 7654 32")
    assert not pii.find("call about order 555-123-4567") and pii.find("a@b.cd order +1 499 555 6503")[1][2:] == ("phone", 0.5) and pii.find("call +1 499 555 6503")[0][3] == 1.1
    many = "call 555-123-4567, 1.2.3.4, a@b.cd; " * 3000
    assert len(pii.find(many)) == 9000
    assert [k for *_, k, _ in pii.find("call 555-123-4567 now")] == ["phone_local"] and not pii.find("item 555-123-4567 now")


def test_pii_digest(spark, docs, rows, none):
    df = docs.unionByName(spark.createDataFrame([(900, "é a@b.cd", None, None, 0, 0)], SCHEMA))
    got = {r["doc_id"]: r for r in pii.digest(df).collect()}
    assert got[900]["n_email"] == 1 and got[900]["spans"] == "email:2:8" and got[900]["base_sha256"] == hashlib.sha256(b"email:2:8").hexdigest()
    assert got[60]["base_sha256"] == hashlib.sha256(b"").hexdigest() and len(got) == len(rows) + 1 and pii.digest(none).count() == 0


# ---- 3 decontamination ---------------------------------------------------------------------------------


def test_decontamination(spark, docs, none):
    r = random.Random(9)
    items = [(k, prose(r, 30, 3000)) for k in range(6)] + [(20, "Too short!"), (21, None), (22, "five words of their own"), (23, ""), (24, "too SHORT")]
    items += [(30, items[0][1]), (None, prose(r, 30, 3000))]
    bench = spark.createDataFrame(items, "item_id int, text string").withColumn("tokens", F.lit(1))
    w = items[1][1].split()
    for k in range(4, 30, 6):
        w[k] = "zzz"
    half = items[2][1].split()[:8]
    planted = [(500, prose(r, 50) + " " + items[0][1].upper().replace(" ", ", ") + " " + prose(r, 50)), (501, "start " + " ".join(w) + " end"), (502, " ".join(half) + " " + prose(r, 80)), (503, items[3][1]), (503, items[3][1])]
    planted += [(504, "too ... short? " + prose(r, 9)), (505, "five WORDS of their, own"), (506, "five words of his own"), (507, "five words of"), (508, "their own"), (503, prose(r, 40)), (None, items[4][1])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string")).withColumns({"mark": F.lit(1), "item_id": F.lit(2)})
    for block in (1 << 19, 40):
        got = sorted(((x["doc_id"], x["item_id"], x["item_words"]) for x in decontam.contamination(df, bench, block_words=block).collect()), key=str)
        assert got == sorted([(500, 0, 30), (501, 1, 30), (503, 3, 30), (503, 3, 30), (504, 20, 2), (505, 22, 5), (None, 4, 30)], key=str), block
        kept = decontam.decontaminate(df, bench, block_words=block)
        assert kept.columns == df.columns
        assert sorted(map(repr, kept.collect())) == sorted(repr(x) for x in df.collect() if x["doc_id"] not in (500, 501, 505) and x["text"] not in (items[3][1], items[4][1]))
    assert {x["item_id"]: x["class_id"] for x in decontam.item_classes(bench).collect()} == {**{k: k for k in range(6)}, 20: 20, 24: 20, 22: 22, 30: 0}
    assert decontam.contamination(df, bench.limit(0)).count() == 0 and decontam.contamination(none, bench).count() == 0
    assert decontam.decontaminate(docs, bench).columns == docs.columns and decontam.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_against_all_alignments(monkeypatch):
    """Every alignment that a seed can find, one at a time."""
    r = random.Random(31)
    letters = [f"{c}{d}" for c in "abcdef" for d in range(6)]
    items = [[r.choice(letters) for _ in range(r.randint(1, 26))] for _ in range(25)]
    texts = []
    for _ in range(50):
        t = [r.choice(letters) for _ in range(r.randint(0, 30))]
        for item in r.sample(items, 2):
            a = r.randrange(len(item))
            t += [w if r.random() < 0.85 else r.choice(letters) for w in item[a // 2 :]] + [r.choice(letters)]
        texts.append(t)
    want = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            n = len(item)
            for shift in range(-n + 1, len(t)):
                at = [k for k in range(n) if 0 <= k + shift < len(t)]
                same = [t[k + shift] == item[k] for k in at]
                if n < 8:
                    if len(at) == n and sum(same) >= (n - 1 if n >= 6 else n):
                        want.setdefault((d, i), []).append((sum(same), -shift))
                    continue
                if not any(all(same[k + j] for j, bit in enumerate(m) if bit == "1") for m in decontam.MASKS for k in range(len(at) - len(m) + 1)):
                    continue
                best = max(((sum(same[a:b]) - 3 * (b - a - sum(same[a:b])), -b, -a) for a in range(len(at)) for b in range(a, len(at) + 1)), default=(0, 0, 0))
                a, b = -best[2], -best[1]
                # Of equal stretches: the first end, and from it the first begin.
                if sum(same[a:b]) >= max(8, math.ceil(n / 2)):
                    want.setdefault((d, i), []).append((sum(same[a:b]), -(at[0] + a + shift)))
    want = {k: (max(v)[0], -max(v)[1]) for k, v in want.items()}
    rows = [(i, textkernel.words(*textkernel.buffers(pa.array([" ".join(x)])))[0].tobytes()) for i, x in enumerate(items)]
    index = decontam.Index.of(rows)
    tokens = textkernel.words(*textkernel.buffers(pa.array([" ".join(t) for t in texts])), textkernel.NON_WORD)
    for hits in (1 << 20, 50):
        monkeypatch.setattr(decontam, "HITS", hits)
        got = {(d, i): (n, at) for d, i, n, _, at in zip(*decontam._matches(*tokens, index, 0.5, 8), strict=True)}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(got) > 20
        assert sum(got[k] == want[k] for k in got) >= 0.9 * len(got)


def test_a_passage_that_many_items_share(spark):
    """Ten thousand items begin with the same header; it is less than half of each."""
    r = random.Random(3)
    header = prose(r, 12, 3000)
    items = [(k, header + " " + " ".join(f"i{k}x{j}" for j in range(16))) for k in range(10_000)]
    docs = [(k, f"a b {header} " + " ".join(f"d{k}y{j}" for j in range(20))) for k in range(20)] + [(99, "x " + items[77][1])]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(x["doc_id"], x["item_id"], x["matched"], x["at"]) for x in got] == [(99, 77, 28, 1)]


def test_twenty_thousand_items_share_a_header():
    """A million alignments of fifty documents, in bounded portions."""
    import time

    r = np.random.default_rng(5)
    header = r.integers(1, 1 << 62, 12, dtype=np.uint64)
    index = decontam.Index.of([(k, np.concatenate([header, r.integers(1, 1 << 62, 16, dtype=np.uint64)]).tobytes()) for k in range(20_000)])
    texts = [np.concatenate([r.integers(1, 1 << 62, 3, dtype=np.uint64), header]) for _ in range(50)]
    texts.append(index.tokens[index.first[77] : index.first[78]])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    began = time.perf_counter()
    assert [x.tolist() for x in decontam._matches(np.concatenate(texts), first, index, 0.5, 8)] == [[50], [77], [28], [28], [0]]
    assert time.perf_counter() - began < 60
    assert max(len(x) for x in decontam._alignments(np.concatenate(texts), first, index)) < decontam.HITS


def test_decontamination_of_other_scripts(spark):
    """Case and punctuation by Unicode, scripts without blanks by characters, and substitutions in items of six and seven words."""
    items = [
        (1, "人们在河边种树并且每年秋天一起收获果实庆祝"), (2, "she said “never again” and left the old house for good"), (3, "ÄRGER Über die ÖFEN in der KÜCHE von gestern abend"), (4, "who wrote the great gatsby novel"),
        (5, "สวัสดีครับผมชื่อ"),
    ]
    docs = [
        (10, "昨天我听说" + items[0][1] + "这件事很好"), (11, 'then she said "never again" and left the old house for good.'), (12, "so: ärger über die öfen, in der küche von gestern abend"), (13, "tell me who wrote the big gatsby novel please"),
        (14, "tell me who wrote a big gatsby novel please"), (15, "昨天我听说这件事很好"), (16, "x ผม " + items[4][1] + " y"), (17, "ärger über die küche"), (18, "who wrote the great gatsby novel"),
    ]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"], x["matched"]) for x in decontam.contamination(df, bench).collect())
    assert [g[:2] for g in got] == [(10, 1), (11, 2), (12, 3), (13, 4), (16, 5), (18, 4)] and got[3][2] == 5 and got[5][2] == 6
    assert sorted(r[0] for r in decontam.decontaminate(df, bench).select("doc_id").collect()) == [14, 15, 17]


# ---- 4 language model ----------------------------------------------------------------------------------


def test_language_model(spark, docs, rows, none, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 40)
    monkeypatch.setattr(lm, "TOP", 30)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 700)
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, *_ in rows}
    tokens = {d: [*words(t), None] for d, t, *_ in rows}
    c = Counter(w for d in tokens if not held[d] for w in tokens[d])
    n, v = sum(c.values()), len(c)
    for d in tokens:
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens[d])
        assert got[d]["base_score"] == pytest.approx(want) and got[d]["n_tokens"] == len(tokens[d]) and got[d]["n_known"] == sum(c[w] > 0 for w in tokens[d]) and got[d]["held_out"] == held[d] and got[d]["train_tokens"] == n
        assert math.isfinite(got[d]["score"]) and got[d]["score"] < 0
    assert lm.score(none).count() == 0
    unseen = [d for d in range(2000) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    alone = lm.score(spark.createDataFrame([(d, "a b", None, None, 0, 0) for d in unseen], SCHEMA)).collect()
    assert all(r["score"] == r["base_score"] == 0.0 and r["train_tokens"] == 0 for r in alone)


def lexicon_of(texts, total=None):
    c = Counter(w for t in texts for w in [*words(t), b"\n"])
    top = [w for w, _ in c.most_common()]
    return lm.Lexicon(np.array([textkernel.hash_bytes(w) for w in top], np.uint64), np.array([c[w] for w in top]), total or sum(c.values()), len(top))


def numbers_of(texts, lexicon):
    h, first = lm._tokens(*textkernel.buffers(pa.array(texts)))
    y = lexicon.find(h)[1]
    return [y[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]


def test_network_learns_from_all_texts(spark, monkeypatch):
    """One shard over a corpus that says it is large: the weights are those of all texts."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 1 << 40)
    monkeypatch.setattr(lm, "ROUNDS", 1)
    r = random.Random(4)
    texts = [prose(r, r.randint(5, 60), 80) for _ in range(48)]
    lexicon = lexicon_of(texts, 10**9)
    numbers = numbers_of(texts, lexicon)
    packed = [y.astype(lm._width(lexicon)).tobytes() for y in numbers]
    got = lm.learn(spark.createDataFrame(list(enumerate(packed)), "doc_id long, numbers binary").repartition(3), lexicon)
    want, seen = lm.train(lm.start(lexicon.counts), numbers, lexicon.classes)
    assert seen == sum(map(len, numbers))
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-3, atol=1e-4)


def test_copies_are_averaged_by_tokens():
    one, two = ({"a": np.full(2, v, np.float32)} for v in (1, 4))
    batch = pa.RecordBatch.from_arrays([pa.array([lm._pack(one), lm._pack(two)], pa.binary()), pa.array([20, 10])], names=["weights", "seen"])
    (out,) = lm._summed(iter([batch.slice(0, 1), batch.slice(1)]))
    assert list(lm._unpack(out.column(0)[0].as_py())["a"]) == [2, 2] and out.column(1).to_pylist() == [30] and not list(lm._summed(iter([])))


def test_few_lanes_train_like_many(monkeypatch):
    """Every token is seen once, whatever the lanes."""
    r = random.Random(5)
    texts = [prose(r, r.randint(0, 90), 60) for _ in range(30)]
    lexicon = lexicon_of(texts)
    for lanes in (1, 4, 100):
        monkeypatch.setattr(lm, "LANES", lanes)
        p, seen = lm.train(lm.start(lexicon.counts), iter(numbers_of(texts, lexicon)), lexicon.classes)
        assert seen == sum(len(words(t)) + 1 for t in texts) and all(np.isfinite(v).all() for v in p.values())


def test_training_beats_the_unigram_it_starts_from(monkeypatch):
    monkeypatch.setattr(lm, "LANES", 16)
    r = random.Random(6)
    texts = []
    for _ in range(1200):
        w = [r.randrange(30)]
        for _ in range(r.randint(20, 60)):
            w.append((w[-1] * 7 + r.choice([1, 2])) % 30)
        texts.append(" ".join(f"t{k}" for k in w))
    lexicon = lexicon_of(texts)
    numbers = numbers_of(texts, lexicon)
    held, first = np.concatenate(numbers[1000:]), np.concatenate([[0], np.cumsum([len(y) for y in numbers[1000:]])])
    before = lm.score_texts(lm.start(lexicon.counts), held, first, lexicon.classes).sum() / len(held)
    after = lm.score_texts(lm.train(lm.start(lexicon.counts), numbers[:1000], lexicon.classes)[0], held, first, lexicon.classes).sum() / len(held)
    c = Counter(held.tolist())
    assert before == pytest.approx(sum(n * math.log(lexicon.counts[y] / lexicon.total) for y, n in c.items()) / len(held), abs=0.05) and after > before + 1


@pytest.mark.parametrize("width", [None, 8])
def test_long_documents_at_the_end_do_not_spoil_the_rest(monkeypatch, width):
    """Few windows of all documents, then hundreds of one that is unlike them; all of it is learned from, and held-out documents gain."""
    monkeypatch.setattr(lm, "LANES", 64)
    r = random.Random(8)
    step = lambda w, a: (w * a + r.choice([1, 2])) % 30

    def text(n, a):
        w = [r.randrange(30)]
        for _ in range(n):
            w.append(step(w[-1], a))
        return " ".join(f"t{k}" for k in w)

    texts = [text(r.randint(20, 60), 7) for _ in range(700)] + [text(6000, 11)]
    held = [text(r.randint(20, 60), 7) for _ in range(100)]
    lexicon = lexicon_of(texts)
    numbers, flat = numbers_of([texts[-1], *texts[:-1]], lexicon), numbers_of(held, lexicon)
    y, first = np.concatenate(flat), np.concatenate([[0], np.cumsum([len(x) for x in flat])])
    p, seen = lm.train(lm.start(lexicon.counts), numbers, lexicon.classes, width)
    before, after = (lm.score_texts(q, y, first, lexicon.classes).sum() / len(y) for q in (lm.start(lexicon.counts), p))
    assert seen == sum(map(len, numbers)) and after > before + 0.1


def test_gathered_windows_are_one_step(monkeypatch):
    """Gradients of windows that are gathered are those of the windows together."""
    r = np.random.default_rng(3)
    parts = []
    for rows in ([1, 4], [2, 4, 5], [0]):
        parts.append(({"a": r.normal(size=3), "x": r.normal(size=(len(rows), lm.HIDDEN))}, np.array(rows), len(rows) * 10))
    held = None
    for g, rows, n in parts:
        held = lm._gathered(held, {k: v.copy() for k, v in g.items()}, rows, n, 7)
    dense = np.zeros((7, lm.HIDDEN))
    for g, rows, _ in parts:
        dense[rows] += g["x"]
    assert held[1].tolist() == [0, 1, 2, 4, 5] and held[2] == 60
    np.testing.assert_allclose(held[0]["x"], dense[held[1]])
    np.testing.assert_allclose(held[0]["a"], sum(g["a"] for g, _, _ in parts))


def test_lm_reads_no_other_columns(spark, docs):
    clash = docs.select(F.col("doc_id").cast("int").alias("doc_id"), "text", F.lit(1).alias("numbers"), F.lit(2).alias("row"), F.lit(3).alias("score"), F.lit(4).alias("tail"))
    want = lm.score(docs)
    got = lm.score(clash)
    assert got.columns == want.columns
    for a, b in zip(sorted(got.collect(), key=str), sorted(want.collect(), key=str), strict=True):
        assert a[:5] == b[:5] and a["score"] == pytest.approx(b["score"])


def test_gradients_and_state(monkeypatch):
    monkeypatch.setattr(lm, "WITHIN", 4)
    monkeypatch.setattr(lm, "HIDDEN", 5)
    classes, r = 4, np.random.default_rng(0)
    p = {k: v.astype(np.float64) + r.standard_normal(v.shape) * 0.1 for k, v in lm.start(np.arange(1.0, 14.0), 2).items()}
    xs, ys = r.integers(0, 12, (6, 3)), r.integers(0, 13, (6, 3))
    live, s0 = np.ones((6, 3)), r.standard_normal((3, 5)) * 0.1
    live[4:, 1] = 0

    def loss(q):
        s, total = s0, 0.0
        for t in range(6):
            s, *_ = lm._step(q, q["x"][xs[t]] @ q["i"] + q["b"], s)
            total -= (lm.log_probabilities(q, s, ys[t], classes) * live[t]).sum()
        return total

    g, rows, last, n = lm._window(p, xs, ys, live, s0, classes)
    whole = np.zeros_like(p["x"])
    whole[rows] = g["x"]
    g["x"] = whole
    assert n == 16 and set(g) == set(p) and last.shape == s0.shape
    for k in p:
        for at in list(np.ndindex(p[k].shape))[:: max(1, p[k].size // 7)]:
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += 1e-5
            up = loss(q)
            q[k][at] -= 2e-5
            assert g[k][at] == pytest.approx((up - loss(q)) / 2e-5, rel=1e-3, abs=1e-5), (k, at)
    texts = [r.integers(0, 13, 9), r.integers(0, 13, 4)]
    got = lm.score_texts({k: v.astype(np.float32) for k, v in p.items()}, np.concatenate(texts), np.array([0, 9, 13]), classes, lanes=1)
    for t, v in zip(texts, got, strict=True):
        s, x, total = np.zeros((1, 5)), np.array([(classes - 1) * 4 + 1]), 0.0
        for y in t:
            s, *_ = lm._step(p, p["x"][x] @ p["i"] + p["b"], s)
            total += lm.log_probabilities(p, s, np.array([y]), classes)[0]
            x = np.array([y])
        assert v == pytest.approx(total, rel=1e-4)
    every = sum(np.exp(lm.log_probabilities(p, s, np.array([y]), classes)[0]) for y in range(13))
    assert every == pytest.approx(1)


# ---- 5 near duplicates ---------------------------------------------------------------------------------


def brute(rows, size, num, den):
    sets = {}
    for d, t in rows:
        w = words(t)
        sets[d] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, none, size, num):
    r = random.Random(size)
    base = prose(r, 150, 3000).split()
    rows = [(k, t) for k, (_, t, *_) in enumerate(corpus(r, 30))]
    for k in range(40):
        w = base[:]
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"edit{r.randrange(50)}"
        rows.append((100 + k, " ".join(w)))
    chain = prose(r, 120, 3000).split()
    for k in range(6):
        chain = chain[3:] + [f"link{k}{j}" for j in range(3)]
        rows.append((200 + k, " ".join(chain)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").repartition(3), size, num, 100).collect()}
    assert got == brute(rows, size, num, 100)
    assert minhash.near_duplicates(none, size, num, 100).count() == 0


@pytest.mark.parametrize("block", [2, 1000])
def test_near_duplicates_that_no_centre_joins(spark, monkeypatch, block):
    """Two texts that share a template only, in buckets whose centres, the template with parts cut out, are just under the threshold; one centre a bucket."""
    monkeypatch.setattr(minhash, "MORE_CENTRES", 0)
    monkeypatch.setattr(minhash, "BLOCK", block, raising=False)
    template = [f"w2_{k}" for k in range(1200)]
    texts = [template + [f"{own}{k}" for k in range(103)] for own in "xy"] + [template[: 96 * k] + template[96 * k + 96 :] for k in range(12)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    want = brute(rows, 3, 85, 100)
    assert want[1][1] == 0 and len({root for _, root in want.values()}) == 13
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85, 100).collect()}
    assert got == want


def test_repeated_ids_with_different_texts(spark):
    r = random.Random(2)
    a, b, c = (prose(r, 60, 3000) for _ in range(3))
    low, high = sorted([a, b])
    df = spark.createDataFrame([(1, high, 0), (1, low, 1), (2, low, 2), (3, high, 3), (4, c, 4), (4, c, 5), (None, c, 6)], "doc_id int, text string, __dropped int").repartition(3)
    got = {x["doc_id"]: (x["component_id"], x["kept"]) for x in minhash.near_duplicates(df, 3, 85, 100).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True)}
    assert sorted(x["__dropped"] for x in minhash.deduplicate(df, 3, 85, 100).collect()) == [0, 1, 3, 4, 5, 6]


def template_corpus(n, words_=2000):
    """Pairs of documents that are linked (0.8655) and, across pairs, just under the threshold."""
    template, rows, r = [f"t{k}" for k in range(words_)], [], random.Random(23)
    for pair in range(n // 2):
        places = r.sample(range(8, words_ - 8, 8), 60)
        for one in range(2):
            w = template[:]
            for j, at in enumerate(places[:12]):
                w[at] = f"p{pair}x{j}"
            for j, at in enumerate(places[12 + 24 * one : 36 + 24 * one]):
                w[at] = f"d{pair}y{one}z{j}"
            rows.append((2 * pair + one, " ".join(w)))
    return rows


def test_linked_pairs_of_one_template_are_found(spark):
    rows = template_corpus(80)
    want = brute(rows, 3, 85, 100)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85, 100).collect()}
    assert len({root for _, root in want.values()}) == 40 and got == want


def test_deduplicate_keeps_columns(spark, docs):
    out = minhash.deduplicate(docs, 3, 85, 100)
    kept = {r["doc_id"] for r in out.collect()}
    assert out.columns == docs.columns and 66 not in kept and 68 not in kept and 3 in kept and {60, 61, 62} <= kept


# ---- 6 line dedup ----------------------------------------------------------------------------------------


def test_line_dedup(spark, none):
    rows = [(k, f"own {k}\n  footer \n\nnews {k % 7}", "en", "a" if k < 20 else None, 0, 0) for k in range(40)] + [(90, None, "en", "a", 0, 0), (91, "footer", "en", "b", 0, 0), (91, "footer", "en", "b", 0, 0), (92, "", "en", "a", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = lines.clean_documents(df, 0.5, 5)
    got = sorted(map(tuple, out.select("doc_id", "text", "n_chars").collect()), key=str)
    want = sorted(((d, t.replace("  footer \n", "") if t and d < 40 else t, len((t.replace("  footer \n", "") if d < 40 else t) or "") if t else 0) for d, t, *_ in rows), key=str)
    assert got == want and out.columns == df.columns and lines.clean_documents(none).count() == 0
    clash = df.withColumns({c: F.lit(7) for c in ("site", "banned", "__site", "__left", "__banned", "line", "n")})
    assert lines.clean_documents(clash, 0.5, 5).columns == clash.columns
    assert sorted(map(tuple, lines.clean_documents(clash, 0.5, 5).select("doc_id", "text", "n_chars").collect()), key=str) == want


def test_a_host_of_two_pages(spark):
    """The plain share: a menu on both pages of a host goes, a line of one page stays."""
    pages = [(1, "a", "menu\nhome\none"), (2, "a", "menu\nhome\ntwo"), (3, "b", "menu\nonly"), *((10 + k, "c", f"menu\nown {k}\n" + ("pair" if k < 2 else "")) for k in range(30))]
    df = spark.createDataFrame(pages, "page_id long, host string, text string")
    got = {r["page_id"]: (r["text"], r["n"], r["gone"]) for r in lines.drop_boilerplate(df, "host", counts=("n", "gone")).collect()}
    assert got[1] == ("one", 3, 2) and got[2] == ("two", 3, 2) and got[3] == ("menu\nonly", 2, 0)
    # Two of thirty pages are less than a tenth.
    assert got[10] == ("own 0\npair", 3, 1) and got[15] == ("own 5\n", 2, 1)
    kept = {r["page_id"]: r["text"] for r in lines.drop_boilerplate(df, "host", prior=20).collect()}
    assert kept[1] == "menu\nhome\none" and kept[15] == "own 5\n"


def test_page_lines(spark):
    html = "<html><head><title>T &amp; x</title><style>p{}</style></head><body><nav><a href='x'>home</a></nav><!-- c --><p>One <b>two</b></p><script>var t='</p>';</script><p>  </p></body></html>"
    pages = spark.createDataFrame([(k, f"https://u@A.example.com:80/p/{k}", html) for k in range(6)] + [(9, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in lines.line_dedup_pages(pages, 0.5, 7).collect()}
    assert got[0]["host"] == "a.example.com" and got[0]["text"] == "T & x\nhome\nOne two" and got[0]["n_lines"] == 3 and got[9]["text"] is None and got[9]["host"] == ""
    assert {r["text"] for r in lines.line_dedup_pages(pages.where("page_id < 9"), 0.5, 5).collect()} == {""}


# ---- 7 and 9 classifiers ----------------------------------------------------------------------------------


def labelled(spark):
    r = random.Random(2)
    rows, marks = [], []
    for k in range(700):
        bad, junk = k % 5 == 0, k % 4 == 0
        w = prose(r, r.randint(30, 90)).split()
        for _ in range(3 if bad else 0):
            w.insert(r.randrange(len(w)), r.choice([f"insult{j}" for j in range(8)]))
        if junk:
            w = [x + "###" for x in w]
        rows.append((k, " ".join(w), "en", "s", 0, k))
        marks.append((k, 0 if junk else 1, int(bad)))
    rows += [(800, None, None, None, 0, 0), (801, "", None, None, 0, 0), (802, "y" * 40_000, None, None, 0, 0), (0, rows[0][1], "en", "s", 0, 0)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*marks, (801, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), marks


@pytest.mark.parametrize("which", ["toxic", "quality"])
def test_classifiers(spark, none, which):
    docs, labels, marks = labelled(spark)
    run = toxicity.toxicity if which == "toxic" else quality_model.quality
    got = run(docs, labels).collect()
    assert len(got) == 704 and all(0 <= r["score"] <= 1 for r in got)
    truth = {d: (t if which == "toxic" else q) for d, q, t in marks}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in got if r["held_out"]} == {d for d in {r["doc_id"] for r in got} if zlib.crc32(str(d).encode()) % 3 == 1}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert run(none, labels).count() == 0 and {r["score"] for r in run(docs, labels.limit(0)).collect()} == {0.5}
    moved = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    assert sorted(map(tuple, run(moved, labels).collect())) == sorted(map(tuple, got))


def test_ftrl_against_one_weight_at_a_time():
    r = random.Random(8)
    rows = [(" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 6))), r.randint(0, 1)) for _ in range(120)]

    def own(text):
        w = text.split()
        return {("w", x) for x in w} | {(g, *p) for g in (1, 2) for p in zip(w, w[g:], strict=False)}

    count = Counter(f for t, _ in rows for f in own(t))
    z, n, proximal = defaultdict(float), defaultdict(float), lambda z, n, l1: 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2 * bool(l1))
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(3):
        for k in order.permutation(len(rows)):
            x = [None, *(f for f in own(rows[k][0]) if count[f] >= toxicity.LEAST_ROWS)]
            w = {f: proximal(z[f], n[f], toxicity.L1 if f else 0.0) for f in x}
            g = 1 / (1 + math.exp(-sum(w.values()))) - rows[k][1]
            for f in x:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    want = sorted(proximal(z[f], n[f], toxicity.L1) for f in z if f and proximal(z[f], n[f], toxicity.L1))
    bias, names, weights = toxicity.fit(rows, 3)
    assert want and sorted(weights) == pytest.approx(want) and bias == pytest.approx(proximal(z[None], n[None], 0.0)) and len(names) == len(want)


def test_rare_insults_of_a_language_are_learned(spark):
    """Each insult stands in few rows: two hundredths of the toxic ones."""
    r = random.Random(5)
    rows = [(k, (prose(r, 40) + (f" stem{r.randrange(40)} stem{r.randrange(40)}" if k % 8 == 0 else "")), k % 8 == 0) for k in range(4000)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id int, text string").withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows], "doc_id int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    truth = {k: y for k, _, y in rows}
    held = [x for x in got if x["held_out"]]
    assert sum(x["predicted"] for x in held if truth[x["doc_id"]]) >= 0.95 * sum(truth[x["doc_id"]] for x in held) and not any(x["predicted"] for x in held if not truth[x["doc_id"]])


def test_insults_in_quotes_and_without_blanks(spark):
    r = random.Random(41)
    rows, labels = [], []
    for k in range(600):
        bad = k % 3 == 0
        insult = r.choice(["“schuft”", "ÄRGERLING!", "你是笨蛋吧", "»Lump«"]) if bad else r.choice(["“freund”", "ÄRZTE!", "你是朋友吧", "»Haus«"])
        rows.append((k, f"{prose(r, 12)} {insult} {prose(r, 12)}"))
        labels.append((k, int(bad)))
    rows += [(1000, f"{prose(r, 9)} schuft"), (1001, "ärgerling"), (1002, "他说笨蛋"), (1003, "lump, " + prose(r, 5)), (1004, prose(r, 20)), (1005, "freund haus ärzte 朋友")]
    got = {x["doc_id"]: x["predicted"] for x in toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[k] for k in range(1000, 1006)] == [1, 1, 1, 1, 0, 0]
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k] == int(k % 3 == 0) for k in held)


def test_rules_compile_to_what_they_mean(spark):
    r = np.random.default_rng(1)
    x = r.random((300, len(quality_model.STATISTICS)))
    bias, rules = quality_model.fit(x, (x[:, 0] > 0.5) & (x[:, 3] < 0.6))
    assert rules
    df = spark.createDataFrame([tuple(map(float, v)) for v in x[:50]], quality_model.STATISTICS)
    got = [v[0] for v in df.select(quality_model.compiled(bias, rules)).collect()]
    want = [1 / (1 + math.exp(-(bias + sum(w for rule, w in rules if quality_model.holds(rule, x[k : k + 1])[0])))) for k in range(50)]
    assert got == pytest.approx(want)


# ---- 8 quality rules ----------------------------------------------------------------------------------


def test_quality_measures(spark, rows, none):
    r = random.Random(6)
    extra = [(800 + k, "\n".join(r.choice(["a b c d e f", "x | y", "", "  ", "q w e r t y u"]) for _ in range(r.randint(1, 9))), "en", "s", 0, 0) for k in range(60)]
    df = spark.createDataFrame([*rows, *extra], SCHEMA)
    got = {x["doc_id"]: x for x in quality_rules.judge(df).collect()}
    for d, t, *_ in [*rows, *extra]:
        w = (t or "").encode().split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        c = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if c[g] > 1 for j in range(5)}
        solid = [x for x in (t or "").split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum((t or "").count(s) for s in "#*$%&|<>"), len(solid) - len(set(solid)), len(covered))
        x = got[d]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want, d
        assert x["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (x["base_failed"] and x["kept"])
    assert quality_rules.judge(none).count() == 0


def test_em_against_numpy(spark):
    r = random.Random(11)
    names = ["a", "b", "c"]
    table = Counter()
    for _ in range(500):
        good = r.random() < 0.8
        table[tuple((r.choice([0, 0, 0, 1]) if good else r.choice([-1, -1, 0])) for _ in names)] += 1
    df = spark.createDataFrame([(*k, n) for k, n in table.items()], "a int, b int, c int, n long")
    share, got = quality_rules.estimate(df, names, 6)
    p = {k: 0.95 if k.count(-1) == 0 else 0.3 if k.count(-1) == 1 else 0.05 for k in table}
    for _ in range(6):
        good, total = sum(n * p[k] for k, n in table.items()), sum(table.values())
        s = (good + 1) / (total + 2)
        t = {(j, v): ((sum(n * p[k] for k, n in table.items() if k[j] == v) + 1) / (good + 3), (sum(n * (1 - p[k]) for k, n in table.items() if k[j] == v) + 1) / (total - good + 3)) for j in range(3) for v in (-1, 0, 1)}
        p = {k: 1 / (1 + (1 - s) / s * math.prod(t[j, v][1] / t[j, v][0] for j, v in enumerate(k))) for k in table}
    assert share == pytest.approx(s) and got["b"][-1] == pytest.approx(t[1, -1])


# ---- 10 language identification ---------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"\xd0", b"\xb6", "жж".encode()]
    prob = np.random.default_rng(3).random((len(pieces), 2)) * 0.3

    def total(word, k):
        """Logarithm of the sum over all segmentations."""
        sums = [0.0]
        for end in range(1, len(word) + 1):
            paths = [sums[end - len(p)] + math.log(prob[i, k]) for i, p in enumerate(pieces) if word[:end].endswith(p)]
            top = max(paths)
            sums.append(top + math.log(sum(math.exp(x - top) for x in paths)))
        return sums[-1]

    def naive(word, k):
        return 1.0 if not word else sum(prob[i, k] * naive(word[len(p) :], k) for i, p in enumerate(pieces) if word.startswith(p))

    texts = [b"abab", b"ba", b"aab", "жжж".encode(), b"ab" * 100, b"aba" * 700 + b"b", b"b"]
    assert all(total(t, 0) == pytest.approx(math.log(naive(t, 0))) for t in texts[:4])
    data, off = textkernel.buffers(pa.array([t.decode() for t in texts]))
    starts, ends, _ = textkernel.spans(data, off)
    got = langid.word_scores(data, starts, ends, langid.Vocabulary(pieces), prob)
    np.testing.assert_allclose(got, [[total(t, k) for k in range(2)] for t in texts], rtol=1e-9)


def test_fit_is_expectation_maximisation():
    pieces, rows = [b"a", b"b", b"ab", b"ba"], [("x", "abab ba ab"), ("x", "aab ab"), ("y", "bbb")]
    langs, got = langid.fit(rows, pieces, 3)

    def paths(word):
        return [[]] if not word else [[i, *rest] for i, p in enumerate(pieces) if word.startswith(p.decode()) for rest in paths(word[len(p) :])]

    for k, lang in enumerate(langs):
        p = [0.3 ** len(x) for x in pieces]
        p = [x / sum(p) for x in p]
        for _ in range(3):
            seen = [0.0] * 4
            for own, text in rows:
                for word in text.split() if own == lang else []:
                    ways = [(path, math.prod(p[i] for i in path)) for path in paths(word)]
                    for path, q in ways:
                        for i in path:
                            seen[i] += q / sum(w for _, w in ways)
            p = [(x + 0.05) / (sum(seen) + 0.2) for x in seen]
        assert list(got[:, k]) == pytest.approx(p)


def test_slices_change_nothing(monkeypatch):
    texts = ["ab c\nd", "", "é" * 40 + " x", "one two three four five six", "z" * 100, " lead", "a b"]
    buffers = textkernel.buffers(pa.array(texts))
    want = [textkernel.words(*buffers), textkernel.words(*buffers, textkernel.NON_WORD)]
    pieces = [bytes([b]) for b in range(256)] + [b"on", b"one"]
    prob = np.random.default_rng(1).random((len(pieces), 2))
    scores = langid.Scorer(langid.Vocabulary(pieces), prob).texts(*buffers)
    monkeypatch.setattr(textkernel, "SLICE_BYTES", 7)
    monkeypatch.setattr(langid, "CACHE", 3)
    for got, (h, first) in zip([textkernel.words(*buffers), textkernel.words(*buffers, textkernel.NON_WORD)], want, strict=True):
        assert (got[0] == h).all() and (got[1] == first).all()
    small = langid.Scorer(langid.Vocabulary(pieces), prob)
    for _ in range(2):
        got = small.texts(*buffers)
        np.testing.assert_allclose(got[0], scores[0])
        assert (got[1] == scores[1]).all()


def test_language_id(spark, none):
    r = random.Random(12)
    en, de = ["the", "thing", "and", "with", "that", "when"], ["der", "und", "schön", "ich", "nicht", "ungen"]
    rows = [(k, " ".join(r.choice(en if k % 2 else de) for _ in range(20)), "en" if k % 2 else "de", "s", 0, 0) for k in range(120)]
    rows += [(200, None, None, None, 0, 0), (201, "12 ... !!", "en", "s", 0, 0), (202, "", "de", "s", 0, 0), (203, "t" * 20_000, None, "s", 0, 0), (1, rows[1][1], "en", "s", 0, 0)]
    rows += [(204, "— … “”", None, "s", 0, 0), (205, "€ 5 •", "en", "s", 0, 0), (206, "\u0301 \u0301\u0301", None, "s", 0, 0), (207, "Ж", None, "s", 0, 0), (7, "der und ich", "en", "s", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = langid.identify(df).collect()
    by = {x["doc_id"]: x for x in got}
    assert len(got) == len(rows) and all(by[k]["lang_pred"] == ("en" if k % 2 else "de") for k in range(120) if k != 7)
    assert [by[k]["lang_pred"] for k in (200, 201, 202, 204, 205, 206)] == ["und"] * 6 and all(0 <= x["score"] <= 1 for x in got)
    assert {x["doc_id"] for x in got if x["held_out"]} == {d for d in by if zlib.crc32(str(d).encode()) % 5 == 0}
    out = langid.known_language(df)
    assert out.columns == df.columns and {x["doc_id"] for x in out.collect()} == set(by) - {200, 201, 202, 204, 205, 206}
    clash = df.select(F.col("doc_id").cast("int").alias("doc_id"), "text", "lang", F.lit(1).alias("words"), F.lit(2).alias("score"), F.lit(3).alias("lang_pred"), F.lit(4).alias("key"))
    assert sorted(map(tuple, langid.identify(clash).collect())) == sorted(map(tuple, got)) and langid.known_language(clash).columns == clash.columns
    assert langid.identify(none).count() == 0 and langid.known_language(none).count() == 0


# ---- all operators ------------------------------------------------------------------------------------


CLASH = ("host", "site", "band", "bands", "root", "rank", "row", "token", "c", "u", "v", "id", "key", "words", "mark", "position", "epoch", "lines", "label", "p_good", "skey", "bucket", "__id", "__lower", "__banned", "__dropped", "__site")


@pytest.mark.parametrize("name", ["mix", "digest", "contamination", "near_duplicates", "toxicity", "judge", "quality", "identify"])
def test_other_columns_and_narrow_ids_change_nothing(spark, docs, none, name):
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(40)], "doc_id int, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    bench = docs.select(F.col("doc_id").alias("item_id"), "text").where("doc_id < 5")
    run = {
        "mix": mixing.mix, "digest": pii.digest, "contamination": lambda d: decontam.contamination(d, bench), "near_duplicates": minhash.near_duplicates, "toxicity": lambda d: toxicity.toxicity(d, labels),
        "judge": quality_rules.judge, "quality": lambda d: quality_model.quality(d, labels), "identify": langid.identify,
    }[name]
    plain = docs.select("doc_id", "text", "lang", "source")
    clash = plain.withColumn("doc_id", F.col("doc_id").cast("int")).withColumns({k: F.lit(7) for k in CLASH})
    show = lambda df: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())
    assert show(run(clash)) == show(run(plain))
    assert run(none).count() == 0


def test_stages_keep_other_columns(spark, docs):
    clash = docs.withColumns({k: F.lit(7) for k in CLASH})
    bench = docs.select(F.col("doc_id").alias("item_id"), "text").where("doc_id < 5")
    assert minhash.deduplicate(clash).columns == langid.known_language(clash).columns == lines.clean_documents(clash).columns == decontam.decontaminate(clash, bench, block_words=50).columns == clash.columns
    assert minhash.deduplicate(clash).count() > 0 and mixing.mixed_documents(clash).columns == [c for c in clash.columns if c not in ("epoch", "taken", "position")] + ["epoch", "taken", "position"]


def test_a_text_of_megabytes(spark):
    r = random.Random(1)
    long = " ".join(prose(r, 20_000, 3000) for _ in range(18))
    assert len(long) > 1_500_000
    df = spark.createDataFrame([(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, "a b c", "de", "a"), (4, "z" * 1_200_000, "en", "b")], "doc_id long, text string, lang string, source string")
    got = {x["doc_id"]: x for x in minhash.near_duplicates(df).collect()}
    assert got[2]["component_id"] == 1 and got[4]["n_shingles"] == 1
    items = spark.createDataFrame([(9, long[700_000:700_200].split(" ", 1)[1].rsplit(" ", 1)[0])], "item_id long, text string")
    assert {x["doc_id"] for x in decontam.contamination(df, items).collect()} == {1, 2}
    assert {x["doc_id"]: x["n_tokens"] for x in lm.score(df).collect()}[1] == len(long.split()) + 1
