"""Texts of megabytes through the operators that test_operators.py does not send them through, and the lasso of the quality model at its optimum."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.llm import langid, lines, mixing, pii, quality_model, quality_rules, toxicity


@pytest.fixture(scope="module")
def long(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    text = " ".join(r.choice(words) for _ in range(300_000))
    rows = [(k, " ".join(r.choice(words) for _ in range(40)), "en" if k % 2 else "de", f"s{k % 2}") for k in range(60)]
    rows += [(100, text + " mail me@site.org\n" + text, "en", "s0"), (101, "z" * 2_000_000, "de", "s1"), (102, "one two\n" * 200_000, "en", "s0")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), {r[0]: r[1] for r in rows}


def test_sizes_and_findings_are_those_of_the_whole_text(long):
    df, texts = long
    got = {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()}
    assert got == {k: len(t.split()) for k, t in texts.items()}
    found = {r["doc_id"]: r for r in pii.digest(df).collect()}
    at = texts[100].index("me@site.org")
    assert found[100]["n_email"] == 1 and found[100]["spans"] == f"email:{at}:{at + 11}" and found[101]["spans"] == ""


def test_lines_of_a_long_text(spark, long):
    _, texts = long
    body = texts[100].replace(" ", "\n", 50_000)
    pages = spark.createDataFrame([(1, "h", body + "\nmenu"), (2, "h", "menu\nx"), *((k, "h", f"p{k}") for k in range(3, 15))], "page_id long, host string, text string")
    got = {r["page_id"]: r["text"] for r in lines.drop_boilerplate(pages, "host").collect()}
    assert got[1] == body and got[2] == "x"


def test_measures_of_long_texts(long):
    df, texts = long
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert got[100]["n_words"] == len(texts[100].split()) and got[101]["word_chars"] == 2_000_000 and got[102]["n_dup_lines"] == 199_999 and got[102]["n_repeat_words"] == 400_000


def test_classifiers_score_long_texts(long):
    df, _ = long
    labels = df.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 3 > 0).cast("int").alias("quality"))
    for scored in (toxicity.toxicity(df, labels), quality_model.quality(df, labels)):
        assert {r["doc_id"] for r in scored.where("score between 0 and 1").collect()} >= {100, 101, 102}


def test_a_long_word_does_not_widen_the_others_tables(spark, long):
    """One word of a hundred thousand letters among thousands, in learning and in scoring: tables of all words at its length would take gigabytes."""
    import resource

    _, texts = long
    words = sorted({w for w in texts[100].split() if w.isalpha()})
    rows = [(k, " ".join(words[k % 5 :: 5]) + f" {'qwertz' * 16_000 if k == 3 else ''}", "en" if k % 2 else "de") for k in range(40)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == 40 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000


def test_the_lasso_is_at_its_optimum():
    """At the minimum the gradient along every rule that is kept is the penalty, against the weight's sign, and along the intercept nothing."""
    r = np.random.default_rng(4)
    x = r.normal(size=(600, len(quality_model.STATISTICS)))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (r.random(600) < 0.1)).astype(int)
    bias, rules = quality_model.fit(x, y)
    assert rules
    on = np.stack([np.all([x[:, j] <= cut if low else x[:, j] > cut for j, low, cut in rule], axis=0) for rule, _ in rules], axis=1).astype(float)
    p = 1 / (1 + np.exp(-(bias + on @ np.array([w for _, w in rules]))))
    mean = on.mean(axis=0)
    z = (on - mean) / np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    slope = z.T @ (p - y) / len(y)
    np.testing.assert_allclose(slope, [-np.sign(w) * quality_model.PENALTY for _, w in rules], atol=2e-3)
    assert abs((p - y).mean()) < 1e-3 and re.match("[a-z]", quality_model.STATISTICS[0])
