"""Quality rules as weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the table of vote patterns
estimates the share of good documents and, for either class, how often each rule casts each vote; the posterior probability of the
good class replaces the demand that a document pass every rule. The pattern table has at most 3 ** len(RULES) rows at any corpus size.

Defined cases: a null text has no words, fails the base rules and is not kept. Windows are compared by 64-bit hashes of
their words. Rows that repeat a doc_id are judged each for itself. An empty table gives an empty result. Extra columns, whatever
their names, are not read. A posterior of exactly the limit keeps the document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, settle, text_of

WINDOW = 5
ROUNDS = 12
#: A document is kept if its posterior is this or more.
KEEP = 0.5
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that rules and base columns use. All work stays inside a row; nothing is shuffled."""
    text = F.col("text")
    a = docs.select("doc_id", text_of().alias("text"))
    a = a.select(
        "doc_id",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"),
        (F.length(text) - _without(text, SPACES)).cast("long").alias("word_chars"),
        _without(text, SYMBOLS).cast("long").alias("n_symbols"),
        _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        _without(text, "!").cast("long").alias("n_bang"),
        _without(text, "|").cast("long").alias("n_bars"),
    )
    numbers = ["word_chars", "n_symbols", "n_upper", "n_bang", "n_bars"]
    n = F.size("words")

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])

    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(F.array().cast("array<bigint>"))
    b = a.select(
        "doc_id", *numbers, n.cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"),
    )
    numbers += ["n_words", "n_lines", "n_dup_lines"]
    placed = F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    c = b.select("doc_id", *numbers, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).alias("placed"))
    m = F.size("placed")
    twins = F.zip_with(
        F.slice("placed", F.lit(1), m - 1), F.slice("placed", F.lit(2), m - 1), lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>"))
    )
    d = c.select("doc_id", *numbers, F.when(F.col("placed").isNotNull(), F.sort_array(F.array_distinct(F.flatten(twins)))).alias("twice"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).cast("int").alias("last"))
    covered = F.aggregate(
        "twice", start, lambda s, p: F.struct((s["sum"] + F.least(F.lit(WINDOW), p - s["last"])).cast("long").alias("sum"), p.alias("last")), lambda s: s["sum"]
    )
    return d.select("doc_id", *numbers, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def _bad(when: Column) -> Column:
    return F.when(when, -1).otherwise(0)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the columns of :func:`measures`. Most rules know one kind of junk and abstain on the rest.

    ``symbols``, ``symbol_share``, ``fused_symbols`` and ``bars`` look at the same signs from four sides, so they are not independent as EM takes them to be:
    a text full of signs is held against more strongly than one rule would.
    """
    upper, bang, symbols, bars = _share("n_upper", "word_chars"), _share("n_bang", "n_words"), _share("n_symbols", "n_words"), _share("n_bars", "n_words")
    length, repeats, copies = _share("word_chars", "n_words"), _share("n_repeat_words", "n_words"), _share("n_dup_lines", "n_lines")
    return {
        "length": _vote(F.col("n_words") < 10, F.col("n_words") >= 40),
        "word_length": _vote((length < 2.5) | (length > 12), (length > 3.5) & (length < 8)),
        "symbols": _bad(symbols > 0.2),
        "symbol_share": _bad(_share("n_symbols", "word_chars") > 0.04),
        "fused_symbols": _bad(symbols - bars > 0.3),
        "bars": _bad(bars > 0.15),
        "upper": _bad(upper > 0.4),
        "bang": _bad(bang > 0.3),
        "repeats": _bad(repeats > 0.2),
        "copies": _bad(copies > 0.3),
    }


def _posterior(votes: dict[str, Column], share: float, table: dict[str, dict[int, tuple[float, float]]]) -> Column:
    """Probability of the good class, given for each rule and vote its probability in (good, bad) documents."""
    total = F.lit(math.log(share / (1 - share)))
    for name, vote in votes.items():
        weight = {v: math.log(g / b) for v, (g, b) in table[name].items()}
        total = total + F.when(vote == 1, F.lit(weight[1])).when(vote == -1, F.lit(weight[-1])).otherwise(F.lit(weight[0]))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def estimate(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, dict]:
    """EM over vote patterns (one column of votes for each rule, ``n`` documents).

    It starts from a guess: no bad vote 0.95, one 0.3, more 0.05. Counts are smoothed by one vote of each kind.
    """
    votes = {x: F.col(x) for x in names}
    bad = sum((F.when(v == -1, 1).otherwise(0) for v in votes.values()), F.lit(0))
    p = F.when(bad == 0, 0.95).when(bad == 1, 0.3).otherwise(0.05)
    share, table = 0.9, {x: {v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for x in names}
    cast = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), v.cast("int").alias("vote")) for x, v in votes.items()]))
    for _ in range(rounds):
        sums = patterns.select("n", p.alias("p"), cast.alias("c")).groupBy("c.rule", "c.vote").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum("n").alias("all"))
        got = {(r["rule"], r["vote"]): (float(r["good"]), float(r["all"])) for r in sums.collect()}
        if not got:
            break
        good, total = (sum(x[k] for (rule, _), x in got.items() if rule == names[0]) for k in (0, 1))
        share = (good + 1) / (total + 2)
        for x in names:
            for v in (-1, 0, 1):
                g, n = got.get((x, v), (0.0, 0.0))
                table[x][v] = ((g + 1) / (good + 3), (n - g + 1) / (total - good + 3))
        p = _posterior(votes, share, table)
    return share, table


def judge(docs: DataFrame) -> DataFrame:
    """Base columns, ``base_failed``, ``kept`` and ``p_good``, the posterior, of every document."""
    seen = settle(measures(docs), "measures")
    votes = rules()
    patterns = settle(seen.groupBy(*[v.alias(x) for x, v in votes.items()]).agg(F.count(F.lit(1)).alias("n")), "patterns")
    share, table = estimate(patterns, list(votes))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    quality = _posterior(votes, share, table)
    return seen.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (quality >= KEEP)).alias("kept"), quality.alias("p_good"),
    )
