"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) stay whatever their score; the method adds two kinds, which need a score of ``ACCEPT`` and
overlap neither base spans nor each other:

* ``iban``: two letters, two digits and 11 to 30 letters or digits, valid under mod-97; in groups of four or in one piece it has
  enough by itself, in other groups it needs a bank's word before it;
* ``phone_local``: 7 to 11 digits in groups without a leading plus sign, which needs a word of calling before it.

Words before a span add 0.3 to its score (call, phone, tel ... for phones, account, bank, card ... for ibans and cards) or take 0.3 from it (order, item, version ...).

Every pattern runs in time linear in the text: a run of digits is entered at its start only, quantifiers are
possessive, and the part of an address before the ``@`` is found by walking back from it.

Defined cases: a null text is empty. Offsets are code points, ends exclusive. Kinds sort as in ``KINDS`` at equal starts.
Each row is judged for itself, repeated ids too; a text without finds has counts 0 and the hash of the empty string.
An empty table gives an empty result. Extra columns, whatever their names, are not read. ``doc_id`` may be any integer type.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = ("email", "ip", "card", "phone", "iban", "phone_local")
BASE = KINDS[:4]
ACCEPT = 0.6
#: Characters before a span in which context words count.
CONTEXT = 40

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+().-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){0,2}(?![0-9A-Za-z-])")
_CALL = re.compile(r"(?i)\b(?:call|phone|tel|telephone|mobile|cell|fax|whatsapp|teléfono|téléphone|telefon|rufnummer)\b")
_BANK = re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|card|visa|mastercard|tarjeta|carte|karte)\b")
_OTHER = re.compile(r"(?i)\b(?:order|item|invoice|version|isbn|serial|ticket|model|pedido|commande|bestellung)\b")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if k % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def mod97(code: str) -> bool:
    turned = code[4:] + code[:4]
    rest = 0
    for c in turned:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            yield start, m.end()
            free = m.end()


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _context(text: str, start: int, kind: str) -> float:
    """What the words before a span add to its score, or take from it."""
    before = max(0, start - CONTEXT)
    own = _BANK if kind in ("iban", "card") else _CALL if kind in ("phone", "phone_local") else None
    up = 0.3 if own is not None and own.search(text, before, start) else 0.0
    return up - (0.3 if _OTHER.search(text, before, start) else 0.0)


def find(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all spans, in order."""
    out = [(s, e, "email", 1.0) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((m.start(), m.end(), "ip", 0.9))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card", 0.95))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone", 0.8))
    out = [(s, e, k, round(v + _context(text, s, k), 2)) for s, e, k, v in out]
    # Disjoint taken ranges, in order: what is added must lie between them.
    starts: list[int] = []
    ends: list[int] = []
    for s, e, *_ in sorted(out):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def add(s: int, e: int, kind: str, score: float) -> None:
        at = bisect.bisect_right(starts, s)
        score = round(score + _context(text, s, kind), 2)
        if score >= ACCEPT and not (at and ends[at - 1] > s) and not (at < len(starts) and starts[at] < e):
            out.append((s, e, kind, score))
            starts.insert(at, s)
            ends.insert(at, e)

    for m in _IBAN.finditer(text):
        code = m.group().replace(" ", "")
        if mod97(code):
            groups = m.group().split(" ")
            add(m.start(), m.end(), "iban", 0.7 if len(groups) == 1 or all(len(g) == 4 for g in groups[:-1]) else 0.5)
    for m in _LOCAL_PHONE.finditer(text):
        if 7 <= len(_digits(m.group())) <= 11:
            add(m.start(), m.end(), "phone_local", 0.4)
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(spans: list[tuple[int, int, str, float]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans if k in kinds)


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, an array of (start, end, kind, score), of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            found = [[{"start": s, "end": e, "kind": k, "score": v} for s, e, k, v in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,kind:string,score:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of base kinds, the hash of the base spans, and all spans as text."""
    s = F.col("spans")
    mark = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter(s, lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return spans(docs).select(
        "doc_id", *counts, F.sha2(F.array_join(F.transform(base, mark), ","), 256).alias("base_sha256"), F.array_join(F.transform(s, mark), ",").alias("spans"),
        F.array_join(F.transform(s, lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def sha(text: str) -> str:
    """The base hash of one text, for tests."""
    return hashlib.sha256(joined(find(text), BASE).encode()).hexdigest()
