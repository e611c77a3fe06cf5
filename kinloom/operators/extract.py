"""Text to structured records: entry splitting, field extraction, pluggable entity taggers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import RULE

# Patterns of the grant texts. White space and digits are spelt out as ASCII classes: Java's \s and \d and RE2's, with which the results
# are compared, differ on form feeds, vertical tabs and other digits. Form feed, vertical tab and no-break space therefore do not separate.
NAME_NUMBER = r"Grant Name:[ \t\n\r]*(.*?),[ \t\n\r]*Grant Number:[ \t\n\r]*([0-9]+)"
DESCRIPTION = r"(?s)Description:[ \t\n\r]*(.*)"
COUNTY = r"Description:[ \t\n\r]*(.*?)[ \t\n\r]*(Co\.|County)"
COORDINATES = r"In[ \t\n\r]*T[ \t\n\r]*[0-9-]+[ \t\n\r]*[NS]?[ \t\n\r]*,?[ \t\n\r]*R[ \t\n\r]*[0-9-]+[ \t\n\r]*[EW]?[ \t\n\r]*,?[ \t\n\r]*(SBM|MDM|[A-Za-z0-9_.]*)"
ACRES = r"([0-9]+[.,]?[0-9]*) acres"
LEAGUES = r"([0-9]+[.,]?[0-9]*) sq\. leagues"
GOVERNOR_TITLE = r"Gov\.[ \t\n\r]+[A-Z][a-z]+\b"
CAPS_ENTRY = r"(?m)^[ \t\n\r]*([A-Z][A-Z \t\n\r().,]*)[ \t\n\r]*#([0-9]+),[ \t\n\r]*([^\n]+(?:\n[ \t\n\r]+[^\n]+)*)"
MERIDIAN_END = r"[ \t\n\r]*(MDM\.|SBM\.|MBM\.)$"
SECTION_HEAD = r"(?:^|\n)(?:(?:[XVI]+\.[ \t\n\r]*)|(?:[ \t\n\r]*))?([A-Z][A-Z \t\n\r]+COUNTY)"
ENTRY_HEAD = r"\n([A-Z][A-Z \t\n\r'.()-]+(?:[ \t\n\r]*\([^)]*\))?)(?:,|\.) (#[0-9]+(?:-[A-Z])?)"
ENTRY_COUNTY = r"^,?[ \t\n\r]*([^,.]+?)(?:[ \t\n\r]+Co(?:\.|[ \t\n\r]+)|County)"
GRANT_SIZE = r"Grant of[ \t\n\r]+([0-9 \t\n\r/.-]+(?:[ \t\n\r]*sq\.)?[ \t\n\r]*leagues?)?[ \t\n\r]+made"
GRANT_YEAR = r"made in ([0-9]{4})"
GOVERNOR = r"by Gov\.[ \t\n\r]+([A-Za-z]+)"
PATENT = r"Patent for ([0-9.,]+) acres issued in ([0-9]{4}) to ([^.]+)"
LOCATION = r"In (T [^.]+)"
ALIAS = r"(?i)(?:Also known as|Also called)[ \t\n\r]+([^.]+)"
NEAR = r"(?i)near ([^,.]+?)(?:,|\.|on)"
WATER = r"(?i)(?:on|along) (?:the)?[ \t\n\r]+([A-Z][a-z]+ (?:River|Creek|Lake))"
CORPUS_START = "ALAMEDA COUNTY"
MERIDIANS = ("MDM", "MDM.", "SBM", "SBM.", "SDM", "SDM.", "MDBM", "MDBM.", "SBBM", "SBBM.", "G&SR", "G&SR.", "HBM", "HBM.")
COORDINATE_PARTS = (r"T [0-9]+(?:-[0-9]+)?[NS]", r"R [0-9]+(?:-[0-9]+)?[EW]", "MDM", "SBM", "HBM", "MDBM")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(F.regexp_like(text, F.lit(pattern)), F.regexp_extract(text, pattern, group))


def found_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def clean_grant_name(name: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(name, MERIDIAN_END, ""), ".,", ""))


def without_governors(description: Column) -> Column:
    return F.regexp_replace(description, GOVERNOR_TITLE, "")


def parse_entries(texts: DataFrame, text: str = "text") -> DataFrame:
    """Entries between rules that have a name, number and description on the expected lines, one row each."""
    entry = F.col("entry")
    rows = texts.select(F.posexplode(F.split(F.col(text), RULE)).alias("place", "entry"))
    rows = rows.where(F.regexp_like(entry, F.lit(NAME_NUMBER)) & F.regexp_like(entry, F.lit(DESCRIPTION)))
    return rows.select(
        "place", F.trim(F.regexp_extract(entry, NAME_NUMBER, 1)).alias("name"), F.regexp_extract(entry, NAME_NUMBER, 2).cast("long").alias("number"),
        F.btrim(F.regexp_extract(entry, DESCRIPTION, 1), F.lit(" \t\n\r")).alias("description"), F.trim(found(entry, COUNTY)).alias("county"),
        found(entry, COORDINATES, 0).alias("coordinates"),
    )


def extract_grants(texts: DataFrame, text: str = "text") -> DataFrame:
    """Capitalised entries ``NAME #n, description`` with indented continuation lines."""
    t = F.col(text)
    parts = F.arrays_zip(found_all(t, CAPS_ENTRY, 1).alias("name"), found_all(t, CAPS_ENTRY, 2).alias("number"), found_all(t, CAPS_ENTRY, 3).alias("description"))
    rows = texts.select(F.explode(parts).alias("g")).select("g.*")
    return rows.select(clean_grant_name(F.btrim("name", F.lit(" \t\n\r"))).alias("name"), F.col("number").cast("long").alias("number"), F.trim(F.regexp_replace("description", r"[ \t\n\r]+", " ")).alias("description"))


def split_sections(texts: DataFrame, text: str = "text", start: str = CORPUS_START) -> DataFrame:
    """``county``, ``section``: the text from each county header to the next, from the first occurrence of ``start`` on."""
    t = F.when(F.instr(text, start) > 0, F.substr(F.col(text), F.instr(text, start))).otherwise(F.col(text))
    body = texts.select(t.alias("t"))
    cut = F.regexp_replace("t", SECTION_HEAD, "\x01$1\x02")
    rows = body.select(F.explode(F.filter(F.split(cut, "\x01"), lambda s: F.contains(s, F.lit("\x02")))).alias("s"))
    return rows.select(F.btrim(F.split_part("s", F.lit("\x02"), F.lit(1)), F.lit(" \t\n\r")).alias("county"), F.split_part("s", F.lit("\x02"), F.lit(2)).alias("section"))


def split_entries(sections: DataFrame, section: str = "section") -> DataFrame:
    """``name``, ``number``, ``description``, ``county`` of the entries of a section; headings that are meridian marks only are skipped."""
    others = [c for c in sections.columns if c not in (section, "county")]
    cut = F.regexp_replace(F.concat(F.lit("\n"), F.col(section)), ENTRY_HEAD, "\x01$1\x02$2\x02")
    rows = sections.select(*others, F.explode(F.filter(F.split(cut, "\x01"), lambda s: F.contains(s, F.lit("\x02")))).alias("s"))
    part = lambda k: F.btrim(F.split_part("s", F.lit("\x02"), F.lit(k)), F.lit(" \t\n\r"))
    rows = rows.select(*others, part(1).alias("name"), part(2).alias("number"), part(3).alias("description")).where(~F.col("name").isin(*MERIDIANS))
    return rows.withColumn("county", F.trim(found(F.col("description"), ENTRY_COUNTY)))


def grant_details(df: DataFrame, text: str = "description") -> DataFrame:
    """``df`` with size, years, governors, patent, location, alternative names, places and waters of its text."""
    t = F.col(text)
    return df.withColumns(
        {
            "grant_size": F.nullif(F.regexp_extract(t, GRANT_SIZE, 1), F.lit("")),
            "grant_year": F.array_join(found_all(t, GRANT_YEAR), "; "),
            "governor": F.array_join(F.array_sort(F.array_distinct(found_all(t, GOVERNOR))), "; "),
            "patent_acres": found(t, PATENT, 1),
            "patent_year": found(t, PATENT, 2),
            "patent_recipients": found(t, PATENT, 3),
            "location": found(t, LOCATION),
            "alternative_names": F.trim(found(t, ALIAS)),
            "size_acres": found(t, ACRES),
            "size_leagues": found(t, LEAGUES),
            "near": F.trim(found(t, NEAR)),
            "water": F.array_join(found_all(t, WATER), "; "),
        }
    )


#: A tagger maps texts to lists of (text, label); it is built once in each worker.
Tagger = Callable[[list[str]], list[list[tuple[str, str]]]]

_RULES = (
    ("DATE", re.compile(r"\b1[5-9]\d\d\b")),
    ("ORG", re.compile(r"\b(?:[A-Z][a-z]+ )+(?:Company|Commission|Court|Church)\b")),
    ("LOC", re.compile(r"\b(?:[A-Z][a-z]+ )*(?:[A-Z][a-z]+ (?:River|Creek|Lake|County))\b|\b(?:San|Santa) [A-Z][a-z]+\b")),
    ("PERSON", re.compile(r"\b(?!San\b|Santa\b|The\b|In\b|Grant\b)[A-Z][a-z]+ (?:de (?:la )?)?(?!River\b|Creek\b|Lake\b|County\b|Company\b)[A-Z][a-z]+\b")),
)


def rule_tagger() -> Tagger:
    """Deterministic tagger by patterns; earlier labels take a span before later ones."""
    model = rule_model()
    return lambda texts: [[(t[s:e], label) for s, e, label in spans] for t, spans in zip(texts, model(texts), strict=True)]


ENTITY = "array<struct<text:string,label:string>>"


def tag_entities(df: DataFrame, text: str, make: Callable[[], Tagger] = rule_tagger, out: str = "entities") -> DataFrame:
    """``df`` with the tagger's entities; the tagger is made once for each worker and gets whole Arrow batches."""

    @F.pandas_udf(ENTITY)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = make()
        for b in batches:
            got = tagger([t or "" for t in b])
            yield pd.Series([[{"text": x, "label": y} for x, y in row] for row in got])

    return df.withColumn(out, run(F.col(text)))


SPANS = "array<struct<start:int,end:int,label:string,text:string>>"
#: A model maps texts to lists of (start, end, label).
Model = Callable[[list[str]], list[list[tuple[int, int, str]]]]
_LOADED: dict[str, Model] = {}


def loaded(key: str, make: Callable[[], Model]) -> Model:
    """The model of that key, made once in each worker process and kept for all its tasks."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def windows_of(text: str, window: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last) of the windows over a text: each answers for the spans that start from ``first`` to before ``last``, half an overlap from its ends."""
    out, start, step, half = [], 0, window - overlap, overlap // 2
    while True:
        end = min(len(text), start + window)
        final = end == len(text)
        out.append((start, end, start + half if start else 0, end + 1 if final else start + step + half))
        if final:
            return out
        start += step


def tag_spans(df: DataFrame, text: str, make: Callable[[], Model], key: str, out: str = "spans", window: int = 2000, overlap: int = 200, batch: int = 32, pool: int = 2048) -> DataFrame:
    """``df`` with the spans that a model finds in the whole text.

    The model is loaded once a worker. Long texts go in overlapping windows, and windows of like length go together, ``batch`` at a time out of ``pool``, so that a model which pads loses little. A span
    is taken from the one window that answers for its start, so none comes twice; one of at most half an overlap is never cut, and is found as in one pass if the model looks no farther than that.
    A null text has no span.
    """

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(key, make)
        for texts in batches:
            found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
            waiting: list[tuple[int, int, int, int, str]] = []

            def flush(waiting=waiting, found=found) -> None:
                waiting.sort(key=lambda w: len(w[4]))
                for k in range(0, len(waiting), batch):
                    part = waiting[k : k + batch]
                    for (row, start, first, last, _), spans in zip(part, model([w[4] for w in part]), strict=True):
                        found[row] += [(start + s, start + e, label) for s, e, label in spans if first <= start + s < last]
                waiting.clear()

            for row, t in enumerate(texts):
                for start, end, first, last in windows_of(t or "", window, overlap):
                    waiting.append((row, start, first, last, (t or "")[start:end]))
                    if len(waiting) >= pool:
                        flush()
            flush()
            yield pd.Series([[{"start": s, "end": e, "label": x, "text": t[s:e]} for s, e, x in sorted(spans)] for t, spans in zip(texts, found, strict=True)])

    return df.withColumn(out, run(F.col(text)))


def rule_model() -> Model:
    """:func:`rule_tagger` with places."""

    def tag(texts: list[str]) -> list[list[tuple[int, int, str]]]:
        out = []
        for text in texts:
            spans: list[tuple[int, int, str]] = []
            for label, pattern in _RULES:
                spans += [(m.start(), m.end(), label) for m in pattern.finditer(text) if all(m.end() <= s or e <= m.start() for s, e, _ in spans)]
            out.append(sorted(spans))
        return out

    return tag


def entities_of(spans: Column) -> Column:
    """Spans as the entities that :func:`route_entities` and :func:`entity_roles` take."""
    return F.transform(spans, lambda s: F.struct(s["text"].alias("text"), s["label"].alias("label")))


def of_labels(entities: Column, *labels: str) -> Column:
    return F.transform(F.filter(entities, lambda e: e["label"].isin(*labels)), lambda e: e["text"])


def entity_roles(df: DataFrame, entities: str = "entities") -> DataFrame:
    """First person as grantor, second as grantee, last place as location, last date as year."""
    e = F.col(entities)
    people = of_labels(e, "PERSON", "PER")
    return df.withColumns(
        {"grantor": F.get(people, F.lit(0)), "grantee": F.get(people, F.lit(1)), "place": F.try_element_at(of_labels(e, "GPE", "LOC"), F.lit(-1)), "year": F.try_element_at(of_labels(e, "DATE"), F.lit(-1))}
    )


def route_entities(df: DataFrame, text: str, entities: str = "entities") -> DataFrame:
    """Persons without governors, patent holders among them, places and dates that are no coordinates, organisations without meridian marks; distinct, sorted, joined by ``; ``."""
    e, t = F.col(entities), F.col(text)
    governors = found_all(t, "(?i)" + GOVERNOR)
    governs = lambda p: F.exists(governors, lambda g: F.contains(F.lower(p), F.lower(g)) | F.contains(F.lower(g), F.lower(p)))
    persons = F.filter(of_labels(e, "PERSON", "PER"), lambda p: ~governs(p))
    recipients = F.coalesce(F.regexp_extract(t, PATENT, 3), F.lit(""))
    holders = F.filter(persons, lambda p: F.contains(recipients, p))
    anywhere, at_start = "|".join(COORDINATE_PARTS), "^(?:" + "|".join(COORDINATE_PARTS) + ")"
    places = F.filter(of_labels(e, "GPE", "LOC"), lambda p: ~p.rlike(anywhere) & (F.length(p) > 1))
    dates = F.filter(of_labels(e, "DATE"), lambda p: ~p.rlike(at_start))

    def marked(p: Column) -> Column:
        out = F.lit(False)
        for m in COORDINATE_PARTS:
            out = out | F.contains(p, F.lit(m))
        return out

    orgs = F.filter(of_labels(e, "ORG"), lambda p: ~marked(p))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), "; ")
    return df.withColumns({"persons": join(persons), "patent_holders": join(holders), "locations": join(places), "dates": join(dates), "organizations": join(orgs), "grantors": join(governors)})
