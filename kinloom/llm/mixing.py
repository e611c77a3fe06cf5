"""Mixing sources to target weights with a time-varying curriculum.

Every source gets a target in words: its share of the mix by weight, at most ``cap`` times what it has,
and what a full source leaves over goes to the others by weight. Inside a source, documents
stand in a fixed order (that of the MD5 of the id). A source's weight schedule says how its demand is spread
over training: the schedule is integrated, and the cumulative demand is inverted at each document's offset in
its source's stream, which gives the document's training position. Documents are range-sorted by position.

Offsets are prefix sums in two levels: inside hash buckets of a source, and over a source's 4096 bucket
totals. So a source with any share of all rows is spread over thousands of groups. Only ids and
sizes are shuffled until the final sort. All arithmetic on words is exact in integers; a run has the same result every time.

Defined cases: a null text has size 0; a document without words is never taken. A null source is a
source of its own, the last. Rows that repeat a doc_id are ordered by size and are otherwise documents of their own. The last pass
over a source ends inside one document, of which a part counts as taken. An empty table gives an empty result. Documents of equal MD5 key stand by id, then by size.
Extra columns, whatever their names, are not read by :func:`mix` and returned by :func:`mixed_documents`. In the final sort, rows of one position
are dealt by id too; only rows that repeat both go to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, settle, text_of

WEIGHTS = (5, 2, 1)
#: For each weight of the cycle, points (training progress, relative weight) joined by straight lines.
SCHEDULES = (((0.0, 1.25), (1.0, 0.75)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def _source(c: str = "source") -> Column:
    """A key that sorts by code point with null last."""
    return F.concat(F.when(F.col(c).isNull(), "1").otherwise("0"), F.coalesce(F.col(c).cast("string"), F.lit("")))


def _pick(values: Sequence, at: Column) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), at.cast("int"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3) -> DataFrame:
    """``skey``, ``source_size``, ``target`` (double), ``goal`` (whole words), ``kind`` (place in the cycle, from 1) for each source.

    Sources fill up in the order of cap * size / weight. The level that the sources not full share
    is the first that leaves the next source below its cap.
    """
    total = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = total.withColumn("kind", (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1)
    ranked = ranked.withColumn("w", _pick(weights, F.col("kind")).cast("long")).withColumn("room", cap * F.col("source_size"))
    order = Window.orderBy(F.col("room") / F.col("w"), "skey")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stepped = ranked.withColumns(
        {"left": F.sum("source_size").over(whole) - F.coalesce(F.sum("room").over(before), F.lit(0)), "share": F.sum("w").over(after)}
    ).withColumn("fits", F.col("left") * F.col("w") <= F.col("room") * F.col("share"))
    level = F.min_by(F.struct("left", "share"), F.when(F.col("fits"), F.struct(F.col("room") / F.col("w"), F.col("skey")))).over(whole)
    out = stepped.withColumn("level", level)
    full = F.col("level.left") * F.col("w") > F.col("room") * F.col("level.share")
    target = F.when(full, F.col("room").cast("double")).otherwise((F.col("level.left") * F.col("w")).cast("double") / F.col("level.share"))
    goal = F.when(full, F.col("room")).otherwise(F.expr("(level.left * w) div level.share"))
    return out.select("skey", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"), F.coalesce(goal, F.lit(0)).cast("long").alias("goal"), "kind")


def _inverse(share: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Training progress by which a source has given out ``share`` of its words, for one schedule."""
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(points[:-1], points[1:], strict=True):
        area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
    out = None
    for k in reversed(range(len(points) - 1)):
        (t0, w0), (t1, w1) = points[k], points[k + 1]
        rise, start = (w1 - w0) / (t1 - t0), area[k]
        rest = share * F.lit(area[-1]) - F.lit(start)
        here = F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2.0 * rise) * rest, F.lit(0.0))))
        out = here if out is None else F.when(share * F.lit(area[-1]) < F.lit(area[k + 1]), here).otherwise(out)
    return out


def _plan(docs: DataFrame, weights: Sequence[int], cap: int, once: bool = False) -> DataFrame:
    """One row for each document: id, size, its source's figures and ``before``, the words before it in its source."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sizes = docs.select("doc_id", _source().alias("skey"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    if once:
        sizes = sizes.groupBy("doc_id").agg(F.max(F.struct("size", "skey", "key")).alias("r")).select("doc_id", "r.*")
    sizes = settle(sizes, "sizes")
    goals = settle(targets(sizes, weights, cap), "targets")
    part = sizes.withColumn("bucket", F.substring("key", 1, 3))
    run = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = part.withColumn("inner", F.coalesce(F.sum("size").over(run), F.lit(0)))
    steps = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = part.groupBy("skey", "bucket").agg(F.sum("size").alias("sum")).select("skey", "bucket", F.coalesce(F.sum("sum").over(steps), F.lit(0)).alias("outer"))
    return inside.join(outer, ["skey", "bucket"]).join(goals, "skey").withColumn("before", F.col("inner") + F.col("outer"))


def _taken(epoch: Column) -> Column:
    """Words that pass number ``epoch`` over the source takes of the document."""
    left = F.col("goal") - epoch * F.col("source_size") - F.col("before")
    return F.least(F.greatest(left, F.lit(0)), F.col("size"))


def _position(epoch: Column, schedules: Sequence) -> Column:
    share = F.try_divide((epoch * F.col("source_size") + F.col("before")).cast("double"), F.col("goal").cast("double"))
    return _pick([_inverse(share, s) for s in schedules], F.col("kind"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, schedules: Sequence = SCHEDULES) -> DataFrame:
    """For every document its size, its source's size and target, the words taken and the training position of its first use (null if unused)."""
    plan = _plan(docs, weights, cap)
    taken = sum((_taken(F.lit(e)) for e in range(1, cap)), _taken(F.lit(0)))
    out = plan.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.when(_taken(F.lit(0)) > 0, _position(F.lit(0), schedules)).alias("position")
    )
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, schedules: Sequence = SCHEDULES) -> DataFrame:
    """The training stream: ``docs``'s columns, one row for each pass that uses a document, with ``epoch``, ``taken`` and ``position``, sorted by position.

    Rows that share a doc_id count as one document of the largest of their sizes; each use returns all of them.
    Columns of ``docs`` named like the three new ones give way to them.
    """
    plan, own = _plan(docs, weights, cap, once=True), fresh(docs)
    uses = plan.select(F.col("doc_id").alias(own + "id"), "source_size", "goal", "kind", "before", "size", F.explode(F.array(*[F.lit(e) for e in range(cap)])).alias("epoch"))
    uses = uses.withColumn("taken", _taken(F.col("epoch"))).where("taken > 0").withColumn("position", _position(F.col("epoch"), schedules))
    docs = docs.drop("epoch", "taken", "position")
    out = docs.join(uses.select(own + "id", "epoch", "taken", "position"), docs.doc_id.eqNullSafe(F.col(own + "id"))).drop(own + "id")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def oracle(weights: Sequence[int] = WEIGHTS, cap: int = 3, schedules: Sequence = SCHEDULES) -> str:
    """:func:`mix` over ``documents`` in DuckDB SQL."""

    def inverse(points: Sequence) -> str:
        area = [0.0]
        for (t0, w0), (t1, w1) in zip(points[:-1], points[1:], strict=True):
            area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
        out = ""
        d = lambda x: f"({x!r}::DOUBLE)"
        for k in reversed(range(len(points) - 1)):
            (t0, w0), (t1, w1) = points[k], points[k + 1]
            rise = (w1 - w0) / (t1 - t0)
            rest = f"(share * {d(area[-1])} - {d(area[k])})"
            here = f"({d(t0)} + {d(2.0)} * {rest} / ({d(w0)} + sqrt(greatest({d(w0 * w0)} + {d(2.0 * rise)} * {rest}, 0.0::DOUBLE))))"
            out = here if not out else f"CASE WHEN share * {d(area[-1])} < {d(area[k + 1])} THEN {here} ELSE {out} END"
        return out

    cases = " ".join(f"WHEN {i} THEN {inverse(s)}" for i, s in enumerate(schedules, 1))
    rank = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights, 1))
    clamp = lambda e: f"least(greatest(goal - {e} * source_size - before, 0), size)"
    taken = " + ".join(clamp(e) for e in range(cap))
    return rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS skey,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM d GROUP BY skey),
r AS (SELECT *, (row_number() OVER (ORDER BY skey) - 1) % {len(weights)} + 1 AS kind, {cap} * source_size AS room FROM s),
w AS (SELECT *, CASE kind {rank} END AS w FROM r),
g AS (SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(room) OVER (ORDER BY room::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest,
      (sum(w) OVER (ORDER BY room::DOUBLE / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS share FROM w),
l AS (SELECT rest AS l_rest, share AS l_share FROM g WHERE rest * w <= room * share ORDER BY room::DOUBLE / w, skey LIMIT 1),
t AS (SELECT skey, source_size, kind, CASE WHEN l_rest * w > room * l_share THEN room::DOUBLE ELSE (l_rest * w)::DOUBLE / l_share END AS target,
      CASE WHEN l_rest * w > room * l_share THEN room ELSE (l_rest * w) // l_share END AS goal FROM g, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.goal, t.kind,
      coalesce(sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.skey = t.skey),
q AS (SELECT *, before::DOUBLE / goal AS share FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, ({taken})::BIGINT AS taken,
       CASE WHEN {clamp(0)} > 0 THEN CASE kind {cases} END END AS position FROM q"""
