"""Joins by time: what was in force at a moment, how many were under way, and which intervals overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlens.operators.scans import BLOCKS, running


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], tie: str, left_tie: str, blocks: int = BLOCKS) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` of the same group that is not later; NULL where there is none.

    Both sides have the ``by`` columns and the time ``at`` of one type. Of rows of
    ``right`` at one time the highest ``tie`` counts; ``left_tie`` tells rows of
    ``left`` apart, which only helps to spread them. Null times of ``right`` are
    never in force and null times of ``left`` find nothing; null groups meet. Both
    sides pass as one frame in order, so no key is joined and a group may be of any
    size.
    """
    keep = [c for c in left.columns if c not in by and c != at]
    kind = left.schema[left_tie].dataType.simpleString()
    other = right.schema[tie].dataType.simpleString()
    both = left.select(*by, at, F.lit(1).alias("_side"), F.lit(None).cast(other).alias("_rt"), F.col(left_tie).alias("_lt"), F.struct(*keep).alias("_mine")).unionByName(
        right.where(F.col(at).isNotNull()).select(*by, at, F.lit(0).alias("_side"), F.col(tie).alias("_rt"), F.lit(None).cast(kind).alias("_lt"), F.struct(*values).alias("_theirs")), allowMissingColumns=True
    )
    found = running(both, by, [at, "_side", "_rt", "_lt"], {"_latest": ("last", F.col("_theirs"))}, blocks)
    return found.where("_side = 1").select(*by, at, *[F.col(f"_mine.`{c}`").alias(c) for c in keep], *[F.col(f"_latest.`{v}`").alias(v) for v in values])


def in_flight(intervals: DataFrame, by: Sequence[str], start: str, end: str, blocks: int = BLOCKS) -> DataFrame:
    """(by, at, launched, in_flight) of every time at which something starts: how many start then, and how many are open then, these included.

    An interval holds its start and not its end; one that ends at or before its
    start is open at no time, a null end never ends, a null start is left out.
    """
    known = intervals.where(F.col(start).isNotNull())
    step = lambda at, up, down: F.struct(at.alias("at"), F.lit(up).cast("long").alias("up"), F.lit(down).cast("long").alias("down"))
    steps = F.array(step(F.col(start), 1, 0), step(F.greatest(start, end), 0, 1))
    ends = F.when(F.col(end).isNull(), F.slice(steps, 1, 1)).otherwise(steps)
    times = known.select(*by, F.inline(ends)).groupBy(*by, "at").agg(F.sum("up").alias("launched"), (F.sum("up") - F.sum("down")).alias("net"))
    return running(times, by, ["at"], {"in_flight": ("sum", F.col("net"))}, blocks).where("launched > 0").select(*by, "at", "launched", "in_flight")


def points_within(points: DataFrame, intervals: DataFrame, by: Sequence[str], point: str, start: str, end: str) -> DataFrame:
    """Every pair of a point and an interval of the same group that holds it (start <= point < end), with the columns of both.

    Times are whole numbers. An interval goes to the level whose buckets are at
    least as long as itself, where it lies in one or two; a point looks into one
    bucket of each level in use (at most 63, which are asked for when this is
    called). An interval fills at least a quarter of its buckets, so a bucket's
    pairs are in proportion to those returned if points are spread over it. Column
    names other than ``by`` must differ. Null groups and times match nothing.
    """
    length = f"(`{end}` - `{start}`)"
    levelled = intervals.where(F.col(end) > F.col(start)).withColumn("_level", F.expr(f"if({length} = 1, 0, length(bin({length} - 1)))"))
    levels = sorted(r[0] for r in levelled.select("_level").distinct().collect())
    first, last = F.expr(f"shiftright(`{start}`, _level)"), F.expr(f"shiftright(`{end}` - 1, _level)")
    filed = levelled.withColumn("_bucket", F.explode(F.array_distinct(F.array(first, last))))
    asked = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("_bucket", F.expr(f"shiftright(`{point}`, _level)"))
    return asked.join(filed, [*by, "_level", "_bucket"]).where(F.col(point).between(F.col(start), F.col(end) - 1)).drop("_level", "_bucket")


def overlaps(a: DataFrame, b: DataFrame, by: Sequence[str], a_id: str, b_id: str, start: str, end: str, empty: bool = False) -> DataFrame:
    """(by, a_id, b_id) of every pair of intervals [start, end) of one group that share a moment, once; empty intervals share none.

    Two intervals overlap if one holds the other's start. ``a`` and ``b`` may be one
    frame. With ``empty``, pairs are those whose starts both come before the other's
    end: an interval that ends at or before its start pairs with those that begin
    before its end and end after its start.
    """
    real = F.lit(True) if empty else F.col(end) > F.col(start)
    mine = a.where(real).select(*by, F.col(a_id).alias("_a"), F.col(start).alias("_as"), F.col(end).alias("_ae"))
    theirs = b.where(real).select(*by, F.col(b_id).alias("_b"), F.col(start).alias("_bs"), F.col(end).alias("_be"))
    out = [*by, F.col("_a").alias("a_id"), F.col("_b").alias("b_id")]
    # a point's own end only matters where it lies at or before its start
    later = points_within(mine, theirs, by, "_as", "_bs", "_be").where("_bs < _ae").select(*out)
    sooner = points_within(theirs, mine, by, "_bs", "_as", "_ae").where("_bs > _as AND _as < _be").select(*out)
    return later.union(sooner)
