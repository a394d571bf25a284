"""Audits of whole runs: saved values against their recomputation, part by part.

Frames of two sides are compared by hash blocks: rows fall into blocks by their
key, and one pass over both sides sums the hashes of each (part, block), one side
up and the other down, in any order. Blocks that come to nothing are equal and stay
closed; only the rows of the others are compared value by value. What a record says
of itself (its times, its answer, its events) is checked within the record.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.operators import metrics, paired, records
from pairlens.operators.records import Members, below, channel_error, event_channels, given, kind, known_signature, member, read, text

#: Parts of a whole audit.
PARTS = ("evaluations", "timings", "reconstruction", "channels", "metrics", "paired")
VIOLATION = "part string, key string, column string, saved string, recomputed string"
#: Saved names of the nine times, and the columns that recompute them.
NINE = {
    "ttfo_ms": "ttfo_ms", "ttfa_ms": "ttfa_ms", "pre_answer_reasoning_tokens": "pre_answer_reasoning_tokens", "reasoning_emitted_before_answer": "reasoning_emitted", "e2e_latency_ms": "e2e_ms",
    "first_answer_token_ms": "ttfa_ms", "last_answer_token_ms": "last_ms", "visible_answer_token_count": "answer_tokens", "output_tokens_per_second": "speed",
}


@dataclass
class Audit:
    """Violations, and the parts that were looked at: a part that was not is not proved."""

    violations: DataFrame
    parts: frozenset[str]


def _side(part: str, frame: DataFrame, keys: list[str], columns: list[str], sign: int, blocks: int) -> DataFrame:
    """(part, block, key, sign, cells): a row of one side, its values as strings."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    cells = F.array(*[F.to_json(F.struct(F.col(c).alias("v"))) if dict(frame.dtypes)[c].startswith(("array", "map", "struct")) else F.col(c).cast("string") for c in columns])
    return frame.select(F.lit(part).alias("part"), key.alias("key"), F.lit(sign).alias("sign"), cells.alias("cells")).withColumn("block", F.pmod(F.xxhash64("part", "key"), F.lit(blocks)))


def unequal_blocks(rows: DataFrame) -> DataFrame:
    """(part, block) of rows (part, block, key, sign, cells) whose two sides differ, by counts and sums of two 64-bit hashes in halves."""
    nulls = F.array_join(F.transform("cells", lambda c: F.when(c.isNull(), "1").otherwise("0")), "")
    hashes = [F.xxhash64(F.lit(seed), "key", "cells", nulls) for seed in (1, 2)]
    halves = [h for x in hashes for h in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]
    sums = rows.select("part", "block", "sign", *[(F.col("sign") * h).alias(f"h{i}") for i, h in enumerate(halves)])
    each = sums.groupBy("part", "block").agg(F.sum("sign").alias("n"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)])
    return each.where("n <> 0 OR h0 <> 0 OR h1 <> 0 OR h2 <> 0 OR h3 <> 0").select("part", "block")


def block_audit(spark: SparkSession, pairs: list[tuple[str, DataFrame, DataFrame, list[str], list[str]]], blocks: int = 4096) -> DataFrame:
    """VIOLATION rows of (part, saved, recomputed, keys, columns): every value that differs, nulls included.

    A key that does not stand once on each side has the column ``copies`` with its
    numbers of rows. Hashes of both sides are compared when this is called; at most
    ``blocks`` names of unequal blocks a part come to the driver, and without any
    no row is read again.
    """
    sides = [(part, frame, keys, columns, sign) for part, saved, now, keys, columns in pairs for frame, sign in ((saved, 1), (now, -1))]
    rows = [_side(*s[:4], s[4], blocks) for s in sides]
    whole = rows[0]
    for r in rows[1:]:
        whole = whole.unionByName(r)
    bad = [tuple(r) for r in unequal_blocks(whole).collect()]
    if not bad:
        return spark.createDataFrame([], VIOLATION)
    opened = F.broadcast(spark.createDataFrame(bad, "part string, block long"))
    out = None
    for part in dict.fromkeys(p for p, _ in bad):
        for mine in (i for i in range(0, len(sides), 2) if sides[i][0] == part):
            both = rows[mine].unionByName(rows[mine + 1]).join(opened, ["part", "block"], "left_semi")
            held = lambda s: F.max(F.when(F.col("sign") == s, F.struct(F.lit(1), "cells")))["cells"]  # noqa: E731,B023
            each = both.groupBy("part", "key").agg(F.count_if(F.col("sign") == 1).alias("a"), F.count_if(F.col("sign") == -1).alias("b"), held(1).alias("x"), held(-1).alias("y"))
            once = (F.col("a") == 1) & (F.col("b") == 1)
            cell = [F.struct(F.lit(c).alias("column"), F.get("x", F.lit(i)).alias("saved"), F.get("y", F.lit(i)).alias("recomputed")) for i, c in enumerate(sides[mine][3])]
            copies = F.array(F.struct(F.lit("copies").alias("column"), F.col("a").cast("string").alias("saved"), F.col("b").cast("string").alias("recomputed")))
            found = each.select("part", "key", F.inline(F.when(once, F.filter(F.array(*cell), lambda x: ~x["saved"].eqNullSafe(x["recomputed"]))).otherwise(copies)))
            out = found if out is None else out.unionByName(found)
    return out


def _unlike(saved: Column, now: Column, boolean: bool) -> Column:
    """Whether a saved VARIANT is not the recomputed value; a JSON null is none."""
    value = F.try_variant_get(saved, "$", "boolean" if boolean else "double")
    number = (kind(saved) == "BIGINT") | (kind(saved) == "DOUBLE") | kind(saved).startswith("DECIMAL")
    right = F.when(given(saved).isNull(), now.isNull()).otherwise(((kind(saved) == "BOOLEAN") if boolean else number) & value.eqNullSafe(now if boolean else now.cast("double")))
    return ~F.coalesce(right, F.lit(False))


def record_violations(rows: DataFrame, durable: DataFrame | None = None) -> DataFrame:
    """VIOLATION rows of the parts timings, reconstruction and channels, and of evaluations where nothing could be recomputed.

    ``rows`` are lenient record_facts (with problem and record). ``durable`` has a
    row (request_id, durability) for each event that was saved on arrival; records
    need as many as they hold, all marked arrival_atomic. Records are not shuffled:
    what joins those counts is their violations.
    """
    rows, doc = read(rows), Members(F.col("_m"))
    seen = lambda n: F.coalesce(member(below(doc, "timings"), n), member(doc, n))
    said = lambda part, column, saved, now: F.struct(F.lit(part).alias("part"), F.col("request_id").alias("key"), F.lit(column).alias("column"), saved.cast("string").alias("saved"), now.cast("string").alias("recomputed"))
    none, failed = F.lit(None).cast("string"), F.col("problem")
    events = F.col("_m.stream_events")
    n = F.coalesce(F.size(events), F.lit(0))
    checks = [F.when(failed.isNotNull(), said(part, "recomputation", none, failed)) for part in ("evaluations", "timings", "reconstruction")]
    checks.append(F.when((text(member(doc, "terminal_outcome")) == "completed") & (n == 0), said("reconstruction", "stream_events", none, none)))
    for name, column in (("reconstructed_answer", "answer"), ("reconstructed_reasoning", "reasoning")):
        held = F.coalesce(text(member(doc, name)), F.lit(""))
        checks.append(F.when(failed.isNull() & (held != F.col(column)), said("reconstruction", name, held, F.col(column))))
    for name, column in NINE.items():
        checks.append(F.when(failed.isNull() & _unlike(seen(name), F.col(column), column == "reasoning_emitted"), said("timings", name, F.to_json(seen(name)), F.col(column))))
    judged = F.transform(F.transform(events, lambda e: event_channels(Members(e))), lambda e, i: F.struct(i.alias("i"), channel_error(e).alias("why")))
    bad = F.filter(judged, lambda x: x["why"].isNotNull())
    channels = F.transform(F.coalesce(bad, F.array().cast("array<struct<i:int,why:string>>")), lambda x: F.struct(F.lit("channels").alias("part"), F.concat_ws("|", "request_id", x["i"].cast("string")).alias("key"), F.lit("channel").alias("column"), x["why"].alias("saved"), none.alias("recomputed")))
    found = F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), channels)
    base = rows.select("request_id", n.alias("n"), known_signature(doc).alias("known"), found.alias("found"))
    if durable is not None:
        held = durable.groupBy("request_id").agg(F.count(F.lit(1)).alias("kept"), F.count_if(~F.col("durability").eqNullSafe(F.lit("arrival_atomic"))).alias("late"))
        base = base.join(held, "request_id", "left").fillna(0, ["kept", "late"])
        more = [F.when((F.col("kept") != F.col("n")) & ~F.col("known"), said("reconstruction", "durable_events", F.col("kept"), F.col("n"))), F.when(F.col("late") > 0, said("reconstruction", "durability", F.col("late"), F.lit(0)))]
        base = base.withColumn("found", F.concat("found", F.filter(F.array(*more), lambda x: x.isNotNull())))
    return base.select(F.inline("found"))


def audit_run(saved: DataFrame, items: DataFrame, prices: DataFrame, families: tuple[str, str, str], count_tokens: Callable[[Column], Column], evaluations: DataFrame, family_metrics: DataFrame, wins: dict[str, DataFrame], differences: dict[str, DataFrame], durable: DataFrame | None = None, eligible: DataFrame | None = None, blocks: int = 4096) -> Audit:
    """Audit of a run from its saved records (request_id, record) in all PARTS.

    ``evaluations`` has request_id and the columns of a judgement, ``family_metrics``
    is a saved metrics.family_metrics with order_free costs, ``wins`` and ``differences`` have a saved
    paired.fastest_wins and paired.pairwise by measure. Records are read and folded
    once; their facts are kept on the executors' disks while the parts are compared.
    """
    spark = saved.sparkSession
    facts = records.record_facts(saved, items, prices, families, count_tokens, strict=False).persist(StorageLevel.DISK_ONLY)
    now = metrics.family_metrics(facts, order_free=True)
    pairs = [("evaluations", evaluations, facts.where("problem IS NULL"), ["request_id"], list(records.JUDGEMENT)), ("metrics", family_metrics, now, ["provider", "family"], [c for c in now.columns if c not in ("provider", "family")])]
    for measure, frame in wins.items():
        again = paired.fastest_wins(facts, measure, eligible)
        pairs.append(("paired", frame.withColumn("measure", F.lit(measure)), again.withColumn("measure", F.lit(measure)), ["measure", "provider"], [c for c in again.columns if c != "provider"]))
    for measure, frame in differences.items():
        again = paired.pairwise(facts, measure, eligible)
        pairs.append(("paired", frame.withColumn("measure", F.lit(measure)), again.withColumn("measure", F.lit(measure)), ["measure", "provider_a", "provider_b"], [c for c in again.columns if c not in ("provider_a", "provider_b")]))
    pairs[0] = ("evaluations", evaluations.join(facts.where("problem IS NOT NULL").select("request_id"), "request_id", "left_anti"), *pairs[0][2:])
    found = block_audit(spark, pairs, blocks).unionByName(record_violations(facts, durable))
    return Audit(found, frozenset(PARTS))
