"""Per-request reduction of stream events to answers, first-output times and usage.

Events have request_id, event_index, offset_ms, answer, reasoning, and may have
usage columns. One grouped pass makes all measures of a request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.stats import output_speed


def _joined(text: str) -> Column:
    items = F.array_sort(F.collect_list(F.struct("offset_ms", "event_index", F.coalesce(text, F.lit("")).alias("t"))))
    return F.array_join(F.transform(items, lambda e: e["t"]), "")


def request_timing(events: DataFrame, count_tokens) -> DataFrame:
    """answer, reasoning, ttfo_ms, ttfa_ms, last_ms, pre_answer_reasoning, reasoning_emitted, answer_tokens by request.

    First output counts only once an answer exists; without one all times are
    null. Reasoning up to and including the first answer event is pre-answer.
    """
    says, thinks = F.coalesce("answer", F.lit("")) != "", F.coalesce("reasoning", F.lit("")) != ""
    first = F.min(F.when(says, F.struct("offset_ms", "event_index")))
    parts = F.array_sort(F.collect_list(F.when(thinks, F.struct("offset_ms", "event_index", F.col("reasoning").alias("t")))))
    grouped = events.groupBy("request_id").agg(
        _joined("answer").alias("answer"), _joined("reasoning").alias("reasoning"), F.min(F.when(says | thinks, F.col("offset_ms"))).alias("any_ms"), F.min(F.when(says, F.col("offset_ms"))).alias("ttfa_ms"),
        F.max(F.when(says, F.col("offset_ms"))).alias("last_ms"), first.alias("first"), parts.alias("parts"), F.count(F.lit(1)).alias("n_events"),
    )
    before = F.array_join(F.transform(F.filter("parts", lambda e: F.struct(e["offset_ms"], e["event_index"]) <= F.struct(F.col("first.offset_ms"), F.col("first.event_index"))), lambda e: e["t"]), "")
    out = grouped.withColumn("pre_answer_reasoning", F.when(F.col("ttfa_ms").isNotNull(), before))
    return out.select("request_id", "answer", "reasoning", F.when(F.col("ttfa_ms").isNotNull(), F.col("any_ms")).alias("ttfo_ms"), "ttfa_ms", "last_ms", "pre_answer_reasoning", (F.col("pre_answer_reasoning") != "").alias("reasoning_emitted"), count_tokens(F.col("answer")).cast("long").alias("answer_tokens"), "n_events")


def completed_timing(timing: DataFrame, complete: Column) -> DataFrame:
    """Adds e2e_ms and speed, which only complete answers have."""
    done = complete & (F.col("answer") != "")
    return timing.withColumn("e2e_ms", F.when(done, F.col("last_ms"))).withColumn("speed", output_speed(F.col("answer_tokens"), F.col("ttfa_ms"), F.col("last_ms"), done))


def last_known(events: DataFrame, columns: list[str], order: str = "event_index") -> DataFrame:
    """The last non-null value of each column by request."""
    return events.groupBy("request_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def first_known(events: DataFrame, columns: list[str], order: str = "event_index") -> DataFrame:
    return events.groupBy("request_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def mismatches(timing: DataFrame, saved: DataFrame) -> DataFrame:
    """Requests whose saved answer or reasoning is not what the events give."""
    joined = timing.alias("t").join(saved.alias("s"), "request_id")
    return joined.where(~F.col("t.answer").eqNullSafe(F.col("s.answer")) | ~F.col("t.reasoning").eqNullSafe(F.col("s.reasoning"))).select("request_id")
