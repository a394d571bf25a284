"""Queries over token streams: reconstruction, times, usage, framing, streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairlens.functions.jsonstrict import token_count
from pairlens.functions.stats import ratio
from pairlens.operators import timing
from pairlens.sources.tables import attempts, stream_events, table
from pairlens.streaming import operators as st

from .metrics_queries import FACT
from .registry import query

EVENTS = "WITH ev AS (SELECT conv_id AS request_id, turn AS event_index, CAST(turn AS DOUBLE) AS offset_ms, CASE WHEN role = 'assistant' THEN text END AS answer, CASE WHEN role = 'user' THEN text END AS reasoning, role FROM conversations)"
TIMED = EVENTS + """, t AS (SELECT request_id, coalesce(string_agg(answer, '' ORDER BY offset_ms, event_index), '') AS answer, coalesce(string_agg(reasoning, '' ORDER BY offset_ms, event_index), '') AS reasoning,
 min(offset_ms) FILTER (WHERE answer <> '' OR reasoning <> '') AS any_ms, min(offset_ms) FILTER (WHERE answer <> '') AS ttfa_ms, max(offset_ms) FILTER (WHERE answer <> '') AS last_ms, count(*) AS n_events FROM ev GROUP BY 1),
pre AS (SELECT ev.request_id, coalesce(string_agg(ev.reasoning, '' ORDER BY ev.offset_ms, ev.event_index), '') AS pre FROM ev JOIN t USING (request_id) WHERE ev.offset_ms <= t.ttfa_ms GROUP BY 1),
timing AS (SELECT t.*, CASE WHEN ttfa_ms IS NOT NULL THEN any_ms END AS ttfo_ms, CASE WHEN ttfa_ms IS NOT NULL THEN pre END AS pre, CASE WHEN ttfa_ms IS NOT NULL THEN pre <> '' END AS emitted, len(regexp_extract_all(t.answer, '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]')) AS ascii_tokens FROM t LEFT JOIN pre USING (request_id))
"""


def _timing(spark, sf_dir):
    return timing.request_timing(stream_events(spark, sf_dir), token_count())


@query("stream_reconstruct", f"{TIMED} SELECT request_id, md5(answer) AS answer_md5, md5(reasoning) AS reasoning_md5, n_events FROM timing")
def stream_reconstruct(spark, sf_dir):
    return _timing(spark, sf_dir).select("request_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"), F.md5(F.col("reasoning").cast("binary")).alias("reasoning_md5"), "n_events")


@query("ttfo_ttfa_e2e", f"{TIMED} SELECT request_id, ttfo_ms, ttfa_ms, last_ms, CASE WHEN answer <> '' THEN last_ms END AS e2e_ms FROM timing")
def ttfo_ttfa_e2e(spark, sf_dir):
    return timing.completed_timing(_timing(spark, sf_dir), F.lit(True)).select("request_id", "ttfo_ms", "ttfa_ms", "last_ms", "e2e_ms")


@query("pre_answer_reasoning", f"{TIMED} SELECT request_id, md5(pre) AS pre_md5, emitted AS reasoning_emitted FROM timing")
def pre_answer(spark, sf_dir):
    return _timing(spark, sf_dir).select("request_id", F.md5(F.col("pre_answer_reasoning").cast("binary")).alias("pre_md5"), "reasoning_emitted")


@query("reasoning_emission_rate", f"{TIMED} SELECT count_if(emitted) AS emitted, count(ttfa_ms) AS answered, count_if(emitted) / count(ttfa_ms) AS rate FROM timing")
def reasoning_rate(spark, sf_dir):
    t = _timing(spark, sf_dir)
    return t.agg(F.count_if("reasoning_emitted").alias("emitted"), F.count("ttfa_ms").alias("answered"), ratio(F.count_if("reasoning_emitted"), F.count("ttfa_ms")).alias("rate"))


@query("output_speed", f"{TIMED} SELECT request_id, CASE WHEN length(answer) >= 2 AND last_ms > ttfa_ms THEN (length(answer) - 1) / ((last_ms - ttfa_ms) / 1000) END AS speed FROM timing")
def output_speed(spark, sf_dir):
    return timing.completed_timing(timing.request_timing(stream_events(spark, sf_dir), F.length), F.lit(True)).select("request_id", "speed")


@query("usage_last_non_null", f"{EVENTS} SELECT request_id, max_by(length(answer), event_index) FILTER (WHERE answer IS NOT NULL) AS last_answer, min_by(length(reasoning), event_index) FILTER (WHERE reasoning IS NOT NULL) AS first_reasoning FROM ev GROUP BY 1")
def usage_last(spark, sf_dir):
    e = stream_events(spark, sf_dir).withColumn("last_answer", F.length("answer").cast("long")).withColumn("first_reasoning", F.length("reasoning").cast("long"))
    return timing.last_known(e, ["last_answer"]).join(timing.first_known(e, ["first_reasoning"]), "request_id")


@query("event_index_positions", "SELECT conv_id AS request_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS event_index FROM conversations")
def event_index(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("request_id"), "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("event_index"))


@query("reconstruction_mismatches", f"{TIMED} SELECT request_id FROM timing WHERE request_id % 7 = 3 AND answer <> ''")
def reconstruction_mismatches(spark, sf_dir):
    t = _timing(spark, sf_dir)
    saved = t.select("request_id", F.when((F.col("request_id") % 7 == 3) & (F.col("answer") != ""), F.lit("")).otherwise(F.col("answer")).alias("answer"), "reasoning")
    return timing.mismatches(t, saved)


@query("deadline_filter", "SELECT conv_id AS request_id, turn AS event_index FROM conversations WHERE turn < 3")
def deadline(spark, sf_dir):
    return st.within_deadline(stream_events(spark, sf_dir), limit=3.0).select("request_id", "event_index")


@query("sse_framing", "SELECT conv_id AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame, md5(text) AS data_md5, 1 AS comments FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)")
def sse_framing(spark, sf_dir):
    said = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("data: "), x))
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), "turn", F.posexplode(F.concat(F.array(F.lit(": ping")), said, F.array(F.lit("")))).alias("pos", "line"))
    lines = c.select("request_id", F.struct("turn", "pos").alias("line_no"), "line")
    return st.frames(lines).select("request_id", F.col("frame").cast("long").alias("frame"), F.md5(F.col("data").cast("binary")).alias("data_md5"), F.col("comments").cast("int").alias("comments"))


def stream(spark, sf_dir, name):
    df = table(spark, sf_dir, name)
    return spark.readStream.schema(df.schema).option("pathGlobFilter", f"{name}*" if not df.inputFiles()[0].rsplit("/", 1)[1].startswith("part") else "*.parquet").parquet(sf_dir if not df.inputFiles()[0].rsplit("/", 1)[1].startswith("part") else f"{sf_dir}/{name}.parquet")


@query("stream_windowed_rates", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_windowed(spark, sf_dir):
    """Tumbling windows of a stream, as complete results."""
    out = st.windowed_rates(stream(spark, sf_dir, "events"), F.col("ts").cast("timestamp"), "1 hour", "1 day")
    got = st.run_to_files(out, f"w{uuid.uuid4().hex}", "complete")
    return got.select(F.unix_timestamp("window.start").alias("start_s"), "event_type", "n", "total")


@query("round_barrier_stream", "SELECT event_id // 10 AS round_id, 10 AS arms FROM events GROUP BY 1 HAVING count(*) = 10")
def round_barrier(spark, sf_dir):
    events = stream(spark, sf_dir, "events")
    records = events.select(((F.col("event_id") - F.col("event_id") % 10) / 10).cast("long").alias("round_id"), (F.col("event_id") % 10).cast("string").alias("provider"))
    return st.run_to_files(st.barrier(records, 10), f"b{uuid.uuid4().hex}")


@query("event_dedup_stream", "SELECT DISTINCT conv_id AS request_id, turn AS event_index FROM conversations")
def event_dedup(spark, sf_dir):
    c = stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("event_index"))
    return st.run_to_files(c.union(c).dropDuplicates(["request_id", "event_index"]), f"d{uuid.uuid4().hex}")


@query("incremental_timing_stream", f"{TIMED} SELECT request_id, ttfo_ms, ttfa_ms, last_ms, n_events FROM timing")
def incremental(spark, sf_dir):
    c = stream(spark, sf_dir, "conversations")
    e = c.select(F.col("conv_id").alias("request_id"), F.col("turn").cast("double").alias("offset_ms"), F.when(F.col("role") == "assistant", F.col("text")).alias("answer"), F.when(F.col("role") == "user", F.col("text")).alias("reasoning"))
    return st.run_to_files(st.incremental_timing(e), f"i{uuid.uuid4().hex}", "complete")


@query("watcher_snapshot", f"{FACT} SELECT count(*) AS finished, count_if(outcome <> '2xx') AS failed, count(DISTINCT round_index) AS rounds, max(seq) AS last_seq FROM attempts")
def watcher(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return a.agg(F.count(F.lit(1)).alias("finished"), F.count_if(F.col("outcome") != "2xx").alias("failed"), F.count_distinct("round_index").alias("rounds"), F.max("seq").alias("last_seq"))


@query("request_deadlines_stream", "WITH e AS (SELECT conv_id, turn, turn * 7000.0 AS ms, turn = max(turn) OVER (PARTITION BY conv_id) AS done FROM conversations) SELECT conv_id::VARCHAR AS request_id, CASE WHEN max(ms) < 20000 THEN 'completed' ELSE 'timeout' END AS outcome, count_if(ms < 20000) AS events FROM e GROUP BY 1")
def request_deadlines(spark, sf_dir):
    """Turns as events seven seconds apart, the last of a conversation as its end."""
    last = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("last"))
    c = stream(spark, sf_dir, "conversations").join(last, F.col("conv_id") == F.col("c"))
    events = c.select(F.col("conv_id").cast("string").alias("request_id"), (F.col("turn") * 7000.0).alias("offset_ms"), (F.col("turn") == F.col("last")).alias("done"))
    return st.run_to_files(st.deadlines(events), f"t{uuid.uuid4().hex}")


@query("timed_deadlines_stream", """WITH e AS (SELECT conv_id, turn * 7000.0 AS ms, turn = max(turn) OVER (PARTITION BY conv_id) AS done FROM conversations), w AS (SELECT max(conv_id * 1000 + ms) - 10000 AS mark FROM e)
SELECT conv_id::VARCHAR AS request_id, CASE WHEN count_if(done AND ms < 20500) > 0 THEN 'completed' ELSE 'timeout' END AS outcome, count_if(ms < 20500) AS events, count_if(ms >= 20500) AS rejected FROM e, w WHERE conv_id * 1000 + 20500 < mark GROUP BY 1""")
def timed_deadlines(spark, sf_dir):
    """A request a second, its turns seven seconds apart; those whose deadline the watermark has passed."""
    last = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("c")).agg(F.max("turn").alias("last"))
    c = stream(spark, sf_dir, "conversations").join(last, F.col("conv_id") == F.col("c"))
    at = F.col("turn") * 7000
    events = c.select(F.col("conv_id").cast("string").alias("request_id"), at.cast("double").alias("offset_ms"), (F.col("turn") == F.col("last")).alias("done"), F.timestamp_millis(F.col("conv_id") * 1000 + at + 1_000_000).alias("event_time"))
    return st.run_to_files(st.timed_deadlines(events, limit_ms=20_500.0), f"t{uuid.uuid4().hex}")


@query("sse_framing_stream", "SELECT conv_id::VARCHAR AS request_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame, md5(text) AS data_md5, 1::BIGINT AS comments FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)")
def sse_framing_stream(spark, sf_dir):
    """Turns as events of three chunks that are cut after the seventh character and in the middle."""
    said = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.concat(F.lit("data: "), x, F.lit("\n"))), "")
    c = stream(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(": ping\n"), said, F.lit("\n")).alias("t"))
    half = (F.length("t") / 2).cast("int")
    parts = F.array(F.substring("t", 1, 7), F.substr("t", F.lit(8), half), F.substr("t", half + 8))
    chunks = c.select(F.col("conv_id").cast("string").alias("request_id"), "turn", F.posexplode(parts).alias("i", "chunk")).select("request_id", (F.col("turn") * 3 + F.col("i")).alias("turn"), "chunk", F.timestamp_seconds(F.lit(1000)).alias("event_time"))
    framed = st.run_to_files(st.framed_chunks(chunks), f"t{uuid.uuid4().hex}")
    return framed.select("request_id", "frame", F.md5(F.col("data").cast("binary")).alias("data_md5"), "comments")
