"""Queries from saved records to facts and metrics: each event of the event table is written as one saved record and derived again."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions.jsonstrict import token_count
from pairlens.operators import metrics, paired, records
from pairlens.sources.tables import PRICES, attempts, spread

from .metrics_queries import AGG, FACT
from .record_queries import FAMILIES, TERMS
from .registry import query

GOLD = ('{"type":"name","value":"Ada Lovelace"}', '{"category":"bug","priority":"p1"}', TERMS)
RIGHT = ('{"answer":"ADA  lovelace"}', GOLD[1], TERMS)
WRONG = ('{"answer":"Bob"}', '{"category":"bug","priority":"p2"}', TERMS.replace(":12,", ":13,"))
INVALID = "{} {} {}"


def _by_family(values, at="family"):
    return F.get(F.array(*[F.lit(v) for v in values]), F.col(at))


def items(spark):
    return spark.range(3).select(F.col("id").cast("string").alias("item_id"), F.get(F.array(*[F.lit(x) for x in FAMILIES]), F.col("id").cast("int")).alias("family"), F.get(F.array(*[F.lit(x) for x in GOLD]), F.col("id").cast("int")).alias("gold"), F.array(F.lit("Countess")).alias("aliases"))


def prices(spark):
    return spark.range(10).select(F.concat(F.lit("arm"), F.col("id").cast("string")).alias("provider"), *[F.when(F.col("id") == 3, PRICES["arm3"][i]).otherwise(PRICES["default"][i]).alias(n) for i, n in enumerate(("price_in", "price_out"))])


def saved_records(spark, sf_dir):
    """(request_id, seq, record) of every event: answers right from k = 5, broken at 4, wrong below; failures without events; every seventh with saved times in place of events; usage and cost in five and four forms."""
    a = spread(attempts(spark, sf_dir, balanced=False), "seq")
    seq, k, v = F.col("seq"), F.col("k"), F.col("value")
    ok, by_times = F.col("outcome") == "2xx", seq % 7 == 0
    said = F.when(k == 4, INVALID).when(k > 4, _by_family(RIGHT)).otherwise(_by_family(WRONG))
    thought = F.expr("repeat('r ', k % 3)")
    event = lambda at, name, t: F.struct(at.alias("offset_ms"), (t if name == "reasoning_content" else F.lit(None).cast("string")).alias("reasoning_content"), (t if name == "answer_content" else F.lit(None).cast("string")).alias("answer_content"))
    parts = F.array(event(v * 0.25, "reasoning_content", thought), event(v * 0.5, "answer_content", F.substring(said, 1, 5)), event(v, "answer_content", F.substring(said, 6, 1000)))
    events = F.when(ok & ~by_times, F.filter(F.when(v > 0, F.reverse(parts)).otherwise(parts), lambda e: (F.coalesce(e["answer_content"], e["reasoning_content"]) != "")))
    timings = F.when(ok & by_times, F.struct(F.when(k % 3 > 0, v * 0.25).alias("ttfo_ms"), (v * 0.5).alias("ttfa_ms"), v.alias("e2e_latency_ms"), (k % 3).alias("pre_answer_reasoning_tokens")))
    status = F.when(ok, 200).when(F.col("outcome") == "429", 429).when(F.col("outcome") == "5xx", 503)
    number = lambda f, c: F.when(seq % 4 == f, c)
    usage = F.when(ok, F.struct(number(0, k + 20).alias("input_tokens"), number(0, k).alias("output_tokens"), F.coalesce(number(1, k + 20), number(3, F.lit(-1))).alias("prompt_tokens"), F.coalesce(number(1, k), number(3, k)).alias("completion_tokens")))
    plain = F.to_json(
        F.struct(
            F.col("round_index").cast("string").alias("round_id"), "provider", _by_family(FAMILIES).alias("task_family"), F.col("family").cast("string").alias("item_id"), status.alias("http_status"), F.when(F.col("outcome").isin("timeout", "transport_error"), F.col("outcome")).alias("terminal_outcome"),
            F.when(ok, said).alias("reconstructed_answer"), F.when(ok & ~by_times, thought).alias("reconstructed_reasoning"), events.alias("stream_events"), timings.alias("timings"), usage.alias("usage"), F.when(seq % 5 == 0, k / 1000).alias("cost_usd"), F.when(seq % 11 == 0, seq % 2 == 0).alias("configuration_compatible"),
        )
    )
    plain = F.when(seq % 5 == 1, F.concat(F.lit('{"cost_usd":null,'), F.substring(plain, 2, 1 << 30))).otherwise(plain)
    return a.select(seq.cast("string").alias("request_id"), "seq", F.parse_json(plain).alias("record"))


def facts(spark, sf_dir, watch=None):
    return records.record_facts(saved_records(spark, sf_dir).select("request_id", "record"), items(spark), prices(spark), FAMILIES, token_count(), watch)


def _pick(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "][family + 1]"


_BASE = FACT.split("f0 AS")[0].replace(" WHERE round_index < 3 * ((SELECT count(*) FROM events) // 30)", "")
#: DuckDB twin of facts.
DERIVED = _BASE + f"""d0 AS (SELECT *, outcome = '2xx' AS ok, CASE WHEN k = 4 THEN '{INVALID}' WHEN k > 4 THEN {_pick(RIGHT)} ELSE {_pick(WRONG)} END AS said FROM attempts),
fact AS (SELECT seq, seq::VARCHAR AS request_id, round_index::VARCHAR AS round_id, provider, {_pick(FAMILIES)} AS family, outcome, k, ok AND k >= 5 AS correct, ok AND k = 4 AS invalid, CASE WHEN ok THEN CASE WHEN k % 3 > 0 THEN value * 0.25e0 ELSE value * 0.5e0 END END AS ttfo_ms, CASE WHEN ok THEN value * 0.5e0 END AS ttfa_ms,
 CASE WHEN ok THEN value END AS e2e_ms, CASE WHEN ok THEN CAST(k % 3 AS BIGINT) END AS pre_answer_reasoning_tokens, CASE WHEN ok THEN k % 3 > 0 END AS reasoning_emitted, CASE WHEN ok THEN len(regexp_extract_all(said, '\\w+|[^\\w\\s]'))::BIGINT END AS answer_tokens,
 CASE WHEN ok AND value > value * 0.5e0 THEN (answer_tokens - 1) / ((value - value * 0.5e0) / 1000e0) END AS speed, CASE WHEN ok AND seq % 4 < 2 THEN CAST(k + 20 AS BIGINT) END AS tokens_in, CASE WHEN ok AND seq % 4 < 2 THEN CAST(k AS BIGINT) END AS tokens_out,
 CASE WHEN seq % 5 = 0 THEN k / 1000e0 WHEN seq % 5 > 1 THEN (tokens_in * (CASE WHEN provider = 'arm3' THEN 0.45e0 ELSE 0.15e0 END) + tokens_out * (CASE WHEN provider = 'arm3' THEN 1.5e0 ELSE 0.5e0 END)) / 1e6 END AS cost_usd,
 CASE WHEN seq % 11 = 0 THEN seq % 2 = 0 ELSE true END AS compatible, CASE WHEN ok AND seq % 7 > 0 THEN 'stream_events' ELSE 'persisted_timings' END AS source FROM d0)
"""


@query("derived_facts", f"""{DERIVED} SELECT request_id, round_id, provider, family, outcome, CASE WHEN NOT ok THEN 'failed_request' WHEN invalid THEN 'invalid_result' WHEN correct THEN 'valid_result' ELSE 'incorrect_result' END AS classification, source, ttfo_ms, ttfa_ms, e2e_ms, pre_answer_reasoning_tokens, reasoning_emitted, coalesce(answer_tokens, CASE WHEN source = 'stream_events' THEN 0 END) AS answer_tokens, speed, tokens_in, tokens_out, cost_usd, compatible
FROM (SELECT *, outcome = '2xx' AS ok FROM fact)""")
def derived_facts(spark, sf_dir):
    return facts(spark, sf_dir).select("request_id", "round_id", "provider", "family", "outcome", "classification", "source", "ttfo_ms", "ttfa_ms", "e2e_ms", "pre_answer_reasoning_tokens", "reasoning_emitted", "answer_tokens", "speed", "tokens_in", "tokens_out", "cost_usd", "compatible")


@query("derived_family_metrics", f"{DERIVED} SELECT provider, family, {AGG} FROM fact GROUP BY provider, family")
def derived_family_metrics(spark, sf_dir):
    return metrics.family_metrics(facts(spark, sf_dir))


@query("derived_eligibility", f"{DERIVED} SELECT provider, bool_and(compatible) AS compatible, count(DISTINCT round_id) AS rounds FROM fact GROUP BY provider")
def derived_eligibility(spark, sf_dir):
    f = facts(spark, sf_dir)
    return paired.paired_eligibility(f, F.col("compatible"), F.col("artifact_complete")).select("provider", "compatible", "rounds")
