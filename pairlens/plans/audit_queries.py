"""Audits of a run whose saved records hold everything a runner writes, with planted faults or without."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions.jsonstrict import token_count
from pairlens.functions.stats import output_speed, token_cost
from pairlens.operators import audit, metrics, outcomes, paired, runs
from pairlens.operators.records import JUDGEMENT
from pairlens.sources.tables import PRICES, attempts, spread

from .derive_queries import DERIVED, INVALID, RIGHT, WRONG, _by_family, items, prices
from .record_queries import FAMILIES
from .registry import query

#: What is off in a record whose sequence number leaves this rest by 97.
TTFO, TOKENS, REASONING, CHANNEL, EVENTS, CLASS, LOST, COUNT, MARK = range(1, 10)


def plain_facts(spark, sf_dir):
    """The facts of run_records by formula, without records."""
    a = attempts(spark, sf_dir, balanced=False)
    ok, k, v, seq = F.col("outcome") == "2xx", F.col("k"), F.col("value"), F.col("seq")
    said = F.when(k == 4, INVALID).when(k > 4, _by_family(RIGHT)).otherwise(_by_family(WRONG))
    tokens = F.when(ok, F.regexp_count(said, F.lit("\\w+|[^\\w\\s]")).cast("long"))
    known = ok & (seq % 4 < 2)
    into, out = (F.when(known, c.cast("long")) for c in (k + 20, k))
    price = [F.when(F.col("provider") == "arm3", PRICES["arm3"][i]).otherwise(PRICES["default"][i]) for i in (0, 1)]
    found = a.select(
        "seq", seq.cast("string").alias("request_id"), F.col("round_index").cast("string").alias("round_id"), "provider", _by_family(FAMILIES).alias("family"), F.col("family").alias("f"), "outcome", "k", (ok & (k >= 5)).alias("correct"), (ok & (k == 4)).alias("invalid"), said.alias("said"),
        F.when(ok, F.when(k % 3 > 0, v * 0.25).otherwise(v * 0.5)).alias("ttfo_ms"), F.when(ok, v * 0.5).alias("ttfa_ms"), F.when(ok, v).alias("e2e_ms"), F.when(ok, k.cast("long") % 3).alias("pre_answer_reasoning_tokens"), F.when(ok, k % 3 > 0).alias("reasoning_emitted"), tokens.alias("answer_tokens"),
        output_speed(tokens, v * 0.5, v, ok).alias("speed"), into.alias("tokens_in"), out.alias("tokens_out"), F.when(seq % 5 == 0, k / 1000).when(seq % 5 > 1, token_cost(into, out, *price)).alias("cost_usd"),
    )
    kind = outcomes.classification(F.col("outcome"), ~F.col("invalid"), F.col("correct"))
    error = F.when(F.col("outcome") == "429", "rate_limited_http_429").when(F.col("outcome") == "5xx", "http_5xx").when(F.col("outcome") != "2xx", F.col("outcome")).when(F.col("invalid"), "malformed_json")
    fields = F.when((F.col("f") == 2) & (F.col("outcome") == "2xx"), F.when(F.col("invalid"), 0).when(F.col("correct"), 10).otherwise(9))
    return found.withColumns({"classification": kind, "error_type": error, "schema_valid": F.when(F.col("outcome") == "2xx", ~F.col("invalid")), "correct_field_count": fields})


def run_records(spark, sf_dir, faulty):
    """(request_id, record): all that a runner saves, with the faults of this module's rests if ``faulty``."""
    f = spread(plain_facts(spark, sf_dir), "seq")
    seq, k, ok = F.col("seq"), F.col("k"), F.col("outcome") == "2xx"
    off = lambda rest: F.lit(faulty) & (seq % 97 == rest)
    thought, said = F.expr("repeat('r ', k % 3)"), F.col("said")
    none = F.lit(None).cast("string")

    def event(at, reasoning, answer, first=False):
        shown = F.struct((F.length(reasoning) > 0).alias("reasoning"), (F.length(answer) > 0).alias("answer"))
        return F.struct(at.alias("monotonic_offset_ms"), F.when(F.length(reasoning) > 0, "reasoning").otherwise("answer").alias("classification"), reasoning.alias("reasoning_content"), answer.alias("answer_content"), (F.when(~off(CHANNEL), shown) if first else shown).alias("content_presence"))

    parts = F.array(event(F.col("ttfo_ms"), thought, F.lit("")), event(F.col("ttfa_ms"), F.lit(""), F.substring(said, 1, 5), True), event(F.col("e2e_ms"), F.lit(""), F.substring(said, 6, 1000)))
    events = F.when(ok & ~off(EVENTS), F.filter(parts, lambda e: F.length(e["reasoning_content"]) + F.length(e["answer_content"]) > 0)).otherwise(F.slice(parts, 1, 0))
    times = F.when(ok, F.struct(F.when(off(TTFO), F.col("ttfo_ms") + 1).otherwise(F.col("ttfo_ms")).alias("ttfo_ms"), "ttfa_ms", "pre_answer_reasoning_tokens", F.col("reasoning_emitted").alias("reasoning_emitted_before_answer"), F.col("e2e_ms").alias("e2e_latency_ms"), F.col("ttfa_ms").alias("first_answer_token_ms"), F.col("e2e_ms").alias("last_answer_token_ms"), (F.col("answer_tokens") - F.when(off(TOKENS), 1).otherwise(0)).alias("visible_answer_token_count"), F.col("speed").alias("output_tokens_per_second")))
    usage = F.when(ok, F.struct(F.col("tokens_in").alias("prompt_tokens"), F.col("tokens_out").alias("completion_tokens")))
    status = F.when(ok, 200).when(F.col("outcome") == "429", 429).when(F.col("outcome") == "5xx", 503)
    plain = F.to_json(
        F.struct(
            "round_id", "provider", F.col("family").alias("task_family"), F.col("f").cast("string").alias("item_id"), status.alias("http_status"), F.when(ok, "completed").when(F.col("outcome").isin("timeout", "transport_error"), F.col("outcome")).otherwise("http_error").alias("terminal_outcome"),
            F.when(ok, said).alias("reconstructed_answer"), F.when(ok, F.when(off(REASONING), "other").otherwise(thought)).alias("reconstructed_reasoning"), events.alias("stream_events"), times.alias("timings"), usage.alias("usage"), "cost_usd",
        )
    )
    plain = F.when(seq % 5 == 1, F.concat(F.lit('{"cost_usd":null,'), F.substring(plain, 2, 1 << 30))).otherwise(plain)
    return f.select("request_id", F.parse_json(plain).alias("record"))


def audited(spark, sf_dir, faulty):
    """The audit of run_records against evaluations, metrics and paired results that are saved from plain_facts."""
    f = plain_facts(spark, sf_dir)
    seq = F.col("seq")
    off = lambda rest: F.lit(faulty) & (seq % 97 == rest)
    judged = f.where(~off(LOST)).withColumn("classification", F.when(off(CLASS), "lost").otherwise(F.col("classification"))).select("request_id", *JUDGEMENT)
    wrong = lambda name, column, step: F.col(column) + F.when(F.lit(faulty) & (F.col("provider") == name), step).otherwise(0)
    table = metrics.family_metrics(f, order_free=True).withColumn("correct_count", wrong("arm2", "correct_count", 1))
    wins = paired.fastest_wins(f, "e2e_ms").withColumn("credit", wrong("arm5", "credit", 1.0))
    apart = paired.pairwise(f, "ttfa_ms").withColumn("paired_count", F.col("paired_count") + F.when(F.lit(faulty) & (F.col("provider_a") == "arm0") & (F.col("provider_b") == "arm1"), 1).otherwise(0))
    n = F.when((F.col("outcome") == "2xx") & ~off(EVENTS), 2 + (F.col("k") % 3 > 0).cast("int") - off(COUNT).cast("int")).otherwise(0)
    durable = f.select("request_id", F.explode(F.array_repeat(F.when(off(MARK), "late").otherwise("arrival_atomic"), n)).alias("durability"))
    return audit.audit_run(run_records(spark, sf_dir, faulty), items(spark), prices(spark), FAMILIES, token_count(), judged, table, {"e2e_ms": wins}, {"ttfa_ms": apart}, durable)


FAULTS = f"""{DERIVED}, s AS (SELECT request_id, seq % 97 AS rest, outcome = '2xx' AS ok, provider, family, k FROM fact),
faults AS (SELECT 'timings' AS part, request_id AS key, 'ttfo_ms' AS "column" FROM s WHERE ok AND rest = {TTFO}
UNION ALL SELECT 'timings', request_id, 'visible_answer_token_count' FROM s WHERE ok AND rest = {TOKENS}
UNION ALL SELECT unnest(['evaluations', 'timings', 'reconstruction']), request_id, 'recomputation' FROM s WHERE ok AND rest = {REASONING}
UNION ALL SELECT 'channels', request_id || CASE WHEN k % 3 > 0 THEN '|1' ELSE '|0' END, 'channel' FROM s WHERE ok AND rest = {CHANNEL}
UNION ALL SELECT 'reconstruction', request_id, 'stream_events' FROM s WHERE ok AND rest = {EVENTS}
UNION ALL SELECT 'evaluations', request_id, 'classification' FROM s WHERE rest = {CLASS}
UNION ALL SELECT 'evaluations', request_id, 'copies' FROM s WHERE rest = {LOST}
UNION ALL SELECT 'reconstruction', request_id, 'durable_events' FROM s WHERE ok AND rest = {COUNT}
UNION ALL SELECT 'reconstruction', request_id, 'durability' FROM s WHERE ok AND rest = {MARK}
UNION ALL SELECT DISTINCT 'metrics', 'arm2|' || family, 'correct_count' FROM s WHERE provider = 'arm2'
UNION ALL SELECT DISTINCT 'paired', 'e2e_ms|arm5', 'credit' FROM s WHERE provider = 'arm5'
UNION ALL SELECT DISTINCT 'paired', 'ttfa_ms|arm0|arm1', 'paired_count' FROM s WHERE provider = 'arm1')
"""


@query("run_audit", f'{FAULTS} SELECT part, key, "column" FROM faults')
def run_audit(spark, sf_dir):
    return audited(spark, sf_dir, True).violations.select("part", "key", "column")


@query("clean_run_audit", f"{DERIVED} SELECT count(*) AS records, 0::BIGINT AS violations FROM fact")
def clean_run_audit(spark, sf_dir):
    n = attempts(spark, sf_dir, balanced=False).agg(F.count(F.lit(1)).alias("records"))
    return n.crossJoin(F.broadcast(audited(spark, sf_dir, False).violations.agg(F.count(F.lit(1)).alias("violations"))))


_CONDITIONS = ", ".join(f"(SELECT count(*) FROM faults WHERE part = '{p}') = 0 AS {c}" for c, p in runs.PARTS.items())


@query("faulty_run_success", f"{FAULTS}, u AS (SELECT count_if(rest = {LOST}) = 0 AS whole FROM s) SELECT whole AS artifact_graph_complete, false AS provider_configuration_compatible, {_CONDITIONS}, false AS success FROM u")
def faulty_run_success(spark, sf_dir):
    """The faulty run: some evaluations are lost, one provider is incompatible, and every part has a fault."""
    found = audited(spark, sf_dir, True)
    f = plain_facts(spark, sf_dir)
    scheduled = f.select(F.lit(True).alias("recorded"), (F.col("seq") % 97 != LOST).alias("evaluated"))
    per = f.groupBy("provider").agg((F.count_if(F.col("seq") % 97 == LOST) == 0).alias("complete"), F.first(F.col("provider") != "arm0").alias("compatible"))
    return runs.full_success(scheduled, per, per, found.violations, found.parts)
