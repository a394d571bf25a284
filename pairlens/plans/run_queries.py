"""Queries that validate datasets and audit, accept and summarise whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import metrics, outcomes, paired, runs, schedule
from pairlens.sources.tables import attempts, request_facts, table

from .metrics_queries import FACT
from .record_queries import FAMILIES, TERMS, K
from .registry import query

GOLDS = (
    (0, '{"type":"name","value":"Ada"}', '["x"]', None), (0, '{"type":"name","value":5}', "[]", "gold value"), (0, '{"type":"name","value":"Ada"}', "[1]", "aliases"), (0, '{"value":"Ada"}', "[]", "gold fields"), (0, '["Ada"]', "[]", "gold is no object"),
    (1, '{"category":"bug","priority":"p1"}', "null", None), (1, '{"category":"bug","priority":"p9"}', "null", "gold priority"), (1, '{"category":["bug"],"priority":"p1"}', "null", "gold category"),
    (2, TERMS, "null", None), (2, TERMS.replace("2024-01-05", "2024-02-30"), "null", "gold effective_date"), (2, TERMS.replace(":12,", ":true,"), "null", "gold renewal_term_months"), (2, TERMS.replace(":true", ":null"), "null", "gold auto_renews"),
)


def _sql(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _pick(values, at):
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


@query("gold_problems", f"SELECT event_id, {_sql(g[3] for g in GOLDS)}[event_id % 12 + 1] AS problem FROM events")
def gold_problems(spark, sf_dir):
    at = F.col("event_id") % 12
    e = table(spark, sf_dir, "events").select("event_id", _pick([FAMILIES[g[0]] for g in GOLDS], at).alias("family"), F.parse_json(_pick([g[1] for g in GOLDS], at)).alias("gold"), F.parse_json(_pick([g[2] for g in GOLDS], at)).alias("aliases"))
    return e.select("event_id", runs.gold_problem(F.col("family"), F.col("gold"), F.col("aliases"), FAMILIES).alias("problem"))


ITEM = '{"id":"%s","use_case":"ticket-triage","split":"%s","prompt":{"system":"%s","user":"u"},"output_schema":{"category":"enum","priority":"%s"},"gold":{"category":"bug","priority":"%s"},"aliases":null,"tokens":{"user":%s}%s}'


@query("item_problems", "SELECT event_id AS line_no, CASE event_id % 10 WHEN 1 THEN 'family or split' WHEN 2 THEN 'prompt' WHEN 3 THEN 'output schema' WHEN 4 THEN 'gold' WHEN 5 THEN 'input token band' WHEN 6 THEN 'invalid JSON' WHEN 7 THEN 'id' WHEN 8 THEN 'missing fields' WHEN 9 THEN 'repeated id' END AS problem FROM events WHERE event_id % 10 <> 0 AND event_id <> 9")
def item_problems(spark, sf_dir):
    """Ten kinds of dataset line by the id's last digit; all lines that end in 9 share one id, and the first of them may have it."""
    d = F.col("event_id") % 10
    word = lambda when, odd, plain: F.when(d == when, odd).otherwise(plain)
    name = F.when(d == 7, "").when(d == 9, "same").otherwise(F.col("event_id").cast("string"))
    line = F.format_string(ITEM, name, word(1, "public", "private"), word(2, "other", "system"), word(3, "string", "enum"), word(4, "p7", "p0"), word(5, "99", "15"), word(6, ",", ""))
    line = F.when(d == 8, F.regexp_replace(line, '"aliases":null,', "")).otherwise(line)
    lines = table(spark, sf_dir, "events").select(F.lit("ticket-triage.jsonl").alias("file"), F.col("event_id").cast("long").alias("line_no"), line.alias("line"))
    spec = spark.range(1).select(F.lit("ticket-triage").alias("family"), F.lit("system").alias("template"), F.create_map(F.lit("priority"), F.lit("enum"), F.lit("category"), F.lit("enum")).alias("schema"), F.lit(10).alias("low"), F.lit(20).alias("high"), F.lit("user").alias("token_field"))
    return runs.item_problems(lines, spec, FAMILIES).select("line_no", "problem")


@query("item_counts", "SELECT * FROM (SELECT lang AS family, CASE WHEN lang = 'en' THEN 0 ELSE count(*) + CASE WHEN lang < 'e' THEN 1 ELSE 0 END END AS expected, count(*) AS found FROM documents WHERE lang IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, 1, count(DISTINCT doc_id % 50) FROM documents WHERE lang IS NOT NULL) WHERE expected <> found")
def item_counts(spark, sf_dir):
    """Documents as items by language, whose ids repeat after 50; one language is not expected, those before e lack an item."""
    d = table(spark, sf_dir, "documents").where("lang is not null")
    lines = d.select(F.concat("lang", F.lit(".jsonl")).alias("file"), F.to_json(F.struct((F.col("doc_id") % 50).cast("string").alias("id"), F.col("text"))).alias("line"))
    expected = d.where("lang <> 'en'").groupBy(F.col("lang").alias("family")).agg(F.count(F.lit(1)).alias("n")).select("family", (F.col("n") + (F.col("family") < "e").cast("int")).alias("items"))
    return runs.item_counts(lines, expected, 1)


def _arms(spark):
    return spark.range(11).select(F.concat(F.lit("arm"), F.col("id").cast("string")).alias("provider"))


EXPECTED = "(SELECT 3 * (count(*) // 30) FROM events)"


def _rounds(spark, sf_dir) -> int:
    return 3 * (table(spark, sf_dir, "events").count() // 30)


@query("provider_compatibility", f"{FACT}, c AS (SELECT provider, count(*) AS records, count_if(outcome <> 'transport_error') AS evidence, count_if(outcome = 'transport_error') AS known, bool_or(provider = 'arm3' AND k < 50 AND outcome <> 'transport_error') AS sampled, bool_or(provider IN ('arm3', 'arm4') AND k > 97 AND outcome <> 'transport_error') AS capped FROM attempts GROUP BY 1) "
       f"SELECT 'arm' || p AS provider, coalesce(records, 0) AS records, {EXPECTED}::INT AS expected_records, coalesce(evidence, 0) AS evidence_records, coalesce(known, 0) AS normalised_failures, array_to_string(list_filter([CASE WHEN capped THEN 'completion_ceiling_matches' END, CASE WHEN sampled THEN 'sampling_matches' END], lambda x: x IS NOT NULL), ',') AS reasons, coalesce(evidence, 0) > 0 AND NOT coalesce(sampled, false) AND NOT coalesce(capped, false) AS compatible FROM (SELECT unnest(range(11)) AS p) LEFT JOIN c ON c.provider = 'arm' || p")
def provider_compatibility(spark, sf_dir):
    known = '{"terminal_outcome":"runner_error","error":{"type":"AttributeError","message":"\'NoneType\' object has no attribute \'read\'"}}'
    a = attempts(spark, sf_dir).withColumn("record", F.parse_json(F.when(F.col("outcome") == "transport_error", known).otherwise("{}")))
    failed = outcomes.failed_checks({"sampling_matches": (F.col("provider") != "arm3") | (F.col("k") >= 50), "completion_ceiling_matches": ~F.col("provider").isin("arm3", "arm4") | (F.col("k") <= 97)})
    return runs.provider_compatibility(a, _arms(spark), _rounds(spark, sf_dir), failed).withColumn("reasons", F.array_join("reasons", ","))


@query("artifact_completeness", f"{FACT} SELECT 'arm' || p AS provider, coalesce(n, 0) AS records, coalesce(m, 0) AS evaluations, coalesce(m, 0) = {EXPECTED} AS complete FROM (SELECT unnest(range(11)) AS p) LEFT JOIN (SELECT provider, count(*) AS n, count_if(NOT (provider = 'arm6' AND k < 2)) AS m FROM attempts GROUP BY 1) c ON c.provider = 'arm' || p")
def artifact_completeness(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return runs.artifact_completeness(a, a.where("not (provider = 'arm6' and k < 2)"), _arms(spark), _rounds(spark, sf_dir))


def _violations(spark, sf_dir):
    """Saved evaluations, times, metrics and wins against their recomputation; a few saved values are off, and some events' channels."""
    fact = request_facts(spark, sf_dir)
    seq = F.col("seq")
    judged = fact.select("seq", outcomes.classification(F.col("outcome"), ~F.col("invalid"), F.col("correct")).alias("classification"))
    saved_judged = attempts(spark, sf_dir).select("seq", F.when(seq % 1000 == 7, "lost").when(F.col("outcome") != "2xx", "failed_request").when(F.col("k") < 4, "incorrect_result").when(F.col("k") == 4, "invalid_result").otherwise("valid_result").alias("classification"))
    times = fact.select("seq", "ttfa_ms", "e2e_ms")
    saved_times = attempts(spark, sf_dir).where("seq % 1000 <> 11").select("seq", F.when(F.col("outcome") == "2xx", F.col("value") / 2).alias("ttfa_ms"), F.when(F.col("outcome") == "2xx", F.col("value") + F.when(seq % 1000 == 13, 1.0).otherwise(0.0)).alias("e2e_ms"))
    now = metrics.combined_metrics(fact, [0, 1, 2]).select("provider", "submitted", "failed_count")
    counts = attempts(spark, sf_dir).groupBy("provider").agg(F.count(F.lit(1)).alias("submitted"), F.count_if(F.col("outcome") != "2xx").alias("failed_count"))
    saved_counts = counts.withColumn("failed_count", F.col("failed_count") + F.when(F.col("provider") == "arm2", 1).otherwise(0))
    wins = paired.fastest_wins(fact, "e2e_ms").select("provider", "total_rounds")
    saved_wins = attempts(spark, sf_dir).groupBy("provider").agg(F.count_distinct("round_index").alias("total_rounds"))
    channels = attempts(spark, sf_dir).where("seq % 1000 = 17").select(seq.cast("string").alias("request_id"), F.lit(0).alias("event_index"), F.lit("missing content_presence").alias("problem"))
    pairs = {"evaluations": (saved_judged, judged, ["seq"], ["classification"]), "timings": (saved_times, times, ["seq"], ["ttfa_ms", "e2e_ms"]), "metrics": (saved_counts, now, ["provider"], ["submitted", "failed_count"]), "paired": (saved_wins, wins, ["provider"], ["total_rounds"])}
    return runs.audit(pairs, channels)


@query("full_audit", f"""{FACT}, c AS (SELECT seq, CASE WHEN outcome <> '2xx' THEN 'failed_request' WHEN invalid THEN 'invalid_result' WHEN correct THEN 'valid_result' ELSE 'incorrect_result' END AS c, e2e_ms, ttfa_ms, provider FROM fact)
SELECT 'evaluations' AS part, seq::VARCHAR AS key, 'classification' AS "column" FROM c WHERE seq % 1000 = 7
UNION ALL SELECT 'timings', seq::VARCHAR, unnest(['ttfa_ms', 'e2e_ms']) FROM c WHERE seq % 1000 = 11
UNION ALL SELECT 'timings', seq::VARCHAR, 'e2e_ms' FROM c WHERE seq % 1000 = 13 AND e2e_ms IS NOT NULL
UNION ALL SELECT 'metrics', 'arm2', 'failed_count' FROM (SELECT 1 FROM fact LIMIT 1)
UNION ALL SELECT 'channels', seq || '|0', 'channel' FROM c WHERE seq % 1000 = 17""")
def full_audit(spark, sf_dir):
    return _violations(spark, sf_dir).select("part", "key", "column")



@query("smoke_acceptance", f"""{FACT}, p AS (SELECT provider, family, bool_or(outcome = '2xx') AS done, bool_or(outcome = '2xx' AND k % 50 > 0) AS said FROM fact GROUP BY ALL), t AS (SELECT bool_and(done) AS done, bool_and(said) AS said FROM p)
SELECT 0::BIGINT AS runner_errors, 0 AS local_artifact_errors, 0 AS database_writes, true AS raw_result_count_matches_submitted_request_count, (SELECT bool_and(outcome = '2xx' AND NOT invalid) FROM fact) AS every_provider_returns_schema_valid_result_per_task_family,
 done AS every_provider_completes_at_least_one_request_per_task_family, done AS every_provider_returns_http_2xx_per_task_family, said AS every_provider_returns_nonempty_answer_content_per_task_family, true AS every_provider_uses_intended_model_and_compatible_configuration,
 false AS stream_events_reconstruct_final_answers, false AS evaluations_recompute_from_raw_results, false AS timing_metrics_recompute_from_raw_stream_events, false AS aggregate_metrics_recompute_exactly, true AS paired_comparisons_recompute_exactly, false AS every_observed_reasoning_stream_is_timed_separately_from_answer_content, false AS accepted FROM t""")
def smoke_acceptance(spark, sf_dir):
    fact = request_facts(spark, sf_dir)
    ok = F.col("outcome") == "2xx"
    rows = fact.select("provider", "family", F.when(ok, "completed").otherwise("http_error").alias("terminal_outcome"), F.when(ok, 200).alias("status"), F.when(ok & (F.col("k") % 50 > 0), "said").otherwise(" ").alias("answer"), (ok & ~F.col("invalid")).alias("schema_valid"))
    expected = spark.range(10).select(F.concat(F.lit("arm"), F.col("id").cast("string")).alias("provider"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("family"))
    fits = expected.select("provider").distinct().withColumn("compatible", F.lit(True))
    return runs.smoke_acceptance(rows, expected, fits, _violations(spark, sf_dir), 10 * _rounds(spark, sf_dir), ("evaluations", "timings", "metrics", "paired", "channels"))


@query("full_success", f"{FACT} SELECT count_if(provider = 'arm6' AND k < 2) = 0 AS artifact_graph_complete, true AS provider_configuration_compatible, true AS stream_events_reconstruct_final_answers, true AS evaluations_recompute_from_raw_results, true AS timing_metrics_recompute_from_raw_stream_events, true AS aggregate_metrics_recompute_exactly, true AS paired_comparisons_recompute_exactly, true AS every_observed_reasoning_stream_is_timed_separately_from_answer_content, count_if(provider = 'arm6' AND k < 2) = 0 AS success FROM attempts")
def full_success(spark, sf_dir):
    from .audit_queries import audited

    found = audited(spark, sf_dir, False)
    a = attempts(spark, sf_dir)
    judged = a.where("not (provider = 'arm6' and k < 2)")
    arms = _arms(spark).where("provider <> 'arm10'")
    n = _rounds(spark, sf_dir)
    scheduled = a.select("seq", F.lit(True).alias("recorded")).join(judged.select("seq", F.lit(True).alias("evaluated")), "seq", "left").fillna(False, ["evaluated"])
    return runs.full_success(scheduled, runs.artifact_completeness(a, judged, arms, n), arms.withColumn("compatible", F.lit(True)), found.violations, found.parts)


@query("run_manifest", f"{FACT} SELECT {EXPECTED}::INT AS expected_rounds, 10 * {EXPECTED}::INT AS expected_requests, count(*) AS raw_records, min(lpad(seq::VARCHAR, 9, '0')) AS started_at, max(lpad((seq + k)::VARCHAR, 9, '0')) AS completed_at, count(*) AS evaluation_records, count_if(outcome = '2xx' AND NOT invalid) AS valid_records, count_if(invalid) AS invalid_records, count_if(outcome <> '2xx') AS failed_records FROM fact")
def run_manifest(spark, sf_dir):
    f = request_facts(spark, sf_dir)
    text = lambda c: F.lpad(c.cast("string"), 9, "0")
    rows = f.select(text(F.col("seq")).alias("started_at"), text(F.col("seq") + F.col("k")).alias("completed_at"))
    judged = f.select(outcomes.classification(F.col("outcome"), ~F.col("invalid"), F.col("correct")).alias("classification"))
    n = _rounds(spark, sf_dir)
    return runs.manifest(rows, judged, n, 10 * n)


@query("attempt_summary", f"{FACT} SELECT round_index % 2 + 1 AS attempt, count(*) AS finished, count_if(outcome <> '2xx') AS failed, count_if(k % 2 = 0) AS calls FROM attempts GROUP BY 1")
def attempt_summary(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("attempt", F.col("round_index") % 2 + 1)
    return runs.attempt_summary(a, a.select("attempt", F.when(F.col("k") % 2 == 0, "external_call_started").otherwise("other").alias("kind")))


@query("records_with_round_skew", f"{FACT}, s AS (SELECT round_index, (max(seq * 1000 + k) - min(seq * 1000 + k)) / 1e6 AS skew FROM attempts GROUP BY 1) SELECT seq, CASE WHEN round_index % 3 > 0 THEN skew END AS round_launch_skew_ms FROM attempts JOIN s USING (round_index)")
def records_with_round_skew(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("round_id", F.col("round_index"))
    known = schedule.launch_skew(a.where("round_index % 3 > 0").select("round_id", (F.col("seq") * 1000 + F.col("k")).alias("start_ns")))
    return runs.with_round_skew(a, known).select("seq", "round_launch_skew_ms")


@query("records_with_prior", f"SELECT event_id AS request_id, {K} AS k FROM events")
def records_with_prior(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return runs.with_prior(e.where("request_id % 3 < 2"), e.where("request_id % 3 > 0"))
