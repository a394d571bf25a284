"""Queries over saved records, written as JSON from the event and conversation tables and read back as VARIANT."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import records
from pairlens.sources.tables import attempts, spread, table

from .metrics_queries import FACT
from .registry import query

#: JSON members of ten kinds of terminal record, and the outcome that each means.
TERMINALS = (
    ('"http_status":200', "2xx"), ('"status_code":204,"terminal_status":"completed"', "2xx"), ('"http_status":429,"terminal_outcome":"http_error"', "429"), ('"http_status":404', "other_4xx"), ('"http_status":503', "5xx"),
    ('"http_status":200,"terminal_outcome":"timed_out"', "timeout"), ('"http_status":null,"status_code":200,"terminal_outcome":"http_429"', "429"), ('"terminal_outcome":"transport-error"', "transport_error"),
    ('"terminal_outcome":"runner_error","error":{"type":"AttributeError","message":"\'NoneType\' object has no attribute \'read\'"},"stream_events":[]', "transport_error"), ('"terminal_outcome":"http_5xx"', "5xx"),
)
OUTCOME_SQL = "[" + ", ".join(f"'{o}'" for _, o in TERMINALS) + "][event_id % 10 + 1]"


def _terminals(spark, sf_dir):
    forms = F.array(*[F.lit("{" + j + "}") for j, _ in TERMINALS])
    return table(spark, sf_dir, "events").select("event_id", F.parse_json(F.get(forms, (F.col("event_id") % 10).cast("int"))).alias("record"))


@query("record_outcomes", f"SELECT event_id, {OUTCOME_SQL} AS outcome, event_id % 10 = 8 AS known, event_id % 10 = 8 AS shell FROM events")
def record_outcomes(spark, sf_dir):
    r = F.col("record")
    return _terminals(spark, sf_dir).select("event_id", records.record_outcome(r).alias("outcome"), records.known_signature(r).alias("known"), records.known_signature(r, shell=True).alias("shell"))


@query("failure_labels", "SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'completed' ELSE 'http_error' END AS label, CASE WHEN event_id % 10 IN (1, 2) THEN ['timeout', 'transport_error'][event_id % 10] WHEN event_id % 10 = 3 THEN 'http_429' WHEN event_id % 10 BETWEEN 4 AND 6 THEN 'other_http_4xx' WHEN event_id % 10 > 6 THEN 'http_5xx' END AS failure FROM events")
def failure_labels(spark, sf_dir):
    e = F.col("event_id") % 10
    status = F.when(e == 0, 200).when(e == 3, 429).when(e.between(4, 6), 399 + e).when(e > 6, 493 + e)
    outcome = F.when(e == 1, "timeout").when(e == 2, "transport_error").otherwise("completed")
    return table(spark, sf_dir, "events").select("event_id", records.terminal_label(status).alias("label"), records.failure_label(status, outcome).alias("failure"))


def _spoken(spark, sf_dir):
    """Conversation turns as saved stream events in four spellings."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), (F.col("role") == "assistant").alias("says"))
    t, m = F.col("text"), F.col("turn") % 4
    one = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    at = F.col("turn")
    explicit = F.when(F.col("says"), one(monotonic_offset_ms=at, answer_content=t)).otherwise(one(monotonic_offset_ms=at, reasoning_content=t))
    classed = one(offset_ms=at, classification=F.when(F.col("says"), "answer_delta").otherwise("reasoning"), content=t)
    inner = F.when(F.col("says"), one(content=t)).otherwise(one(reasoning_content=t))
    payload = F.concat(F.lit('{"elapsed_ms":'), at.cast("string"), F.lit(',"payload":{"choices":[{"delta":'), inner, F.lit("}]}}"))
    empty = F.concat(F.lit('{"arrival_offset_ms":'), at.cast("string"), F.lit(',"answer_content":"","reasoning_content":"","payload":{"choices":[{"delta":'), inner, F.lit("}]}}"))
    return c.select("conv_id", "turn", F.when(m == 0, explicit).when(m == 1, classed).when(m == 2, payload).otherwise(empty).alias("json"))


SAID = "CASE WHEN turn % 4 = 3 THEN '' ELSE coalesce(text, '') END"


@query("event_deltas", f"SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' THEN '' ELSE {SAID} END) AS reasoning_md5, md5(CASE WHEN role = 'assistant' THEN {SAID} ELSE '' END) AS answer_md5 FROM conversations")
def event_deltas(spark, sf_dir):
    reasoning, answer = records.delta(F.col("e"))
    md5 = lambda c: F.md5(c.cast("binary"))
    return _spoken(spark, sf_dir).select("conv_id", "turn", F.parse_json("json").alias("e")).select("conv_id", "turn", md5(reasoning).alias("reasoning_md5"), md5(answer).alias("answer_md5"))


@query("record_timing", f"""WITH ev AS (SELECT conv_id, turn, {SAID} AS t, role = 'assistant' AS says FROM conversations),
a AS (SELECT conv_id, min(turn) FILTER (WHERE says AND t <> '') AS first, max(turn) FILTER (WHERE says AND t <> '') AS last, min(turn) FILTER (WHERE t <> '') AS any_ms, sum(length(t)) FILTER (WHERE says) AS n FROM ev GROUP BY 1),
p AS (SELECT ev.conv_id, sum(length(t)) AS pre FROM ev JOIN a USING (conv_id) WHERE NOT says AND turn <= first GROUP BY 1)
SELECT conv_id, 'stream_events' AS source, CASE WHEN first IS NOT NULL THEN any_ms::DOUBLE END AS ttfo_ms, first::DOUBLE AS ttfa_ms, CASE WHEN conv_id % 5 <> 0 THEN last::DOUBLE END AS e2e_ms, CASE WHEN first IS NOT NULL THEN coalesce(pre, 0)::BIGINT END AS pre_answer_reasoning_tokens,
 coalesce(n, 0)::BIGINT AS answer_tokens, CASE WHEN conv_id % 5 <> 0 AND n >= 2 AND last > first THEN (n - 1) / ((last - first) / 1000e0) END AS speed FROM a LEFT JOIN p USING (conv_id)""")
def record_timing(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "json"))), lambda x: x["json"])
    status = F.when(F.col("conv_id") % 5 == 0, '"terminal_outcome":"timeout"').otherwise('"http_status":200')
    saved = _spoken(spark, sf_dir).groupBy("conv_id").agg(F.array_join(parts, ",").alias("events")).select(F.col("conv_id").alias("request_id"), F.parse_json(F.concat(F.lit("{"), status, F.lit(',"stream_events":['), F.col("events"), F.lit("]}"))).alias("record"))
    return records.record_timing(saved, F.length).select(F.col("request_id").alias("conv_id"), "source", "ttfo_ms", "ttfa_ms", "e2e_ms", "pre_answer_reasoning_tokens", "answer_tokens", "speed")


K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("saved_timing_fallback", f"SELECT event_id, 'persisted_timings' AS source, CASE WHEN k % 4 <> 3 THEN (CASE WHEN k % 4 = 1 THEN 5 ELSE 10 END)::DOUBLE END AS ttfo_ms, CASE WHEN k % 4 <> 3 THEN 10e0 END AS ttfa_ms, CASE WHEN k % 4 IN (0, 1) THEN (10 + k)::DOUBLE END AS e2e_ms, CASE WHEN k % 4 IN (0, 1) THEN CASE WHEN k % 4 = 1 THEN 7e0 WHEN k > 0 THEN 2 / (k / 1000e0) END END AS speed, k % 4 IN (0, 1) AS complete FROM (SELECT event_id, {K} AS k FROM events)")
def saved_timing(spark, sf_dir):
    """k % 4: 0 record members, 1 timings with own ttfo and speed, 2 a timeout after output, 3 a failure without any."""
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    end = F.format_string("%d", 10 + F.col("k"))
    forms = [
        F.concat(F.lit('{"http_status":200,"answer":"abc","first_answer_token_ms":10,"last_answer_token_ms":'), end, F.lit(',"e2e_latency_ms":'), end, F.lit("}")),
        F.concat(F.lit('{"http_status":200,"reconstructed_answer":"abc","ttfo_ms":9,"timings":{"ttfo_ms":5,"ttfa_ms":10,"output_tokens_per_second":7,"e2e_latency_ms":'), end, F.lit("}}")),
        F.lit('{"terminal_outcome":"timeout","answer":"ab","ttfa_ms":10,"e2e_latency_ms":20}'), F.lit('{"terminal_outcome":"transport_error"}'),
    ]
    saved = e.select(F.col("event_id").cast("string").alias("request_id"), F.parse_json(F.get(F.array(*forms), F.col("k") % 4)).alias("record"))
    return records.record_timing(saved, F.length).select(F.col("request_id").cast("long").alias("event_id"), "source", "ttfo_ms", "ttfa_ms", "e2e_ms", "speed", "complete")


FAMILIES = ("meeting-notes-lookup", "ticket-triage", "contract-terms-extraction")
TERMS = '{"agreement_type":"saas_subscription","effective_date":"2024-01-05","initial_term_end_date":"2025-01-05","auto_renews":true,"renewal_term_months":12,"non_renewal_notice_days":null,"payment_terms_days":30,"termination_for_convenience":false,"termination_notice_days":60,"security_incident_notice_hours":72}'


@query("record_evaluations", f"""WITH r AS (SELECT event_id, event_id % 3 AS f, {K} AS k FROM events)
SELECT event_id, CASE WHEN k < 20 THEN CASE WHEN k < 10 THEN '429' ELSE 'timeout' END ELSE '2xx' END AS outcome,
CASE WHEN k < 20 THEN 'failed_request' WHEN k < 40 THEN 'invalid_result' WHEN k < 60 AND f < 2 THEN 'incorrect_result' WHEN k < 60 THEN 'invalid_result' ELSE 'valid_result' END AS classification,
CASE WHEN k < 10 THEN 'rate_limited_http_429' WHEN k < 20 THEN 'timeout' WHEN k < 40 THEN 'malformed_json' WHEN k < 60 AND f = 2 THEN 'schema_invalid' END AS error_type, k >= 60 AS correct,
CASE WHEN f = 2 AND k >= 20 THEN CASE WHEN k < 40 THEN 0 ELSE 10 END END AS correct_field_count FROM r""")
def record_evaluations(spark, sf_dir):
    """One item a family; answers fail, break, miss (a contract number as 12.0: equal but no integer) or hit by k."""
    gold = ('{"type":"name","value":"Ada Lovelace"}', '{"category":"bug","priority":"p1"}', TERMS)
    items = spark.range(3).select(F.col("id").cast("string").alias("item_id"), F.get(F.array(*[F.lit(x) for x in FAMILIES]), F.col("id").cast("int")).alias("family"), F.get(F.array(*[F.lit(x) for x in gold]), F.col("id").cast("int")).alias("gold"), F.array(F.lit("Countess")).alias("aliases"))
    f, k = (F.col("event_id") % 3).cast("int"), F.col("k")
    pick = lambda *x: F.get(F.array(*[F.lit(v) for v in x]), f)
    hit = pick('{"answer":" ADA  lovelace"}', gold[1], TERMS)
    said = F.when(k < 40, "{} {}").when(k < 60, pick('{"answer":"Bob"}', '{"category":"bug","priority":"p2"}', TERMS.replace(":12,", ":12.0,"))).otherwise(hit)
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    doc = F.to_json(F.struct(F.lit("arm").alias("provider"), pick(*FAMILIES).alias("task_family"), F.when(k < 10, 429).when(k >= 20, 200).alias("http_status"), F.when(k.between(10, 19), "timeout").alias("terminal_outcome"), said.alias("answer")))
    saved = e.select(F.col("event_id").cast("string").alias("request_id"), f.cast("string").alias("item_id"), F.parse_json(doc).alias("record"))
    return records.evaluate_records(items, saved, FAMILIES).select(F.col("request_id").cast("long").alias("event_id"), "outcome", "classification", "error_type", "correct", "correct_field_count")


COMPATIBLE = (
    ("{}", True, True), ('{"configuration_compatible":null,"provider_configuration_compatible":true}', False, True), ('{"provider_configuration_compatible":true,"model_identity":{"matches":false}}', True, True), ('{"model_identity":{"matches":null}}', False, True),
    ('{"adapter_compatibility":{"status":"unsupported"},"artifact_complete":false}', False, False), ('{"configuration_checks":{"a":true,"b":1}}', False, True), ('{"local_artifact_graph_complete":false,"artifact_complete":true}', True, False), ('{"configuration_checks":{"a":true}}', True, True),
)


@query("record_compatibility", f"SELECT event_id, [{', '.join(str(c) for _, c, _ in COMPATIBLE)}][event_id % 8 + 1] AS compatible, [{', '.join(str(a) for _, _, a in COMPATIBLE)}][event_id % 8 + 1] AS complete FROM events")
def record_compatibility(spark, sf_dir):
    r = table(spark, sf_dir, "events").select("event_id", F.parse_json(F.get(F.array(*[F.lit(j) for j, _, _ in COMPATIBLE]), (F.col("event_id") % 8).cast("int"))).alias("record"))
    return r.select("event_id", records.record_compatible(F.col("record")).alias("compatible"), records.artifact_complete(F.col("record")).alias("complete"))


@query("configuration_evidence", f"""SELECT event_id, CASE WHEN event_id % 10 = 9 THEN 'unknown provider' ELSE array_to_string(list_filter([CASE WHEN event_id % 10 = 1 AND k < 50 THEN 'reported_model_matches_intended' END, CASE WHEN event_id % 10 = 2 THEN 'sampling_matches' END, CASE WHEN event_id % 10 = 3 THEN 'completion_ceiling_matches' END,
CASE WHEN event_id % 10 = 4 AND k < 50 THEN 'pending_low_reasoning_genuinely_evidenced' END], lambda x: x IS NOT NULL), ',') END AS failed FROM (SELECT event_id, {K} AS k FROM events)""")
def configuration_evidence(spark, sf_dir):
    """k < 50 answered, the others timed out; the last digit of the id says what is off."""
    e = spread(table(spark, sf_dir, "events"), "event_id").select("event_id", (F.col("event_id") % 10).cast("int").alias("d"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    docs = F.when(F.col("d") == 4, "pending_smoke").otherwise("documented")
    doc = F.format_string(
        '{"provider_model":"m","terminal_outcome":%s,"http_status":%s,"model_identity":{"requested":"m","reported":%s,"matches":true},"request":{"body":{"model":"m","stream":true,"response_format":{"type":"json_object"},"temperature":%s,"top_p":1,"presence_penalty":0,"frequency_penalty":0,"max_tokens":%s,"reasoning_effort":"low"}},"adapter_metadata":{"model_key":"m","protocol":"openai-chat-completions","endpoint_class":"serverless_or_shared","streaming":true,"structured_output_mode":"json_object","schema_enforcement":"local_strict","max_attempts":1,"reasoning_effort":"low","reasoning_wire_mapping":{"reasoning_effort":"low"},"reasoning_docs_status":"%s"}}',
        F.when(F.col("k") < 50, '"completed"').otherwise('"timeout"'), F.when(F.col("k") < 50, "200").otherwise("null"), F.when(F.col("d") == 1, '"other"').otherwise('"m"'), F.when(F.col("d") == 2, "0.5").otherwise("0"), F.when(F.col("d") == 3, "255").otherwise("256"), docs,
    )
    # parsed in a column of its own, as the checks read it many times
    saved = e.select("event_id", "d", F.parse_json(doc).alias("record"))
    return saved.select("event_id", F.array_join(records.configuration_checks(F.col("record"), F.when(F.col("d") != 9, "m")), ",").alias("failed"))


@query("stream_line_classes", "SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN CASE WHEN coalesce(text, '') = '' THEN 'empty_delta' WHEN role = 'assistant' THEN 'answer' ELSE 'reasoning' END WHEN 1 THEN 'role' WHEN 2 THEN 'finish' WHEN 3 THEN 'usage' WHEN 4 THEN 'malformed_sse' WHEN 5 THEN 'done' ELSE 'sse_comment' END AS class FROM conversations")
def stream_line_classes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    t = F.coalesce("text", F.lit(""))
    said = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(t.alias("text"))).alias("content")).alias("delta"))).alias("choices")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(t.alias("reasoning")).alias("delta"))).alias("choices"))))
    forms = [said, F.lit('{"choices":[{"delta":{"role":"assistant"}}]}'), F.lit('{"choices":[{"delta":{},"finish_reason":"stop"}]}'), F.lit('{"choices":[],"usage":{"total_tokens":3}}'), F.lit('{"choices":['), F.lit("[DONE]"), F.lit(None).cast("string")]
    return c.select("conv_id", "turn", records.line_class(F.get(F.array(*forms), (F.col("turn") % 7).cast("int"))).alias("class"))


@query("normalised_terminals", f"{FACT} SELECT seq, CASE WHEN outcome IN ('timeout', 'transport_error') THEN outcome WHEN outcome = '2xx' THEN 'completed' ELSE 'http_error' END AS terminal_outcome, CASE WHEN k % 2 = 0 THEN 'other' ELSE provider END AS provider, CASE WHEN outcome = '2xx' THEN 'said ' || k ELSE '' END AS reconstructed_answer FROM attempts")
def normalised_terminals(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumn("request_id", F.col("seq").cast("string"))
    units = a.select("request_id", F.col("round_index").cast("string").alias("round_id"), "round_index", "provider", F.lit(0).alias("provider_launch_index"), F.col("family").cast("string").alias("task_family"), F.lit("x").alias("item_id"))
    status = F.when(F.col("outcome") == "2xx", 200).when(F.col("outcome") == "429", 429).when(F.col("outcome") == "5xx", 503)
    doc = F.to_json(F.struct(status.alias("status_code"), F.when(F.col("outcome").isin("timeout", "transport_error"), F.col("outcome")).alias("terminal_outcome"), F.when(F.col("k") % 2 == 0, "other").alias("provider"), F.when(F.col("outcome") == "2xx", F.concat(F.lit("said "), F.col("k").cast("string"))).alias("response_content")))
    out = records.normalise(units, a.select("request_id", F.parse_json(doc).alias("record")))
    return out.select(F.col("request_id").cast("long").alias("seq"), "terminal_outcome", "provider", "reconstructed_answer")
