"""Saved records as VARIANT: aliases, outcomes, deltas, times, evaluations, compatibility."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pairlens.operators import records


def docs(spark, *values):
    rows = [(f"r{i}", json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "request_id string, j string").select("request_id", F.parse_json("j").alias("record"))


def each(df, column):
    return [r[0] for r in df.orderBy("request_id").select(column.alias("x")).collect()]


def R():
    return F.col("record")


def test_member_takes_the_first_present(spark):
    d = docs(spark, {"a": None, "b": 2}, {"b": 3}, {"c": 1}, {"a": "x", "b": 4}, {"a": True}, {"a": 12.0})
    assert each(d, records.kind(records.member(R(), "a", "b")))[:5] == ["VOID", "BIGINT", None, "STRING", "BOOLEAN"] and each(d, records.kind(records.member(R(), "a", "b")))[5] not in ("BIGINT", None)
    assert each(d, records.integer(records.member(R(), "a", "b"))) == [None, 3, None, None, None, None]


def test_outcomes_and_signature(spark):
    lost = {"terminal_outcome": "runner_error", "error": {"type": "AttributeError", "message": "'NoneType' object has no attribute 'read'"}, "stream_events": []}
    d = docs(spark, lost, {"status_code": 204, "terminal_status": "completed"}, {"http_status": None, "terminal_outcome": "timed_out"}, {"http_status": 404})
    assert each(d, records.record_outcome(R())) == ["transport_error", "2xx", "timeout", "other_4xx"]
    assert each(d, records.known_signature(R(), shell=True)) == [True, False, False, False]
    assert each(docs(spark, {**lost, "stream_events": [{}]}, {**lost, "reconstructed_answer": "x"}, {**lost, "http_status": 200}), records.known_signature(R(), shell=True)) == [False] * 3
    with pytest.raises(Exception, match="must be an integer"):
        each(docs(spark, {"http_status": True}), records.record_outcome(R()))


def test_deltas(spark):
    inner = {"choices": [{"delta": {"reasoning_content": "pr", "content": "pa"}}]}
    d = docs(spark, {"reasoning_content": "", "answer_content": "a", "payload": inner}, {"classification": "reasoning_delta", "content": "c"}, {"kind": "visible_answer", "content": "c", "payload": inner}, {"redacted_payload": None, "payload": inner}, {"payload": inner, "answer_content": 5}, {"payload": {"choices": []}}, {"event_type": "answer", "content": None, "payload": inner})
    thinks, says = records.delta(R())
    assert list(zip(each(d, thinks), each(d, says), strict=True)) == [("", "a"), ("c", ""), ("pr", "c"), ("", ""), ("pr", ""), ("", ""), ("pr", "pa")]


def test_payload_classes(spark):
    one = lambda delta, **more: {"choices": [{"delta": delta, **more}]}
    cases = [
        (one({"content": "a", "reasoning": "b"}), "reasoning_and_answer"), (one({"reasoning_details": [{"text": "b"}, "c", {"content": "d"}, 4]}), "reasoning"), (one({"content": [{"text": "x"}]}), "answer"), ({"usage": {"total": 1}, "choices": []}, "usage"),
        (one({}, finish_reason="stop"), "finish"), (one({"role": "assistant"}), "role"), (one({"role": "assistant", "content": ""}), "empty_delta"), (one({}), "empty_delta"), ({"model": "m"}, "metadata"), ({"choices": [{"finish_reason": "length"}]}, "finish"),
    ]
    assert each(docs(spark, *[c for c, _ in cases]), records.payload_class(R())) == [w for _, w in cases]
    d = docs(spark, one({"reasoning_content": "", "reasoning": [], "reasoning_details": [{"text": "x"}, {"content": "y"}, "z", 3]}))
    assert each(d, records.reasoning_text(F.try_variant_get(R(), "$.choices[0].delta", "variant"))) == ["xyz"]
    lines = spark.createDataFrame([(0, None), (1, "[DONE]"), (2, "{nope"), (3, '{"usage":{}}')], "request_id int, d string")
    assert each(lines, records.line_class(F.col("d"))) == ["sse_comment", "done", "malformed_sse", "usage"]


def test_times_from_events_and_without(spark):
    count = lambda c: F.size(F.split(c, " "))
    events = [{"offset_ms": 30, "answer_content": " b c"}, {"elapsed_ms": 10, "reasoning_content": "hm well"}, {"monotonic_offset_ms": 20, "classification": "answer", "content": "a"}, {"offset_ms": 25, "reasoning_content": "late"}]
    full = {"http_status": 200, "stream_events": events, "reconstructed_answer": "a b c", "reconstructed_reasoning": "hm welllate"}
    saved = {"http_status": 200, "answer": "x y", "timings": {"ttfa_ms": 100, "e2e_latency_ms": 600, "ttfo_ms": None}, "ttfo_ms": 7}
    failed = {"terminal_outcome": "timeout", "stream_events": events[1:3]}
    nothing = {"terminal_outcome": "transport_error"}
    got = {r.request_id: r for r in records.record_timing(docs(spark, full, saved, failed, nothing), count).collect()}
    a, b, c, d = (got[f"r{i}"] for i in range(4))
    assert (a.source, a.ttfo_ms, a.ttfa_ms, a.e2e_ms, a.pre_answer_reasoning_tokens, a.reasoning_emitted, a.answer_tokens, a.complete) == ("stream_events", 10, 20, 30, 2, True, 3, True) and a.speed == pytest.approx(200)
    assert (b.source, b.ttfo_ms, b.ttfa_ms, b.e2e_ms, b.last_ms, b.answer_tokens, b.pre_answer_reasoning_tokens, b.reasoning_emitted) == ("persisted_timings", 100, 100, 600, 600, 2, 0, False) and b.speed == pytest.approx(2)
    assert (c.ttfa_ms, c.ttfo_ms, c.e2e_ms, c.speed, c.complete) == (20, 10, None, None, False)
    assert [d[x] for x in ("ttfo_ms", "ttfa_ms", "e2e_ms", "speed", "reasoning_emitted", "pre_answer_reasoning_tokens")] == [None] * 6 and d.complete is False
    for bad, why in (({**full, "reconstructed_answer": "a"}, "do not give the saved reconstructed_answer"), ({"http_status": 200, "stream_events": [{"answer": 1}]}, "without an offset"), ({"http_status": 200, "ttfa_ms": -1}, "finite non-negative")):
        with pytest.raises(Exception, match=why):
            records.record_timing(docs(spark, bad), count).collect()


def test_evaluate_records(spark):
    families = ("lookup", "triage", "terms")
    gold = {"agreement_type": "saas_subscription", "effective_date": "2024-01-05", "initial_term_end_date": "2025-01-05", "auto_renews": True, "renewal_term_months": 12, "non_renewal_notice_days": None, "payment_terms_days": 30, "termination_for_convenience": False, "termination_notice_days": 60, "security_incident_notice_hours": 72}
    items = spark.createDataFrame([("a", "lookup", '{"type":"x","value":"Straße 5"}', ["road"]), ("b", "triage", '{"category":"bug","priority":"p0"}', None), ("c", "terms", json.dumps(gold), None)], "item_id string, family string, gold string, aliases array<string>")
    rec = lambda family, **more: {"provider": "p", "task_family": family, "http_status": 200, **more}
    cases = [
        ("a", rec("lookup", answer='{"answer":" STRASSE\\t5 "}'), ("valid_result", None, True)), ("a", rec("lookup", response={"body": {"choices": [{"message": {"content": '{"answer":"Road"}'}}]}}), ("valid_result", None, True)), ("a", rec("lookup", answer='{"answer":5}'), ("invalid_result", "schema_invalid", False)),
        ("a", rec("lookup", answer=None), ("invalid_result", "malformed_json", False)), ("b", rec("triage", answer='{"category":"bug","priority":"p1"}'), ("incorrect_result", None, False)), ("b", rec("triage", answer='{"category":["bug"],"priority":"p0"}'), ("invalid_result", "schema_invalid", False)),
        ("c", rec("terms", answer=json.dumps({**gold, "renewal_term_months": 12.0})), ("invalid_result", "schema_invalid", False)), ("c", rec("terms", answer=json.dumps(gold)), ("valid_result", None, True)), ("c", rec("terms", http_status=429), ("failed_request", "rate_limited_http_429", False)), ("b", rec("triage", http_status=None, terminal_outcome="timeout"), ("failed_request", "timeout", False)),
    ]
    d = docs(spark, *[r for _, r, _ in cases])
    named = d.join(spark.createDataFrame([(f"r{i}", c[0]) for i, c in enumerate(cases)], "request_id string, item_id string"), "request_id")
    got = {r.request_id: r for r in records.evaluate_records(items, named, families).collect()}
    assert [(got[f"r{i}"].classification, got[f"r{i}"].error_type, bool(got[f"r{i}"].correct)) for i in range(len(cases))] == [c[2] for c in cases]
    assert (got["r6"].correct_field_count, got["r7"].correct_field_count) == (10, 10)
    for bad, why in ((rec("triage", answer=""), "family"), ({**rec("lookup"), "provider": ""}, "provider")):
        with pytest.raises(Exception, match=f"wrong or missing {why}"):
            records.evaluate_records(items, docs(spark, bad).withColumn("item_id", F.lit("a")), families).collect()


def test_aliases(spark):
    assert each(docs(spark, ["a", 1, "b"], "one", {"answer": ["c"]}, {"answer": "d"}, {"other": 1}, 5), records.aliases_of(R())) == [["a", "b"], ["one"], ["c"], ["d"], [], []]


def test_compatibility(spark):
    d = docs(spark, {}, {"configuration_compatible": None, "provider_configuration_compatible": True}, {"provider_configuration_compatible": True, "model_identity": {"matches": False}}, {"model_identity": {"matches": None}}, {"model_identity": {}}, {"adapter_compatibility": {"status": "unsupported"}}, {"configuration_checks": {"a": True, "b": 1}}, {"configuration_checks": {"a": True}})
    assert each(d, records.record_compatible(R())) == [True, False, True, False, True, False, False, True]
    assert each(docs(spark, {}, {"local_artifact_graph_complete": False, "artifact_complete": True}, {"artifact_complete": True}), records.artifact_complete(R())) == [True, False, True]
    flags = docs(spark, True, {"compatible": False}, {"complete": True}, {}, "1")
    assert each(flags, records.provider_flag(R(), "compatible", True)) == [True, False, True, True, False]
    body = {"model": "m", "stream": True, "response_format": {"type": "json_object"}, "temperature": 0, "top_p": 1.0, "presence_penalty": 0, "frequency_penalty": 0, "max_tokens": 256, "reasoning_effort": "low"}
    meta = {"model_key": "m", "protocol": "openai-chat-completions", "endpoint_class": "serverless_or_shared", "streaming": True, "structured_output_mode": "json_object", "schema_enforcement": "local_strict", "max_attempts": 1, "reasoning_effort": "low", "reasoning_wire_mapping": {"reasoning_effort": "low"}, "reasoning_docs_status": "documented"}
    good = {"provider_model": "m", "terminal_outcome": "completed", "http_status": 200, "request": {"body": body}, "adapter_metadata": meta, "model_identity": {"requested": "m", "reported": "m", "matches": True}}
    late = {**good, "adapter_metadata": {**meta, "reasoning_docs_status": "pending_smoke"}}
    odd = {**good, "request": {"body": {**body, "temperature": False, "max_tokens": 255, "response_format": {"type": "json_object", "x": 1}}}, "model_identity": {"requested": "m", "reported": None, "matches": None}}
    shown = {**late, "adapter_compatibility": {"status": "smoke_validated", "exact_low_reasoning_evidenced": True}}
    checks = each(docs(spark, good, late, odd, shown, {**odd, "terminal_outcome": "timeout", "http_status": None}, {}), records.configuration_checks(R(), F.lit("m")))
    assert checks[:5] == [[], ["pending_low_reasoning_genuinely_evidenced"], ["reported_model_matches_intended", "structured_output_matches", "sampling_matches", "completion_ceiling_matches"], [], ["structured_output_matches", "sampling_matches", "completion_ceiling_matches"]]
    assert len(checks[5]) == 12 and each(docs(spark, good), records.configuration_checks(R(), F.lit(None).cast("string"))) == [["unknown provider"]]
    evidence = each(docs(spark, {"http_status": 200, "answer": " x "}, {"http_status": 200, "answer": "  "}, {"http_status": 500}), records.compatibility_evidence(R(), F.lit(True)))
    assert [tuple(e) for e in evidence] == [(True, True, True, True, True), (True, True, False, True, False), (True, False, False, True, False)]


def test_channel_errors(spark):
    ok = {"reasoning_content": "a", "answer_content": "", "classification": "reasoning", "content_presence": {"reasoning": True, "answer": False}}
    payload = lambda **delta: {"payload": {"choices": [{"delta": delta}]}}
    cases = [
        (ok, None), ({**ok, "content_presence": None}, "missing content_presence"), ({**ok, "content_presence": {"reasoning": True}}, "content_presence does not match distinct channel fields"), ({**ok, "classification": "answer"}, "content-bearing event is misclassified"),
        ({"classification": "reasoning_and_answer", "content_presence": {"reasoning": False, "answer": False}}, "combined event does not preserve both explicit channels"), ({**ok, **payload(reasoning="", reasoning_details=[{"text": "a"}])}, None), ({**ok, **payload(content="a")}, "payload channels were conflated or dropped"),
        ({**ok, **payload(reasoning_content="a", content="b")}, "payload channels were conflated or dropped"),
    ]
    assert each(docs(spark, *[c for c, _ in cases]), records.event_channel_error(R())) == [w for _, w in cases]


def test_normalise(spark):
    units = spark.createDataFrame([(f"r{i}", f"d{i}", i, "p", 1, "f", "x") for i in range(3)], "request_id string, round_id string, round_index long, provider string, provider_launch_index int, task_family string, item_id string")
    got = {r.request_id: r for r in records.normalise(units, docs(spark, {"http_status": 200, "provider": "q", "answer": "yes"}, {"status_code": 500, "round_index": 9}, {})).collect()}
    assert [(got[k].terminal_outcome, got[k].provider, got[k].round_index, got[k].reconstructed_answer, got[k].stream_events) for k in ("r0", "r1", "r2")] == [("completed", "q", 0, "yes", []), ("http_error", "p", 9, "", []), ("transport_error", "p", 2, "", [])]
    d = spark.createDataFrame([("documented", 200, True, True), ("pending_smoke", 200, True, True), ("documented", 200, True, False), ("pending_smoke", 404, True, None), ("documented", 404, True, None)], "a string, s int, l boolean, m boolean")
    assert [r[0] for r in d.select(records.adapter_status(*[F.col(c) for c in "aslm"])).collect()] == ["documented", "smoke_validated", "incompatible", "unsupported", "request_failed"]
    assert [r[0] for r in d.select(records.failure_label(F.col("s"), F.lit("completed"))).collect()] == [None, None, None, "other_http_4xx", "other_http_4xx"]
    assert spark.range(1).select(records.model_matches(F.lit("a"), F.lit("")), records.model_matches(F.lit("a"), F.lit("b"))).first() == (None, False)


def test_checks_hold_whatever_is_selected(spark):
    """Faults raise with only the times selected, counted, or none selected at all."""
    count = lambda c: F.length(c)
    events = [{"offset_ms": 9, "answer_content": "ab"}]
    cases = [
        ({"http_status": 200, "stream_events": events, "reconstructed_answer": "other"}, "do not give the saved reconstructed_answer"), ({"http_status": 200, "stream_events": events, "reconstructed_reasoning": "x"}, "do not give the saved reconstructed_reasoning"),
        ({"http_status": 200, "answer": "ab", "visible_answer_token_count": -3}, "non-negative integer"), ({"http_status": 200, "answer": "ab", "timings": {"pre_answer_reasoning_tokens": -1}}, "non-negative integer"), ({"http_status": 200, "answer": "ab", "pre_answer_reasoning_tokens": 1.5}, "non-negative integer"),
        ({"http_status": 200, "stream_events": ["x"]}, "must contain objects"), ({"http_status": 200, "stream_events": [{"offset_ms": "1"}]}, "finite non-negative"), ({"http_status": 700}, "no outcome for status"), ({"http_status": 200, "stream_events": [*events, {"answer_content": "c"}]}, "without an offset"),
    ]
    for bad, why in cases:
        for use in (lambda d: d.select("e2e_ms", "speed").collect(), lambda d: d.count(), lambda d: d.select(F.lit(1)).collect()):
            with pytest.raises(Exception, match=why):
                use(records.record_timing(docs(spark, bad), count))


def test_null_counts_stand_before_saved_times(spark):
    full = {"http_status": 200, "answer": "abc", "ttfa_ms": 1, "visible_answer_token_count": None, "pre_answer_reasoning_tokens": None, "reconstructed_reasoning": "hmmm", "timings": {"visible_answer_token_count": 9, "pre_answer_reasoning_tokens": 7}}
    own = {"http_status": 200, "answer": "abc", "ttfa_ms": 1, "timings": {"visible_answer_token_count": 9, "pre_answer_reasoning_tokens": 7, "ttfa_ms": None}}
    got = {r.request_id: r for r in records.record_timing(docs(spark, full, own), F.length).collect()}
    assert (got["r0"].answer_tokens, got["r0"].pre_answer_reasoning_tokens, got["r0"].ttfa_ms) == (3, 4, 1)
    assert (got["r1"].answer_tokens, got["r1"].pre_answer_reasoning_tokens, got["r1"].ttfa_ms, got["r1"].reasoning_emitted) == (9, 7, None, None)


def test_record_facts(spark):
    from pyspark.sql import Observation

    families = ("lookup", "triage", "terms")
    items = spark.createDataFrame([("a", "lookup", '"Ada"', None), ("b", "triage", '{"category":"bug","priority":"p0"}', None), ("z", "other", "{}", None)], "item_id string, family string, gold string, aliases array<string>")
    prices = spark.createDataFrame([("p", 2.0, 4.0)], "provider string, price_in double, price_out double")
    rec = lambda item, family, **more: {"provider": "p", "round_id": "d0", "item_id": item, "task_family": family, **more}
    rows = [
        rec("a", "lookup", http_status=200, stream_events=[{"offset_ms": 5, "reasoning_content": "hm"}, {"offset_ms": 8, "answer_content": '{"answer":'}, {"offset_ms": 8, "answer_content": '"ada"}'}], reconstructed_answer='{"answer":"ada"}', usage={"input_tokens": 10, "output_tokens": 5}),
        rec("b", "triage", http_status=200, answer='{"category":"bug"}', usage={"input_tokens": None, "prompt_tokens": 3, "output_tokens": 1}, cost_usd=0.5), rec("b", "triage", http_status=429, usage={"prompt_tokens": 3, "completion_tokens": 1}, cost_usd=None), rec("b", "triage", terminal_outcome="timeout", usage={"prompt_tokens": True, "completion_tokens": 1}, configuration_compatible=False),
    ]
    seen = Observation("records")
    got = {r.request_id: r for r in records.record_facts(docs(spark, *rows), items, prices, families, F.length, seen).collect()}
    assert [(got[f"r{i}"].tokens_in, got[f"r{i}"].tokens_out, got[f"r{i}"].cost_usd) for i in range(4)] == [(10, 5, 4e-05), (None, None, 0.5), (3, 1, None), (None, None, None)]
    a = got["r0"]
    assert (a.answer, a.ttfo_ms, a.ttfa_ms, a.e2e_ms, a.pre_answer_reasoning_tokens, a.classification, a.correct, a.speed, a.compatible) == ('{"answer":"ada"}', 5, 8, 8, 2, "valid_result", True, None, True)
    assert [got[f"r{i}"].error_type for i in range(4)] == [None, "missing_required_field", "rate_limited_http_429", "timeout"] and got["r3"].compatible is False and got["r1"].invalid is True
    assert seen.get == {"records": 4, "failed": 2, "normalised_failures": 0, "saved_times": 3, "without_usage": 2, "without_cost": 2}
    for bad, costs, why in ((rec("a", "lookup", http_status=200, cost_usd=-1), prices, "cost_usd is not"), (rows[0], prices.withColumn("price_in", F.lit(0.0)), "no price of p"), (rec("a", "triage", http_status=200), prices, "wrong or missing family")):
        with pytest.raises(Exception, match=why):
            records.record_facts(docs(spark, bad), items, costs, families, F.length).select("outcome").collect()


def test_record_facts_neither_explode_nor_shuffle_records(spark):
    items = spark.createDataFrame([("a", "lookup", '"Ada"', None)], "item_id string, family string, gold string, aliases array<string>")
    prices = spark.createDataFrame([("p", 2.0, 4.0)], "provider string, price_in double, price_out double")
    plan = records.record_facts(docs(spark, {"provider": "p"}), items, prices, ("lookup", "triage", "terms"), F.length)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Join") == 2
