from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pairlens.functions import jsonstrict, stats
from pairlens.operators import metrics, outcomes, paired, reconcile, schedule, timing
from pairlens.plans import load_queries
from pairlens.sources import tables
from pairlens.streaming import operators as st


def python_rank(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(p * len(v))) - 1] if v else None


@pytest.mark.parametrize("n", [1, 2, 7, 100, 200, 600])
def test_nearest_rank_matches_definition(spark, n):
    random.seed(n)
    values = [round(random.uniform(0, 1e4), 3) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = df.agg(*stats.percentiles("x", "u"), *stats.percentiles("x", "l", True)).first()
    assert [row["u_p50"], row["u_p95"], row["u_p99"]] == [python_rank(values, p) for p in (0.5, 0.95, 0.99)]
    assert [row["l_p95"], row["l_p99"]] == [python_rank(values, p) for p in (1 - 0.95, 1 - 0.99)]


def test_nearest_rank_of_one_to_hundred(spark):
    assert spark.range(1, 101).agg(stats.nearest_rank("id", "0.99D")).first()[0] == 99


@pytest.mark.parametrize(("bad", "positive"), [(float("nan"), False), (float("inf"), False), (-1.0, False), (0.0, True)])
def test_finite_raises(spark, bad, positive):
    df = spark.createDataFrame([(bad,)], "x double").select(stats.finite(F.col("x"), "x", positive).alias("x"))
    with pytest.raises(Exception, match="finite"):
        df.collect()


def test_strict_json(spark):
    cases = {' {"answer":"Ada"}\n': True, "": False, '```{"a":1}```': False, "{} {}": False, '{"x":NaN}': False, '{"a":1,"a":2}': False, "[1,true]": True, "12.0": True, "null": True}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r["t"]: r["j"]["ok"] for r in df.select("t", jsonstrict.strict_json("t").alias("j")).collect()}
    assert got == {**cases, None: False}


def test_normalize_is_casefold(spark):
    df = spark.createDataFrame([("  ADA   LOVELACE ",), ("Straße",), (None,)], "t string")
    assert [r[0] for r in df.select(jsonstrict.normalize_answer("t")).collect()] == ["ada lovelace", "strasse", None]


def test_iso_date(spark):
    cases = {"2024-02-29": True, "2023-02-29": False, "0000-01-01": False, "2024-1-01": False, "2026-W01-1": False, "0001-01-01": True}
    df = spark.createDataFrame([(k,) for k in cases], "d string")
    assert {r[0]: r[1] for r in df.select("d", jsonstrict.iso_date(F.col("d"))).collect()} == cases


def test_outcomes(spark):
    rows = [
        (200, None, False, "2xx"), (200, "completed", False, "2xx"), (429, "http_error", False, "429"), (404, "http_error", False, "other_4xx"), (503, None, False, "5xx"), (200, "timeout", False, "timeout"), (None, "timed_out", False, "timeout"),
        (None, "transport-error", False, "transport_error"), (None, "runner_error", True, "transport_error"), (None, "http_2xx", False, "2xx"), (None, "http_429", False, "429"), (None, "http_other_4xx", False, "other_4xx"), (None, "http_5xx", False, "5xx"), (None, "completed", False, "2xx"),
    ]
    df = spark.createDataFrame(rows, "s int, l string, k boolean, want string")
    got = df.select("want", outcomes.terminal_outcome(F.col("s"), F.col("l"), F.col("k")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    for status, label, why in ((301, None, "no outcome"), (None, "runner_error", "run-invalidating"), (None, "evaluator_error", "run-invalidating"), (200, "http_error", "status of success"), (None, "http_error", "without an outcome"), (None, None, "without an outcome")):
        with pytest.raises(Exception, match=why):
            spark.createDataFrame([(status, label)], "s int, l string").select(outcomes.terminal_outcome(F.col("s"), F.col("l"))).collect()


def _events(spark, rows):
    return spark.createDataFrame(rows, "request_id string, event_index long, offset_ms double, reasoning string, answer string")


def test_timing_boundaries(spark):
    e = _events(spark, [("a", 0, 115.0, "hm", None), ("a", 1, 125.0, None, "x"), ("a", 2, 225.0, None, "y"), ("b", 0, 125.0, None, "x"), ("b", 1, 225.0, None, "y"), ("c", 0, 50.0, "only", None)])
    t = {r["request_id"]: r for r in timing.completed_timing(timing.request_timing(e, F.length), F.lit(True)).collect()}
    assert (t["a"].ttfo_ms, t["a"].ttfa_ms, t["a"].e2e_ms, t["a"].reasoning_emitted) == (115, 125, 225, True)
    assert (t["b"].ttfo_ms, t["b"].ttfa_ms, t["b"].pre_answer_reasoning, t["b"].reasoning_emitted) == (125, 125, "", False)
    assert (t["c"].ttfo_ms, t["c"].ttfa_ms, t["c"].e2e_ms, t["c"].reasoning_emitted) == (None, None, None, None)
    assert t["a"].speed == pytest.approx(10.0)


def test_pooled_rank_and_failure_denominator(spark):
    rows = []
    for p, base in (("fast", 100.0), ("slow", 200.0)):
        for f in range(3):
            rows.append((p, f, "2xx", True, False, base + f, base + f, 5.0, 0.1, 1, 1))
    rows += [("bad", f, "429" if f == 1 else "2xx", f != 1, False, None if f == 1 else 1.0, None if f == 1 else 1.0, None, None, None, None) for f in range(3)]
    fact = spark.createDataFrame(rows, "provider string, family int, outcome string, correct boolean, invalid boolean, ttfa_ms double, e2e_ms double, speed double, cost_usd double, tokens_in long, tokens_out long")
    fact = fact.withColumns({"ttfo_ms": F.col("ttfa_ms") / 2, "pre_answer_reasoning_tokens": F.when(F.col("ttfa_ms").isNotNull(), F.col("family").cast("long")), "reasoning_emitted": F.col("ttfa_ms").isNotNull() & (F.col("family") > 0)})
    got = {r["provider"]: r for r in metrics.ranked(metrics.combined_metrics(fact, [0, 1, 2])).collect()}
    assert (got["fast"].reasoning_emission_rate, got["bad"].reasoning_emission_rate, got["bad"].http_429_count, got["bad"].incorrect_count, got["fast"].pre_answer_reasoning_tokens_p99) == (2 / 3, 0.5, 1, 0, 2)
    assert got["fast"].missing_families == [] and not metrics.combined_metrics(fact, [0, 1, 2, 3]).where("provider = 'fast'").first().balanced
    with pytest.raises(Exception, match="e2e_ms is not a finite"):
        metrics.family_metrics(fact.withColumn("e2e_ms", F.lit(-1.0))).collect()
    assert (got["fast"].ttfa_ms_p99, got["slow"].e2e_ms_p99) == (102, 202)
    assert (got["fast"]["rank"], got["slow"]["rank"], got["bad"]["rank"]) == (1, 2, None)
    assert got["bad"].success_rate == pytest.approx(2 / 3) and got["bad"].failure_rate == pytest.approx(1 / 3) and got["bad"].e2e_ms_population == 2
    assert got["bad"].total_cost_usd is None


def test_paired_ties_and_coverage(spark):
    rows = [(1, "a", 100.0), (1, "b", 120.0), (2, "a", 100.0), (2, "b", 100.0), (3, "a", 90.0), (3, "b", None)]
    fact = spark.createDataFrame(rows, "round_id int, provider string, e2e_ms double")
    wins = {r["provider"]: r["credit"] for r in paired.fastest_wins(fact, "e2e_ms").collect()}
    assert wins == {"a": 2.5, "b": 0.5}
    p = paired.pairwise(fact, "e2e_ms").first()
    assert (p.paired_count, p.missing_pair_count, p.difference_p50) == (2, 1, -20.0) and p.coverage_rate == pytest.approx(2 / 3)
    eligible = paired.paired_eligibility(fact, F.col("provider") != "b", F.lit(True))
    q = paired.pairwise(fact, "e2e_ms", eligible).first()
    assert (q.paired_count, q.missing_pair_count, q.coverage_rate, q.eligible_comparison, q.exclusion_reasons) == (0, 3, 0.0, False, ["b: " + paired.INCOMPATIBLE])
    assert {r["provider"]: r["win_rate"] for r in paired.fastest_wins(fact, "e2e_ms", eligible).collect()} == {"a": 1.0, "b": None}


def test_paired_coverage_counts_all_rounds(spark):
    """a in rounds 1 and 2, b in round 1 only: b is incomplete, and coverage is 1 of 2."""
    fact = spark.createDataFrame([(1, "a", 10.0), (2, "a", 20.0), (1, "b", 15.0)], "round_id long, provider string, e2e_ms double")
    p = paired.pairwise(fact, "e2e_ms").first()
    assert (p.paired_count, p.total_round_count, p.missing_pair_count, p.coverage_rate) == (1, 2, 1, 0.5)
    e = {r.provider: r for r in paired.paired_eligibility(fact, F.lit(None).cast("boolean")).collect()}
    assert e["a"].eligible and (e["b"].compatible, e["b"].complete, e["b"].exclusion_reasons) == (True, False, [paired.INCOMPLETE])
    flags = spark.createDataFrame([("a", None, True)], "provider string, compatible boolean, complete boolean")
    assert paired.paired_eligibility(fact, flags=flags).where("provider = 'a'").first().exclusion_reasons == [paired.INCOMPATIBLE]
    wins = {r.provider: (r.credit, r.samples, r.missing, r.win_rate) for r in paired.fastest_wins(fact, "e2e_ms", paired.paired_eligibility(fact)).collect()}
    assert wins == {"a": (2.0, 2, 0, 1.0), "b": (0.0, 0, 2, None)}
    with pytest.raises(Exception, match="twice in round 1"):
        paired.pairwise(fact.union(fact), "e2e_ms").collect()


def test_immutable_upsert(spark):
    old = spark.createDataFrame([(1, "x")], "k int, v string")
    same = reconcile.immutable_upsert(old, spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), "k", F.col("v"))
    assert [tuple(r) for r in same.collect()] == [(2, "y")]
    with pytest.raises(Exception, match="changed content"):
        reconcile.immutable_upsert(old, spark.createDataFrame([(1, "z")], "k int, v string"), "k", F.col("v")).collect()


def test_one_to_one_raises(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="one side"):
        reconcile.one_to_one(a, b, "k").collect()


def test_contract_bool_for_int(spark):
    gold = '{"agreement_type":"saas_subscription","effective_date":"2024-01-05","initial_term_end_date":"2025-01-05","auto_renews":true,"renewal_term_months":12,"non_renewal_notice_days":null,"payment_terms_days":30,"termination_for_convenience":false,"termination_notice_days":60,"security_incident_notice_hours":72}'
    rows = [(gold.replace("12", "true"), gold), (gold, gold), (gold.replace("12", "12.0"), gold), ("[]", gold)]
    got = outcomes.evaluate_contract(spark.createDataFrame(rows, "a string, g string"), "a", "g").collect()
    assert [(r.correct_field_count, r.schema_valid, r.correct) for r in got] == [(9, False, False), (10, True, True), (10, False, False), (0, False, False)]


def test_budget_fold(spark):
    ledger = spark.createDataFrame([("a", 1, 0.3), ("a", 2, 0.3), ("a", 3, 0.2)], "att string, o long, x double")
    got = schedule.running_budget(ledger, "o", "x", "att", 0.5).orderBy("o").collect()
    assert [r.accepted for r in got] == [True, False, True] and got[-1].running == pytest.approx(0.5)


def test_launch_budget_folds_all_attempts(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.provider, r.order): (r.running, r.accepted) for r in load_queries()[0]["launch_budget"](spark, sf).collect()}
    want, totals = {}, {}
    for r in tables.attempts(spark, sf).select("provider", "seq", "k").orderBy("seq").collect():
        t = totals.get(r.provider, 0.0)
        fits = t + r.k / 100.0 <= 5.0
        totals[r.provider] = t + r.k / 100.0 if fits else t
        want[r.provider, r.seq] = (totals[r.provider], fits)
    assert got == want


def test_lookup_eval_asks_for_whole_texts(spark, monkeypatch):
    asked, evaluate = [], outcomes.evaluate_lookup
    monkeypatch.setattr(outcomes, "evaluate_lookup", lambda df, *a: asked.append(df) or evaluate(df, *a))
    load_queries()[0]["lookup_eval"](spark, "/root/testdata/sf0.001")
    texts = tables.table(spark, "/root/testdata/sf0.001", "benchmark").select("text")
    assert sorted(r[0] for r in asked[0].select(F.col("accepted")[0]).collect()) == sorted(r.text for r in texts.collect())


def test_rotation_and_selection(spark):
    got = spark.range(3).select(schedule.launch_index(F.col("id"), F.lit(1), 3)).collect()
    assert [r[0] for r in got] == [2, 0, 1]
    items = spark.createDataFrame([("f", f"i{k:02}") for k in range(20)], "family string, item_id string")
    material = b"s\0r\0f\0micro-single-task-paired-round-robin-sha256-v1"
    assert hashlib.sha256(material).hexdigest() == f"{schedule.selection_seed('s', 'r', 'f'):064x}"
    want = [f"i{k:02}" for k in range(20)]
    random.Random(int(hashlib.sha256(material).hexdigest(), 16)).shuffle(want)
    assert [r.item_id for r in schedule.shuffled_order(items, "s", "r").orderBy("order_index").collect()] == want


def test_schedule_of_600_rounds(spark):
    families, providers = ["x", "y", "z"], [f"p{i}" for i in range(10)]
    selection = spark.range(600).selectExpr("element_at(array('x', 'y', 'z'), int(id % 3) + 1) AS family", "concat('item', id) AS item_id", "int(id / 3) AS order_index")
    units = schedule.build_schedule(selection, families, providers, 200).collect()
    assert len(units) == 6000 and len({u.request_id for u in units}) == 6000 and len({u.round_id for u in units}) == 600
    assert {u.round_index for u in units} == set(range(600))
    for r in (0, 1, 13):
        mine = sorted((u.launch_index, u.provider) for u in units if u.round_index == r)
        assert [p for _, p in mine] == providers[r % 10 :] + providers[: r % 10]
    u = next(u for u in units if u.round_index == 7 and u.provider == "p3")
    version = "micro-single-task-paired-round-robin-sha256-v1"
    name = lambda kind, *parts: f"{kind}-" + hashlib.sha256("\0".join(map(str, parts)).encode()).hexdigest()[:24]
    assert u.round_id == name("round", version, 7, u.family, u.item_id, 0) and u.request_id == name("req", version, "p3", 7, u.family, u.item_id, 0)
    again = schedule.build_schedule(selection, families, providers, 1, attempt=2)
    assert again.where("round_index = 0").first().round_id == name("round", version, 0, "x", "item0", 2)
    with pytest.raises(Exception, match="too few items"):
        schedule.build_schedule(selection, families, providers, 201).collect()


def test_sse_frames(spark):
    lines = [": ping", "data: a", "data:b", "", "data: [DONE]"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "request_id string, line_no long, line string")
    got = st.frames(df).orderBy("frame").collect()
    assert [(r.data, r.comments, r.done) for r in got] == [("a\nb", 1, False), ("[DONE]", 0, True)]


def test_sources(spark, tmp_path):
    assert tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), tables.EVENT_SCHEMA).count() == 0
    (tmp_path / "a.jsonl").write_text('{"request_id":"r","event_index":1}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), tables.EVENT_SCHEMA).first().event_index == 1
    (tmp_path / "t.txt").write_text("hello\n\n")
    assert tables.read_template(spark, str(tmp_path / "t.txt")).first().value == "hello\n"
    (tmp_path / ".hidden").write_text("x")
    names = {r.path.rsplit("/", 1)[1] for r in tables.inventory(spark, str(tmp_path)).collect()}
    assert names == {"a.jsonl", "t.txt"}
    assert len(tables.release_hash(tables.inventory(spark, str(tmp_path))).first()[0]) == 64


def test_redact(spark):
    df = spark.createDataFrame([('{"a":{"Authorization":"Bearer z"},"n":["tell s3cret"]}',), ("no json s3cret",)], "t string")
    assert [r[0] for r in df.select(jsonstrict.redact(["s3cret"])(F.col("t"))).collect()] == ['{"a":{"Authorization":"[REDACTED]"},"n":["tell [REDACTED]"]}', "no json [REDACTED]"]


def test_artifacts(spark, tmp_path):
    from pairlens.sources import artifacts

    artifacts.write_document(str(tmp_path / "d.json"), {"b": 1, "a": [True, None]})
    assert (tmp_path / "d.json").read_text() == '{"a":[true,null],"b":1}\n' and artifacts.read_document(str(tmp_path / "none.json"), 3) == 3
    for kind in ("begin", "end"):
        artifacts.log_event(spark, str(tmp_path / "log"), kind, attempt="1")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    new = spark.createDataFrame([("r1", "x"), ("r2", "y")], "request_id string, answer string")
    artifacts.append_terminal(new.limit(0), new, str(tmp_path / "records"), "full")
    saved = spark.read.parquet(str(tmp_path / "records"))
    assert saved.count() == 2 and len(saved.first().record_hash) == 64 and saved.first().attempt == "full"


def test_report(spark):
    from pairlens.operators import report

    fact = spark.createDataFrame([(r, p, r % 3, "2xx", True, False, 10.0 * k + r, 20.0 * k + r, 5.0, 0.1, 1, 1) for r in range(6) for k, p in enumerate("ab", 1)], "round_id int, provider string, family int, outcome string, correct boolean, invalid boolean, ttfa_ms double, e2e_ms double, speed double, cost_usd double, tokens_in long, tokens_out long").withColumns({"ttfo_ms": F.col("ttfa_ms"), "pre_answer_reasoning_tokens": F.lit(0), "reasoning_emitted": F.lit(False)})
    ranked = metrics.ranked(metrics.combined_metrics(fact, [0, 1, 2]))
    text = report.report("Run", ranked, paired.fastest_wins(fact, "e2e_ms"), paired.pairwise(fact, "e2e_ms"))
    assert text.index("| a | 1 | yes |") < text.index("| b | 2 | yes |") and "-20.00" in text
    assert report.acceptance(fact, 12, fact.limit(0)).first().accepted
    assert not report.acceptance(fact, 13, fact.limit(0)).first().accepted
    spec = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "provider string, cap int")
    assert {r.provider: r.problem for r in report.drift(spec, spec.where("provider <> 'c'").withColumn("cap", F.when(F.col("provider") == "a", 9).otherwise(F.col("cap"))), ["cap"]).collect()} == {"a": "cap", "c": "no adapter"}
