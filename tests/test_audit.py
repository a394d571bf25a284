"""Hash-block audits, what a record says of itself, and conditions that can fail."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pairlens.operators import audit, metrics, paired, records, runs

FAMILIES = ("lookup", "triage", "terms")


def counted(spark, df):
    """df, and an accumulator of the rows that are read from it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, n long, x double, a array<string>")


def base(n=200):
    return [(f"k{i}", i, i / 3, None if i % 5 == 0 else [str(i), None]) for i in range(n)]


def test_equal_sides_are_read_once(spark):
    (a, seen_a), (b, seen_b) = counted(spark, frame(spark, base())), counted(spark, frame(spark, base()[::-1]))
    found = audit.block_audit(spark, [("p", a, b, ["k"], ["n", "x", "a"])], blocks=16)
    assert found.collect() == [] and found.columns == ["part", "key", "column", "saved", "recomputed"]
    assert (seen_a.value, seen_b.value) == (200, 200)


def test_unequal_rows_are_found(spark):
    rows = base()
    rows[3] = ("k3", 4, 1.0, ["3", None])
    rows[5] = ("k5", 5, 5 / 3, [])
    rows[6] = ("k6", None, 2.0, ["6", None])
    del rows[10]
    rows += [("k20", 20, 20 / 3, None), ("new", 1, None, None), (None, None, None, None)]
    got = audit.block_audit(spark, [("p", frame(spark, rows), frame(spark, base()), ["k"], ["n", "x", "a"]), ("q", frame(spark, base(3)), frame(spark, base(3)), ["k", "n"], ["x"])], blocks=8).collect()
    assert sorted((r.part, r.key, r.column, r.saved, r.recomputed) for r in got) == [
        ("p", "", "copies", "1", "0"), ("p", "k10", "copies", "0", "1"), ("p", "k20", "copies", "2", "1"), ("p", "k3", "n", "4", "3"), ("p", "k5", "a", '{"v":[]}', "{}"), ("p", "k6", "n", None, "6"), ("p", "new", "copies", "1", "0"),
    ]


def test_values_that_change_places_or_pair_up(spark):
    """Sums in any order still see a swap of two values, a null that moves, and a row that stands twice on one side."""
    one = [("a", 1, 2.0, None), ("b", 2, 1.0, None)]
    for other in ([("a", 2, 2.0, None), ("b", 1, 1.0, None)], [*one, one[0]], [*one, ("c", 0, 0.0, None), ("c", 0, 0.0, None)], []):
        assert audit.block_audit(spark, [("p", frame(spark, one), frame(spark, other), ["k"], ["n", "x"])], blocks=1).count() > 0
    none = [("a", None, 2.0, None)], [("a", 2, None, None)]
    assert audit.block_audit(spark, [("p", *(frame(spark, n) for n in none), ["k"], ["n", "x"])]).count() == 2


TIMES = {"ttfo_ms": 5, "ttfa_ms": 8, "pre_answer_reasoning_tokens": 2, "reasoning_emitted_before_answer": True, "e2e_latency_ms": 9, "first_answer_token_ms": 8, "last_answer_token_ms": 9, "visible_answer_token_count": 16, "output_tokens_per_second": 15000}
ANSWER = '{"answer":"ada"}'


def event(at, reasoning="", answer="", **more):
    return {"offset_ms": at, "classification": "reasoning" if reasoning else "answer", "reasoning_content": reasoning, "answer_content": answer, "content_presence": {"reasoning": bool(reasoning), "answer": bool(answer)}, **more}


def record(i, **more):
    events = [event(5, "hm"), event(8, answer=ANSWER[:10]), event(9, answer=ANSWER[10:])]
    return {"provider": f"p{i % 2}", "round_id": str(i // 2), "item_id": "a", "task_family": "lookup", "http_status": 200, "terminal_outcome": "completed", "stream_events": events, "reconstructed_answer": ANSWER, "reconstructed_reasoning": "hm", "timings": TIMES, **more}


def docs(spark, values):
    return spark.createDataFrame([(f"r{i}", json.dumps(v)) for i, v in enumerate(values)], "request_id string, j string").select("request_id", F.parse_json("j").alias("record"))


@pytest.fixture(scope="module")
def world(spark):
    items = spark.createDataFrame([("a", "lookup", '"Ada"', None)], "item_id string, family string, gold string, aliases array<string>").cache()
    return items, spark.createDataFrame([(f"p{i}", 2.0, 4.0) for i in range(2)], "provider string, price_in double, price_out double").cache()


def test_what_a_record_says_of_itself(spark, world):
    events = record(0)["stream_events"]
    cases = [
        ({}, set()), ({"stream_events": []}, {("reconstruction", "stream_events")}), ({"reconstructed_answer": "x"}, {(p, "recomputation") for p in ("evaluations", "timings", "reconstruction")}), ({"terminal_outcome": "other", "http_status": 700}, {(p, "recomputation") for p in ("evaluations", "timings", "reconstruction")}),
        ({"stream_events": [{**events[0], "content_presence": None}, *events[1:]]}, {("channels", "channel")}), ({"timings": {**TIMES, "ttfo_ms": None, "visible_answer_token_count": "16"}}, {("timings", "ttfo_ms"), ("timings", "visible_answer_token_count")}),
        ({"timings": {}, **TIMES}, set()), ({"timings": {}}, {("timings", n) for n in audit.NINE}), *[({"timings": {**TIMES, n: False if v is True else v + 1}}, {("timings", n)}) for n, v in TIMES.items()],
    ]
    d = docs(spark, [record(i, **c) for i, (c, _) in enumerate(cases)])
    facts = records.record_facts(d, *world, FAMILIES, F.length, strict=False)
    got = {}
    for r in audit.record_violations(facts).collect():
        got.setdefault(r.key.split("|")[0], set()).add((r.part, r.column))
    assert [got.get(f"r{i}", set()) for i in range(len(cases))] == [w for _, w in cases]
    durable = spark.createDataFrame([("r0", "arrival_atomic")] * 3 + [("r4", "arrival_atomic"), ("r4", None), ("r4", "late")] + [(f"r{i}", "arrival_atomic") for i in range(len(cases)) if i not in (0, 1, 4, 5) for _ in range(3)], "request_id string, durability string")
    more = {(r.key, r.column) for r in audit.record_violations(facts, durable).collect()} - {(r.key, r.column) for r in audit.record_violations(facts).collect()}
    assert more == {("r4", "durability"), ("r5", "durable_events")}


def test_faults_fail_their_conditions(spark, world):
    """A clean run passes; in a faulty one each fault is found in its part, and turns that part's condition false."""
    records_of = lambda faulty: docs(spark, [record(0), record(1, timings={**TIMES, "ttfa_ms": 7}) if faulty else record(1), record(2, stream_events=[{**record(2)["stream_events"][0], "classification": "answer"}, *record(2)["stream_events"][1:]]) if faulty else record(2), record(3, stream_events=[] if faulty else record(3)["stream_events"])])
    clean = records.record_facts(records_of(False), *world, FAMILIES, F.length).cache()
    found = {}
    for faulty in (False, True):
        judged = clean.select("request_id", *records.JUDGEMENT).withColumn("correct", (F.col("request_id") != "r2") | F.lit(not faulty))
        table = metrics.family_metrics(clean).withColumn("speed_p99", F.col("speed_p99") + int(faulty))
        wins = paired.fastest_wins(clean, "e2e_ms").withColumn("tied", F.col("tied") + int(faulty))
        done = audit.audit_run(records_of(faulty), *world, FAMILIES, F.length, judged, table, {"e2e_ms": wins}, {}, blocks=4)
        assert done.parts == set(audit.PARTS)
        found[faulty] = [tuple(r) for r in done.violations.collect()]
    assert found[False] == []
    assert {(r[0], r[1], r[2]) for r in found[True]} == {
        ("evaluations", "r2", "correct"), ("timings", "r1", "ttfa_ms"), ("channels", "r2|0", "channel"), ("reconstruction", "r3", "stream_events"), ("paired", "e2e_ms|p0", "tied"), ("paired", "e2e_ms|p1", "tied"), *(("metrics", f"p{i}|lookup", "speed_p99") for i in range(2)),
    }
    units = spark.createDataFrame([(True, True)], "recorded boolean, evaluated boolean")
    flags = spark.createDataFrame([("p0", True, True)], "provider string, complete boolean, compatible boolean")
    for condition, part in runs.PARTS.items():
        rows = spark.createDataFrame([r for r in found[True] if r[0] == part], audit.VIOLATION)
        got = runs.full_success(units, flags, flags, rows, done.parts).first().asDict()
        assert got.pop("success") is False and [k for k, v in got.items() if not v] == [condition]
    for column, condition in (("complete", "artifact_graph_complete"), ("compatible", "provider_configuration_compatible")):
        bad = flags.withColumn(column, F.lit(False))
        got = runs.full_success(units, bad, bad, spark.createDataFrame([], audit.VIOLATION), audit.PARTS).first().asDict()
        assert got.pop("success") is False and [k for k, v in got.items() if not v] == [condition]


def test_costs_and_credits_do_not_depend_on_order(spark):
    """Costs whose sum is a tie of rounding, and thirds and sevenths of wins, come to the same double whatever task they are in."""
    costs = [0.1, 0.2, 0.3, 0.0000005] * 25
    fact = spark.createDataFrame([("p", "f", "2xx", True, False, 1.0, 1.0, 1, True, 1.0, 1.0, c, 1, 1, i) for i, c in enumerate(costs)], "provider string, family string, outcome string, correct boolean, invalid boolean, ttfo_ms double, ttfa_ms double, pre_answer_reasoning_tokens long, reasoning_emitted boolean, e2e_ms double, speed double, cost_usd double, tokens_in long, tokens_out long, i int")
    orders = [fact.coalesce(1).orderBy("i"), fact.coalesce(1).orderBy(F.desc("i")), fact.coalesce(1).orderBy("cost_usd"), fact.coalesce(1).orderBy(F.desc("cost_usd")), fact.repartition(7, "i")]
    assert {metrics.family_metrics(o, order_free=True).first().known_cost_usd for o in orders} == {15.000013}
    large = fact.withColumn("cost_usd", F.when(F.col("i") == 0, 1e300).otherwise(F.col("cost_usd")))
    assert metrics.family_metrics(large, order_free=True).first().known_cost_usd == 1e300
    none = fact.withColumn("cost_usd", F.lit(None).cast("double"))
    assert metrics.family_metrics(none, order_free=True).first().known_cost_usd is None
    ties = [3, 7, 1, 3, 6, 7, 9] * 40
    wins = spark.createDataFrame([(r, f"p{p}", 1.0) for r, k in enumerate(ties) for p in range(k)], "round_id int, provider string, e2e_ms double")
    got = {tuple((r.provider, r.credit, r.outright, r.tied, r.samples) for r in paired.fastest_wins(w, "e2e_ms").orderBy("provider").collect()) for w in (wins.orderBy("round_id"), wins.orderBy(F.desc("round_id")), wins.repartition(5, "round_id"))}
    assert len(got) == 1 and next(iter(got))[0] == ("p0", round(40 * (2 / 3 + 2 / 7 + 1 + 1 / 6 + 1 / 9), 9), 40, 240, 280)


def test_no_filter_makes_records_again(spark, world):
    """The join with items needs a record's item, and Spark filters by it; not below the making of the record, where that would be done twice."""
    facts = records.record_facts(docs(spark, [record(0), record(1, item_id=None)]), *world, FAMILIES, F.length, strict=False)
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert "parseJson" in plan and not [line for line in plan.split("\n") if "Filter" in line.split("(")[0] and "parseJson" in line]
    assert [r.request_id for r in facts.collect()] == ["r0"]


def test_a_part_that_was_not_looked_at_fails(spark):
    flags = spark.createDataFrame([("p", True, True)], "provider string, complete boolean, compatible boolean")
    units, nothing = spark.createDataFrame([(True, True)], "recorded boolean, evaluated boolean"), spark.createDataFrame([], audit.VIOLATION)
    assert runs.full_success(units, flags, flags, nothing, audit.PARTS).first().success is True
    for lost in audit.PARTS[:2]:
        row = runs.full_success(units, flags, flags, nothing, set(audit.PARTS) - {lost}).first()
        assert row.success is False and sum(v is False for v in row.asDict().values()) == 2
