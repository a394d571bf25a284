"""The outputs of an attempt: order, members, durable and embedded events, failures, re-runs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pairlens.sources import artifacts


def frames(spark, records, evaluations=(), events=(), rounds=(), order=None):
    docs = lambda rows, name: spark.createDataFrame([(r["request_id"], json.dumps(r)) for r in rows], "request_id string, d string").select("request_id", F.parse_json("d").alias(name))
    ids = [r["request_id"] for r in records] if order is None else order
    durable = spark.createDataFrame([(e["request_id"], e["event_index"], json.dumps(e)) for e in events], "request_id string, event_index long, d string").select("request_id", "event_index", F.parse_json("d").alias("event"))
    plan = spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "request_id string, seq long")
    return artifacts.attempt_views(plan, docs(records, "record"), docs(evaluations, "evaluation"), durable, spark.createDataFrame(list(rounds), "round_id string, launch_skew_ms double"))


def lines(views, output):
    rows = sorted((r.seq, r.place, r.line) for r in views.where(F.col("output") == output).collect())
    return [json.loads(r[2]) for r in rows]


def durable(i, at, **more):
    return {"request_id": i, "event_index": at, "durability": "arrival_atomic", **more}


def test_members_and_order(spark):
    records = [
        {"request_id": "b", "round_id": "r1", "terminal_outcome": "completed", "z": {"y": 1, "x": [None, {"b": 1, "a": "é"}]}, "request": {"body": 1, "provider": "over"}, "provider": "p", "stream_events": [{"t": 1}, "odd", {"event_index": 9, "request_id": "lie"}], "answer": "yes", "reconstructed_reasoning": None},
        {"request_id": "a", "round_id": "r2", "terminal_outcome": "timeout", "launch_skew_ms": 3, "stream_events": None, "request": [1]},
        {"request_id": "unplanned", "terminal_outcome": "completed"},
        {"request_id": "c"},
    ]
    views = frames(spark, records, [{"request_id": "c", "ok": False}, {"request_id": "b"}], rounds=[("r1", 2.5), ("r3", 1.0)], order=["c", "b", "missing", "a"])
    results = lines(views, "results")
    assert [r["request_id"] for r in results] == ["c", "b", "a"]
    assert results[1] == {**records[0], "launch_skew_ms": 2.5} and results[2] == records[1]
    assert views.where("output = 'results' and seq = 1").first().line == json.dumps(results[1], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    none = dict.fromkeys(artifacts.REQUEST_KEYS)
    assert lines(views, "requests") == [{**none, "request_id": "c"}, {**none, "request_id": "b", "body": 1, "provider": "p", "round_id": "r1", "launch_skew_ms": 2.5}, {**none, "request_id": "a", "round_id": "r2", "launch_skew_ms": 3}]
    marked = {"request_id": "b", "durability": "terminal_embedded"}
    assert lines(views, "stream-events") == [{**marked, "t": 1, "event_index": 0}, {**marked, "payload": "odd", "event_index": 1}, {**marked, "event_index": 9}]
    said = lines(views, "reconstructed-responses")
    assert [(r["answer"], r["reasoning"]) for r in said] == [("", ""), ("yes", None), ("", "")] and set(said[0]) == {"request_id", "provider", "task_family", "item_id", "reasoning", "answer"}
    assert [r["request_id"] for r in lines(views, "failures")] == ["c", "a"]
    assert lines(views, "evaluations") == [{"request_id": "c", "ok": False}, {"request_id": "b"}]


def test_durable_events(spark):
    record = {"request_id": "a", "stream_events": [{"b": 1, "a": {"d": 1, "c": 2}}, "odd", {"event_index": 5}]}
    good = [durable("a", 5), durable("a", 0, a={"c": 2, "d": 1}, b=1)]
    assert lines(frames(spark, [record], events=good), "stream-events") == good[::-1]
    for bad in (good[:1], [good[0], durable("a", 0, b=2, a={"c": 2, "d": 1})], [*good, durable("a", 6)]):
        with pytest.raises(Exception, match="durable events differ from the record: a"):
            frames(spark, [record], events=bad).collect()
    shell = {"request_id": "a", "terminal_outcome": "runner_error", "error": {"type": "AttributeError", "message": "'NoneType' object has no attribute 'read'"}, "stream_events": [], "reconstructed_answer": ""}
    assert lines(frames(spark, [shell], events=good), "stream-events") == good[::-1]


def test_files_hold_the_order_and_reruns_give_the_same(spark, tmp_path):
    records = [{"request_id": f"q{i * 7919 % 400}", "terminal_outcome": "completed", "stream_events": [{"i": j} for j in range(i % 4)]} for i in range(400)]
    views = frames(spark, records, records[::3])

    def read(folder):
        artifacts.write_attempt(views.repartition(8), str(folder))
        return {d.name: b"".join(f.read_bytes() for f in sorted(d.glob("part-*"))) for d in folder.glob("output=*")}

    first = read(tmp_path / "one")
    assert [json.loads(x)["request_id"] for x in first["output=results"].splitlines()] == [r["request_id"] for r in records]
    assert [(e["request_id"], e["event_index"]) for e in map(json.loads, first["output=stream-events"].splitlines())] == [(r["request_id"], j) for r in records for j in range(len(r["stream_events"]))]
    assert set(first) == {f"output={n}" for n in ("results", "requests", "stream-events", "reconstructed-responses", "evaluations")}
    assert read(tmp_path / "one") == first == read(tmp_path / "two")


def test_nothing(spark):
    assert frames(spark, []).collect() == []


def test_lines_are_not_made_in_the_generator(spark):
    """Making a line is dear, and Spark doesn't compile what a generator holds."""
    plan = frames(spark, [{"request_id": "a"}])._jdf.queryExecution().optimizedPlan().toString()
    held = [x for x in plan.splitlines() if "Generate inline" in x]
    assert held and not any("StructsToJson" in x or "to_json" in x for x in held)


def test_numbers_and_names_are_written_as_before(spark):
    record = {"request_id": "a", "round_id": "r", "é\U0001f600": 1, "x": 100.0, "stream_events": [{"t": 2.0, "": 1}]}
    views = frames(spark, [record], events=[durable("a", 0, **{"t": 2, "": 1})], rounds=[("r", 2.0)])
    found = {r.output: r.line for r in views.collect()}
    assert '"launch_skew_ms":2,' in found["results"] and '"x":100' in found["results"] and json.loads(found["results"]) == {**record, "launch_skew_ms": 2}
    assert '"launch_skew_ms":2,' in found["requests"]
