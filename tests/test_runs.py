"""Run-level checks, sinks and streams that no query shows."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pairlens.operators import runs
from pairlens.sources import artifacts, tables
from pairlens.streaming import operators as st


def test_run_ids_locks_and_guards():
    now = datetime(2024, 2, 3, 4, 5, 59)
    assert runs.run_id({"run-20240203-040559"}, now) == "run-20240203-040600" and runs.is_run_id("run-20240203-040559") and not runs.is_run_id("run-20240203-040559x")
    assert runs.lock_changes(None, {"a": 1}) == [] and runs.lock_changes({"a": {"x": 1, "y": 2}, "created_at": 1}, {"a": {"y": 2, "x": 1}, "created_at": 2}) == []
    assert runs.lock_changes({"a": 1, "b": 2}, {"a": 1, "b": 3, "c": None}) == ["b"]
    assert runs.digest("host", 16) == runs.digest("host")[:16]
    assert [runs.may_start(s, a) for s, a in (({}, 1), ({}, 2), ({"attempts": {1: False}}, 2), ({"attempts": {1: True}}, 2), ({"attempts": {1: True}}, None), ({"attempts": {1: True}, "full_run_authorized": True}, None), ({"full_run": "complete"}, 1))] == [None, "the attempt is not due", None, "the attempt is not due", "no accepted attempt or no approval", None, "the run is finished"]


def test_spec(tmp_path):
    good = {"benchmark_slug": "s", "task_families": ["f"], "providers": ["p"], "pricing": {"p": 1}}
    path = tmp_path / "spec.json"
    path.write_text(json.dumps(good))
    assert runs.load_spec(str(path)) == good
    path.write_text(json.dumps({**good, "providers": ["p", "q"], "benchmark_slug": ""}))
    with pytest.raises(ValueError, match="benchmark_slug, price of q"):
        runs.load_spec(str(path))


def test_items_and_manifest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"x"}\n{broken\n')
    spec = spark.range(0).selectExpr("'' AS family", "'' AS template", "map('', '') AS schema", "0 AS low", "0 AS high", "'' AS token_field")
    got = runs.item_problems(runs.read_items(spark, str(tmp_path / "a.jsonl")), spec, ("a", "b", "c")).orderBy("line_no").collect()
    assert [(r.file, r.line_no, r.problem) for r in got] == [("a.jsonl", 1, "missing fields"), ("a.jsonl", 2, "invalid JSON")]
    good = {"status": "frozen", "freeze_ready": True, "use_cases": {"a-b": {"private_items": 3}}}
    cases = [(good, None), ({**good, "status": "open"}, "not frozen"), ({**good, "freeze_ready": None}, "not ready"), ({**good, "use_cases": {}}, "families"), ({**good, "use_cases": {"a-b": {"private_items": 4}}}, "count of a-b")]
    d = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, j string").select("i", runs.manifest_problem(F.parse_json("j"), {"a-b": 3}).alias("p"))
    assert [r.p for r in d.orderBy("i").collect()] == [w for _, w in cases]


def test_gold_order_first_ids_and_counts(spark, tmp_path):
    from pairlens.plans.record_queries import TERMS

    fields = json.loads(TERMS)
    turned = dict(reversed(fields.items()))
    item = lambda i, gold: json.dumps({"id": i, "use_case": "c", "split": "private", "prompt": {"system": "s", "user": "u"}, "output_schema": {"a": "string"}, "gold": gold, "aliases": None, "tokens": {"user": 5}})
    (tmp_path / "c.jsonl").write_text("\n".join([item("x", fields), item("y", turned), item("x", fields), item("z", fields)]) + "\n")
    lines = runs.read_items(spark, str(tmp_path / "c.jsonl"))
    spec = spark.range(1).selectExpr("'c' AS family", "'s' AS template", "map('a', 'string') AS schema", "1 AS low", "9 AS high", "'user' AS token_field")
    got = runs.item_problems(lines, spec, ("a", "b", "c")).orderBy("line_no").collect()
    assert [(r.line_no, r.id, r.problem) for r in got] == [(2, "y", "gold order"), (3, "x", "repeated id")]
    expected = spark.createDataFrame([("c", 4), ("d", 2)], "family string, items int")
    assert [tuple(r) for r in runs.item_counts(lines, expected, 3).collect()] == [("d", 2, 0)]
    assert sorted(map(tuple, runs.item_counts(lines, expected.where("family = 'd'"), 4).collect()), key=str) == [("c", 0, 4), ("d", 2, 0), (None, 4, 3)]


def test_canonical_lines_and_inventory(spark, tmp_path):
    d = spark.createDataFrame([(1, None, {"z": "ß", "a": "b"})], "b int, a string, m map<string,string>")
    artifacts.write_jsonl(d, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":null,"b":1,"m":{"a":"b","z":"ß"}}'
    for name in ("x", ".hidden", ".dir/y", "in/z"):
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(name)
    assert sorted(r.path.rsplit("/tree/", 1)[1] for r in tables.inventory(spark, str(tmp_path / "tree")).collect()) == ["in/z", "x"]


def test_evaluation_sink(spark, tmp_path):
    path = str(tmp_path / "e")
    one = spark.createDataFrame([("a", True)], "request_id string, correct boolean")
    artifacts.append_evaluations(one.limit(0), one, path)
    artifacts.append_evaluations(spark.read.parquet(path), one, path)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(Exception, match="changed content"):
        artifacts.append_evaluations(spark.read.parquet(path), one.withColumn("correct", F.lit(False)), path)


def test_capture_restarts(spark, tmp_path):
    schema = "request_id string, event_index long, text string"
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for rows in ([("a", 0, "x"), ("a", 0, "x"), ("a", 1, "y")], [("a", 1, "y"), ("b", 0, "z")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        st.capture(spark.readStream.schema(schema).json(source), path, state).awaitTermination()
    got = spark.read.parquet(path).collect()
    assert sorted((r.request_id, r.event_index, r.durability) for r in got) == [("a", 0, "arrival_atomic"), ("a", 1, "arrival_atomic"), ("b", 0, "arrival_atomic")]


def test_barrier_takes_names_with_commas(spark, tmp_path):
    schema = "round_id long, provider string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a,b"), (2, "a"), (2, "b"), (2, "c")], schema).write.json(source)
    out = st.run_to_files(st.barrier(spark.readStream.schema(schema).json(source), 2), f"test-{tmp_path.name}")
    assert [(r.round_id, r.arms) for r in out.collect()] == [(2, 3)]
