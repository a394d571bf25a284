"""Members of a record that are read at once, against members read one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import records
from pairlens.plans import contract_queries, derive_queries, record_queries

SF = "/root/testdata/sf0.001"


def test_read_keeps_kinds_and_nulls(spark):
    docs = ['{"item_id":null,"usage":[1],"timings":{"ttfo_ms":null,"ttfa_ms":"x"},"stream_events":[{"content":null},5,null]}', "[1]", "{}"]
    rows = spark.createDataFrame([(d,) for d in docs], "d string").select(F.parse_json("d").alias("record"))
    got = records.read(rows).select(F.to_json("_m.item_id").alias("a"), F.col("_m.usage").isNull().alias("b"), F.to_json("_m.timings.ttfo_ms").alias("c"), F.to_json("_m.timings.ttfa_ms").alias("d"), F.transform("_m.stream_events", lambda e: F.struct(e.isNull(), F.to_json(e["content"]))).alias("e"))
    assert [(r.a, r.b, r.c, r.d, r.e and [tuple(x) for x in r.e]) for r in got.collect()] == [("null", True, "null", '"x"', [(False, "null"), (True, None), (True, None)]), (None, True, None, None, None), (None, True, None, None, None)]


def test_facts_look_up_few_members(spark):
    """A record is read as a whole, and not a member at a time."""
    plan = derive_queries.facts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(record") <= 2 and derive_queries.facts(spark, SF).rdd.getNumPartitions() > 1


def test_configuration_parses_a_record_once(spark):
    plan = record_queries.configuration_evidence(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(") + plan.count("parseJson") <= 2


def test_whole_texts_go_in_small_batches(spark):
    """A worker that normalises whole texts holds few of them at a time, and a smaller cap of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, kept in (("64m", str(4 << 20)), ("67108864b", str(4 << 20)), ("1000", "1000")):
            spark.conf.set(name, given)
            contract_queries.normalize_match(spark, SF)
            assert spark.conf.get(name).rstrip("b") == kept
    finally:
        spark.conf.set(name, before)
