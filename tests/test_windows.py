"""Stream-stream joins, bursts and the table function over several batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairlens.streaming import operators as st
from pairlens.streaming import windows


def feed(spark, folder, schema, *rows):
    if rows:
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").json(folder)


def advance(stream, folder):
    """Runs the stream on over what has come and returns all it has emitted."""
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def timed(spark, folder, schema, name):
    return spark.readStream.schema(schema).json(folder).withColumn(name, F.timestamp_seconds("s")).drop("s")


def test_evaluations_meet_records_in_time(spark, tmp_path):
    a, b, work = (str(tmp_path / n) for n in "abw")
    ra, rb = "request_id string, s long", "request_id string, s long, classification string"

    def run(records=(), evaluations=()):
        feed(spark, a, ra, *records)
        feed(spark, b, rb, *evaluations)
        got = advance(windows.evaluated_within(timed(spark, a, ra, "ended_at"), timed(spark, b, rb, "evaluated_at"), "60 seconds", "10 seconds"), work)
        return sorted(((r[0], int(r[1].timestamp()), r[2] and int(r[2].timestamp()), r[3]) for r in got.collect()), key=str)

    first = run([("soon", 1000), ("edge", 1000), ("late", 1000), ("never", 1000), ("before", 1000), (None, 1000)], [("soon", 1001, "x"), ("before", 999, "x"), ("other", 1000, "x"), (None, 1000, "x"), ("never", None, "x")])
    assert first == [("soon", 1000, 1001, "x")]
    # partners come batches later, one just in time and one not; nobody is given up before both watermarks pass
    second = run([("tick", 1050)], [("edge", 1060, "y"), ("late", 1061, "y"), ("soon", 1059, "z")])
    assert second == sorted([*first, ("edge", 1000, 1060, "y"), ("soon", 1000, 1059, "z")])
    run([("tock", 1300)], [("tock", 1300, "t")])
    got = run([("end", 1301)], [("end", 1301, "t")])
    lone = sorted((r for r in got if r[2] is None), key=str)
    assert [r for r in got if r[2] is not None] == sorted([*second, ("tock", 1300, 1300, "t"), ("end", 1301, 1301, "t")], key=str)
    assert {r[0] for r in lone} >= {"late", "never", "before", "tick"} and len({r[0] for r in lone}) == len(lone)


def test_bursts_over_batches(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "w")
    schema = "g string, s long, v int"

    def run(*rows):
        feed(spark, source, schema, *rows)
        got = advance(windows.bursts(timed(spark, source, schema, "at"), ["g"], "at", "20 seconds", "10 seconds", v=F.sum("v")), work)
        return sorted(tuple(int(x.timestamp()) if hasattr(x, "timestamp") else x for x in r) for r in got.collect())

    assert run(("a", 1000, 1), ("a", 1019, 2), ("b", 1000, 5), ("a", 1041, 3), ("a", None, 9)) == [("b", 1000, 1020, 1, 5)]
    # an event between joins two runs into one
    assert run(("a", 1035, 4)) == [("b", 1000, 1020, 1, 5)]
    assert run(("z", 2000, 0)) == [("a", 1000, 1061, 4, 10), ("b", 1000, 1020, 1, 5)]
    still = spark.createDataFrame([("a", 1000), ("a", 1020)], "g string, s long").select("g", F.timestamp_seconds("s").alias("at"))
    assert windows.bursts(still, ["g"], "at", "20 seconds").count() == 1 and windows.bursts(still, ["g"], "at", "19 seconds").count() == 2


@pytest.mark.parametrize("text", ["", "\n\n", "data: a\ndata:b\n\n: c\n\nx: y\ndata: [DONE]", ": p\ndata:\n\n\ndata:  two\n\n", "data: open"])
def test_function_is_frames(spark, text):
    windows.register(spark)
    rows = [(i, n, x) for i in ("q", "r") for n, x in enumerate((text if i == "q" else text + "\n\ndata: more").split("\n"))]
    lines = spark.createDataFrame(rows, "request_id string, line_no int, line string").repartition(3)
    got = spark.sql("SELECT * FROM frame_lines(TABLE({lines}) PARTITION BY request_id ORDER BY line_no)", lines=lines)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, st.frames(lines).select("request_id", "frame", "data", "comments", "done").collect()), key=str)
