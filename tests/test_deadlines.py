"""Deadlines by event-time timers: silent requests, late bytes, state that goes, restarts."""

from __future__ import annotations

import pytest

from pairlens.streaming import operators as st

SCHEMA = "request_id string, offset_ms double, done boolean, event_time timestamp"


@pytest.fixture
def run(spark, tmp_path):
    """Adds events (id, start second, offset, done) and runs the stream on; returns all it has emitted."""
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def go(*events):
        rows = spark.createDataFrame([(i, float(at), done, start * 1000 + at) for i, start, at, done in events], "request_id string, offset_ms double, done boolean, ms long")
        rows.selectExpr("request_id", "offset_ms", "done", "timestamp_millis(ms) AS event_time").coalesce(1).write.mode("append").parquet(source)
        stream = st.timed_deadlines(spark.readStream.schema(SCHEMA).parquet(source), limit_ms=20_000, late="30 seconds", linger_ms=60_000)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        go.rows_in_state = query.lastProgress.stateOperators[0].numRowsTotal if query.lastProgress else None
        return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect())

    return go


def test_silence_lateness_and_restart(run):
    tick = lambda s: (f"clock{s}", s, 0, True)
    assert run(("silent", 100, 10, False), ("ends", 100, 5, False), ("late", 100, 25_000, True), ("split", 100, 20_001, False)) == []
    full = run.rows_in_state
    # the end of ``split`` was in time, though it comes a batch after a late event; nothing is decided before the watermark
    assert run(("ends", 100, 19_999, True), ("split", 100, 19_000, True), ("ends", 100, 7, False)) == []
    want = [("ends", "completed", 3, 0), ("late", "timeout", 0, 1), ("silent", "timeout", 1, 0), ("split", "completed", 1, 1)]
    assert run(tick(151)) == want
    # bytes after the end, within and past the watermark's reach, change nothing
    assert run(("silent", 100, 40_000, True), ("late", 100, 1, True)) == want
    assert run(tick(400)) == sorted([*want, ("clock151", "completed", 1, 0)])
    assert run(tick(900))[0] == ("clock151", "completed", 1, 0) and run.rows_in_state < full
