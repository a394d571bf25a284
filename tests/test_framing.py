"""Framing of chunks cut anywhere, in any order, over batches that stop and go on."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pairlens.streaming import operators as st

SCHEMA = "request_id string, turn long, chunk string, event_time timestamp"


def test_as_frames_of_whole_lines(spark, tmp_path):
    rnd = random.Random(6)
    texts = {}
    for i in range(12):
        lines = [rnd.choice(["", "", "data: a", "data:b c", "data: ", ": note", "event: x", "data: [DONE]", "data:  é😀"]) for _ in range(rnd.randint(0, 25))]
        texts[f"r{i}"] = "\n".join(lines)
    texts["half"] = "data: x\n\ndata: y"
    lines = spark.createDataFrame([(r, n, line) for r, t in texts.items() for n, line in enumerate(t.split("\n"))], "request_id string, line_no int, line string")
    want = sorted((tuple(r) for r in st.frames(lines).select("request_id", "frame", "data", "comments", "done").collect()), key=str)
    chunks = []
    for r, t in texts.items():
        cuts = sorted(rnd.sample(range(len(t) + 1), min(len(t), rnd.randint(0, 9))))
        parts = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)], strict=True)]
        chunks += [(r, n, p) for n, p in enumerate(parts)]
    chunks += rnd.sample(chunks, 5)
    rnd.shuffle(chunks)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    got = []
    for batch in (chunks[:20], chunks[20:45], chunks[45:], [("clock", 0, "")]):
        at = 500 if batch[0][0] == "clock" else 100
        spark.createDataFrame(batch, "request_id string, turn long, chunk string").withColumn("event_time", F.timestamp_seconds(F.lit(at))).coalesce(1).write.mode("append").parquet(source)
        stream = st.framed_chunks(spark.readStream.schema(SCHEMA).parquet(source), idle=60_000)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        got.append(sorted((tuple(r) for r in spark.read.schema(stream.schema).parquet(out).collect()), key=str))
    assert got[3] == want
    assert 0 < len(got[0]) < len(got[1]) < len(got[2]) < len(got[3])
