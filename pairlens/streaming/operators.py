"""Structured Streaming forms: framing of event lines, idempotent capture, deadlines, incremental timing, round barriers.

Micro-batches do not keep arrival order, so state is keyed and re-ordered by
(offset, index), and every sink is idempotent on its key.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DEADLINE_MS = 20_000.0


def frames(lines: DataFrame) -> DataFrame:
    """(request_id, frame, data, comments, done): server-sent-event lines (request_id, line_no, line) cut at blank lines.

    Data lines of a frame are joined by line breaks after one optional space;
    an unfinished frame at the end counts.
    """
    by = Window.partitionBy("request_id").orderBy("line_no")
    numbered = lines.withColumn("frame", F.coalesce(F.sum((F.col("line") == "").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.when(F.col("line").startswith("data:"), F.struct("line_no", F.expr("substring(line, if(startswith(line, 'data: '), 7, 6))").alias("d")))))
    grouped = numbered.where("line <> ''").groupBy("request_id", "frame").agg(parts.alias("p"), F.count_if(F.col("line").startswith(":")).alias("comments"))
    data = F.when(F.size("p") > 0, F.array_join(F.transform("p", lambda x: x["d"]), "\n"))
    return grouped.select("request_id", "frame", data.alias("data"), "comments", (data == "[DONE]").alias("done"))


def within_deadline(events: DataFrame, offset: str = "offset_ms", limit: float = DEADLINE_MS) -> DataFrame:
    return events.where(F.col(offset) < limit)


def capture(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour"):
    """Writes events once by (request_id, event_index), as Parquet in append mode; the query can be restarted.

    A copy is known for as long as ``late`` behind the latest arrival, which bounds
    the state. A negative or missing index raises.
    """
    bad = F.coalesce(F.col("event_index") < 0, F.lit(True))
    checked = events.withColumn("event_index", F.when(bad, F.raise_error(F.lit("event_index is not an integer of at least 0")).cast("bigint")).otherwise(F.col("event_index")))
    timed = checked.withColumn("arrived_at", F.current_timestamp()).withWatermark("arrived_at", late)
    once = timed.dropDuplicatesWithinWatermark(["request_id", "event_index"]).withColumn("durability", F.lit("arrival_atomic"))
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def barrier(records: DataFrame, arms: int) -> DataFrame:
    """(round_id, arms): emits a round once, when its last arm has a terminal record, whatever batches these come in. A finished round keeps no names."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, done = state.get if state.exists else ([], False)
        seen = set(seen).union(*[pdf["provider"] for pdf in batches])
        if not done and len(seen) >= arms:
            done = True
            yield pd.DataFrame({"round_id": [key[0]], "arms": [len(seen)]})
        state.update(([] if done else sorted(seen), done))

    return records.groupBy("round_id").applyInPandasWithState(step, "round_id long, arms int", "seen array<string>, done boolean", "append", GroupStateTimeout.NoTimeout)


def deadlines(events: DataFrame, limit_ms: float = DEADLINE_MS) -> DataFrame:
    """(request_id, outcome, events): a request's end once, as ``completed`` when its [DONE] event comes in time, else as ``timeout``.

    ``events`` has request_id, offset_ms and done. An event at or past the limit
    ends its request as a timeout, and later ones are rejected.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, ended = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("offset_ms", kind="stable")
        for offset, done in zip(rows["offset_ms"], rows["done"], strict=True):
            if ended:
                break
            in_time = offset < limit_ms
            n += int(in_time)
            if done or not in_time:
                ended = True
                yield pd.DataFrame({"request_id": [key[0]], "outcome": ["completed" if in_time else "timeout"], "events": [n]})
        state.update((n, ended))

    return events.groupBy("request_id").applyInPandasWithState(step, "request_id string, outcome string, events long", "n long, ended boolean", "append", GroupStateTimeout.NoTimeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """Sets the session's state store to RocksDB, which timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Frames(StatefulProcessor):
    """The half line and half frame of a response, and chunks that came before their turn."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "turn long, half string, frame long, lines long, comments long, due long")
        self.data = handle.getListState("data", "line string")
        self.early = handle.getMapState("early", "turn long", "chunk string")

    def _line(self, line: str, last: bool = False) -> None:
        if line != "":
            self.lines += 1
            self.comments += line.startswith(":")
            if line.startswith("data:"):
                self.held.append(line[6:] if line.startswith("data: ") else line[5:])
        if (line == "" or last) and self.lines:
            data = "\n".join(self.held) if self.held else None
            self.out.append((self.frame, data, self.comments, None if data is None else data == "[DONE]"))
        if line == "" or last:
            self.frame, self.lines, self.comments, self.held = self.frame + 1, 0, 0, []

    def _load(self) -> None:
        self.turn, self.half, self.frame, self.lines, self.comments, self.due = self.at.get() if self.at.exists() else (0, "", 0, 0, 0, None)
        self.held, self.out = [r[0] for r in self.data.get()] if self.lines else [], []

    def _rows(self, key) -> Iterator[pd.DataFrame]:
        if self.out:
            frame, data, comments, done = zip(*self.out, strict=True)
            yield pd.DataFrame({"request_id": key[0], "frame": frame, "data": pd.Series(data, dtype=object), "comments": comments, "done": pd.Series(done, dtype=object)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        new, latest = {}, 0
        for pdf in rows:
            new.update(zip(pdf["turn"].tolist(), pdf["chunk"].tolist(), strict=True))
            latest = max(latest, int(pdf["at_ms"].max()))
        while (waits := self.early.containsKey((self.turn,))) or self.turn in new:
            chunk = new.pop(self.turn, None)
            if waits:
                chunk = self.early.getValue((self.turn,))[0]
                self.early.removeKey((self.turn,))
            *whole, self.half = (self.half + chunk).split("\n")
            for line in whole:
                self._line(line)
            self.turn += 1
        for turn, chunk in new.items():
            if turn > self.turn:
                self.early.updateValue((turn,), (chunk,))
        due = max(latest + self.idle, self.due or 0)
        if due != self.due:
            if self.due is not None:
                self.handle.deleteTimer(self.due)
            self.handle.registerTimer(due)
        if self.held:
            self.data.put([(x,) for x in self.held])
        else:
            self.data.clear()
        self.at.update((self.turn, self.half, self.frame, self.lines, self.comments, due))
        yield from self._rows(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._load()
        waiting = sorted((k[0], v[0]) for k, v in self.early.iterator())
        *whole, half = (self.half + "".join(c for _, c in waiting)).split("\n")
        for line in whole:
            self._line(line)
        self._line(half, last=True)
        for state in (self.at, self.data, self.early):
            state.clear()
        yield from self._rows(key)

    def close(self) -> None:
        pass


def framed_chunks(chunks: DataFrame, idle: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """(request_id, frame, data, comments, done): server-sent events from chunks of response text that are cut anywhere, as ``frames`` has them.

    ``chunks`` has request_id, turn (0, 1, ..), chunk and event_time. Chunks may come
    in any order and over any batches: those before their turn wait, a copy counts
    once. A frame comes out with the blank line that ends it; what is unfinished,
    and what still waits behind a lost chunk, when the watermark is ``idle``
    milliseconds past the response's last chunk, and then its state is gone. The
    session's state store is set to RocksDB.
    """
    with_timers(chunks.sparkSession)
    timed = chunks.select("request_id", F.col("turn").cast("long").alias("turn"), F.coalesce("chunk", F.lit("")).alias("chunk"), F.unix_millis("event_time").alias("at_ms"), "event_time").withWatermark("event_time", late)
    return timed.groupBy("request_id").transformWithStateInPandas(_Frames(idle), "request_id string, frame long, data string, comments long, done boolean", "Append", "EventTime")


class _Deadline(StatefulProcessor):
    """A request's events in time, until the watermark passes its deadline; then what became of it, until late bytes are over."""

    def __init__(self, limit_ms: float, linger_ms: float):
        self.limit, self.linger = limit_ms, linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "events long, rejected long, done boolean, ended boolean, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, rejected, done, ended, due = self.seen.get() if self.seen.exists() else (0, 0, False, False, None)
        for pdf in rows:
            in_time = (pdf["offset_ms"] < self.limit) & (not ended)
            n += int(in_time.sum())
            rejected += int((~in_time).sum())
            done = done or bool((in_time & pdf["done"]).any())
            if due is None:
                due = int(pdf["at_ms"].iloc[0] - pdf["offset_ms"].iloc[0] + self.limit)
                self.handle.registerTimer(due)
        self.seen.update((n, rejected, done, ended, due))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, rejected, done, ended, due = self.seen.get()
        if ended:
            self.seen.clear()
            return
        self.seen.update((n, rejected, done, True, due))
        self.handle.registerTimer(due + int(self.linger))
        yield pd.DataFrame({"request_id": [key[0]], "outcome": ["completed" if done else "timeout"], "events": [n], "rejected": [rejected]})

    def close(self) -> None:
        pass


def timed_deadlines(events: DataFrame, limit_ms: float = DEADLINE_MS, late: str = "10 seconds", linger_ms: float = 600_000.0) -> DataFrame:
    """(request_id, outcome, events, rejected): every request's end once, when the watermark passes its deadline, heard of or not.

    ``events`` has request_id, offset_ms, done and event_time; a request began
    offset_ms before any of its events. It is ``completed`` if its [DONE] event is
    in time, whatever batch or order that comes in, else ``timeout``, silent ones
    too. ``events`` counts those in time, ``rejected`` those past the limit so far;
    bytes that come within ``linger_ms`` of the deadline change nothing more, and
    then the request's state is gone. Its state is a few numbers. The session's
    state store is set to RocksDB, which timers need.
    """
    with_timers(events.sparkSession)
    timed = events.select("request_id", F.col("offset_ms").cast("double").alias("offset_ms"), F.coalesce("done", F.lit(False)).alias("done"), F.unix_millis("event_time").alias("at_ms"), "event_time").withWatermark("event_time", late)
    return timed.groupBy("request_id").transformWithStateInPandas(_Deadline(limit_ms, linger_ms), "request_id string, outcome string, events long, rejected long", "Append", "EventTime")


def incremental_timing(events: DataFrame) -> DataFrame:
    """(request_id, ttfo_ms, ttfa_ms, last_ms, n_events) after each batch, in update mode; evidence before a failure stays."""
    says, thinks = F.coalesce("answer", F.lit("")) != "", F.coalesce("reasoning", F.lit("")) != ""
    return events.groupBy("request_id").agg(F.min(F.when(says | thinks, F.col("offset_ms"))).alias("any_ms"), F.min(F.when(says, F.col("offset_ms"))).alias("ttfa_ms"), F.max(F.when(says, F.col("offset_ms"))).alias("last_ms"), F.count(F.lit(1)).alias("n_events")).select("request_id", F.when(F.col("ttfa_ms").isNotNull(), F.col("any_ms")).alias("ttfo_ms"), "ttfa_ms", "last_ms", "n_events")


def windowed_rates(events: DataFrame, time: Column, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Events and errors by sliding or tumbling window of event time, behind a watermark."""
    timed = events.withColumn("event_time", time).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", width, slide) if slide else F.window("event_time", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for a stream's files: in the cluster's shared folder, or a temporary one in a local session without that."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        named = tempfile.mkdtemp(prefix="stream-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streams"
    return f"{named.rstrip('/')}/{name}"


def run_to_files(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it emitted, by way of files; in complete mode the last result counts."""
    spark: SparkSession = stream.sparkSession
    folder = scratch(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/rows").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
