"""Streams joined by key and time, bursts of events, and frames as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def evaluated_within(records: DataFrame, evaluations: DataFrame, within: str, late: str = "10 minutes", columns: tuple[str, ...] = ("classification",)) -> DataFrame:
    """(request_id, ended_at, evaluated_at, columns): each record with every evaluation that comes at or up to ``within`` after its end.

    ``records`` has request_id and ended_at, ``evaluations`` request_id,
    evaluated_at and the columns, both streams. A pair comes out when both are
    there; a record without one comes out once, with nulls, when the watermarks of
    both streams (``late`` behind their latest time) are past its time. State is
    kept as long as a partner can come. A null id finds nothing; rows without a time
    are left out.
    """
    r = records.where("ended_at IS NOT NULL").select("request_id", "ended_at").withWatermark("ended_at", late)
    e = evaluations.where("evaluated_at IS NOT NULL").select(F.col("request_id").alias("_id"), "evaluated_at", *columns).withWatermark("evaluated_at", late)
    reach = F.expr(f"request_id = _id AND evaluated_at >= ended_at AND evaluated_at <= ended_at + INTERVAL {within}")
    return r.join(e, reach, "left_outer").drop("_id")


def bursts(events: DataFrame, by: list[str], at: str, gap: str, late: str = "10 minutes", **values: Column) -> DataFrame:
    """(by, first_at, until, n, values): runs of events of a group at most ``gap`` apart; ``until`` is the last one's time and the gap.

    ``values`` are aggregates by name. As a stream, a burst comes out once, when
    the watermark is past ``until``, and its state goes; events later than that
    begin no new one. Null times belong to no burst.
    """
    known = events.where(F.col(at).isNotNull())
    timed = known.withWatermark(at, late) if events.isStreaming else known
    grouped = timed.groupBy(*by, F.session_window(at, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in values.items()])
    return grouped.select(*by, F.col("_w.start").alias("first_at"), F.col("_w.end").alias("until"), "n", *values)


@udtf(returnType="request_id string, frame bigint, data string, comments int, done boolean")
class FrameLines:
    """Frames of the lines (request_id, line_no, line) of one request, as ``operators.frames`` has them; it keeps one frame at a time."""

    def __init__(self):
        self.request = None
        self.frame = self.lines = self.comments = 0
        self.data = []

    def _cut(self) -> Iterator[tuple]:
        if self.lines:
            data = "\n".join(self.data) if self.data else None
            yield self.request, self.frame, data, self.comments, None if data is None else data == "[DONE]"
        self.frame, self.lines, self.comments, self.data = self.frame + 1, 0, 0, []

    def eval(self, row: Row):
        line = row["line"]
        self.request = row["request_id"]
        if line is None:
            return
        if line == "":
            yield from self._cut()
            return
        self.lines += 1
        self.comments += line.startswith(":")
        if line.startswith("data:"):
            self.data.append(line[6:] if line.startswith("data: ") else line[5:])

    def terminate(self):
        yield from self._cut()


def register(spark: SparkSession) -> None:
    """Makes ``frame_lines(TABLE(lines) PARTITION BY request_id ORDER BY line_no)`` callable from SQL."""
    spark.udtf.register("frame_lines", FrameLines)
