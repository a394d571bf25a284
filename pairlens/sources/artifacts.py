"""Sinks and run artifacts: JSON lines, small atomic documents, append-only logs, terminal records and the views of an attempt."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.jsonstrict import canonical, canonical_json
from pairlens.operators.reconcile import immutable_upsert
from pairlens.operators.records import known_signature, text


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """Rows as canonical JSON lines: keys sorted at every depth, no spaces, nulls kept. Spark's commit makes the folder appear whole."""
    rows = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    df.select(canonical_json(rows).alias("value")).write.mode(mode).text(path)


def write_document(path: str, value) -> None:
    """A small canonical JSON document, written beside its place, flushed and renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=folder, prefix=".")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(canonical(value) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def read_document(path: str, default=None):
    if not os.path.exists(path):
        return default
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def log_event(spark: SparkSession, path: str, kind: str, **fields: str) -> None:
    """Appends one row to a lifecycle log."""
    row = spark.range(1).select(F.lit(kind).alias("kind"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("at"), *[F.lit(v).alias(k) for k, v in sorted(fields.items())])
    row.write.mode("append").json(path)


def append_terminal(existing: DataFrame, records: DataFrame, path: str, attempt: str) -> None:
    """Appends records that are new, by request_id, under their attempt with a content hash; a changed one raises."""
    content = F.to_json(F.struct(*[F.col(c) for c in sorted(records.columns)]))
    fresh = immutable_upsert(existing, records, "request_id", content)
    fresh.withColumn("record_hash", F.sha2(content, 256)).withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(path)


def append_evaluations(existing: DataFrame, evaluations: DataFrame, path: str) -> None:
    """Appends evaluations that are new by request_id; a changed one raises."""
    content = F.to_json(F.struct(*[F.col(c) for c in sorted(evaluations.columns)]))
    immutable_upsert(existing, evaluations, "request_id", content).write.mode("append").parquet(path)


REQUEST_KEYS = ("request_id", "provider", "task_family", "item_id", "round_id", "round_index", "launch_skew_ms")
#: What the views need of a record besides the whole of it, read in one pass; an event that is no object is NULL.
VIEWED = f"struct<{','.join(f'{n}:variant' for n in (*REQUEST_KEYS, 'reconstructed_answer', 'answer', 'reconstructed_reasoning', 'terminal_outcome'))},request:map<string,variant>,stream_events:array<map<string,variant>>>"


def _members(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _over(members: Column, added: Column) -> Column:
    """Members with others put in or over them, in the order of their names."""
    keys = F.sort_array(F.array_union(F.map_keys(members), F.map_keys(added)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(added[k], members[k])))


def _added(extra: dict[str, Column]) -> Column:
    null = F.parse_json(F.lit("null"))
    return F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), F.coalesce(v, null))])


def _normal(text_: Column) -> Column:
    return F.to_json(F.parse_json(text_))


def _json(members: Column) -> Column:
    """Canonical JSON of members in the order of their names; through a VARIANT only where that writes a number or orders names in another way, as its writer is slow."""
    said, names = F.to_json(members), F.array_join(F.map_keys(members), "")
    return F.when(said.contains(".0") | (F.octet_length(names) != F.length(names)), _normal(said)).otherwise(said)


def _text(v: Column) -> Column:
    """JSON of a VARIANT; members of an object one by one, which is faster."""
    return F.coalesce(F.to_json(_members(v)), F.to_json(v))


#: Lines of a record before they are rows; those of events inside it are still members.
OUTPUTS = "array<struct<output:string,place:int,line:string,body:map<string,variant>>>"


def _output(name: str, place: Column, line: Column | None = None, body: Column | None = None) -> Column:
    line, body = (F.lit(None) if c is None else c for c in (line, body))
    return F.struct(F.lit(name).alias("output"), place.alias("place"), line.cast("string").alias("line"), body.cast("map<string,variant>").alias("body"))


def attempt_views(schedule: DataFrame, records: DataFrame, evaluations: DataFrame, events: DataFrame, rounds: DataFrame) -> DataFrame:
    """(output, seq, place, line): the canonical JSON lines of an attempt's six outputs, in the order of the schedule and within a request by place.

    ``schedule`` has request_id and seq, the others a VARIANT by request_id:
    ``records`` record, ``evaluations`` evaluation, ``events`` (the durable ones)
    event_index and event; ``rounds`` has round_id and launch_skew_ms, which goes
    into the record. Requests that are not scheduled are left out. A record's
    durable events must be those in it, durability aside, unless it is the known
    failure that lost them: else this raises when it runs. Without durable events
    those in the record are written, marked as embedded. What did not complete is
    a failure too. An empty frame gives no lines. Numbers are written as VARIANT
    writes them.
    """
    doc, own = F.col("record"), F.col("_own")  # all of VIEWED
    bare = F.to_json(F.map_filter(_members(F.col("event")), lambda k, _: k != "durability"))
    known = events.select("request_id", F.struct("event_index", _text(F.col("event")).alias("line"), bare.alias("bare")).alias("e"))
    durable = known.groupBy("request_id").agg(F.array_sort(F.collect_list("e")).alias("durable"))
    skews = rounds.select(F.col("round_id").cast("string").alias("_round"), F.parse_json(F.to_json(F.col("launch_skew_ms").cast("variant"))).alias("_skew"), F.lit(True).alias("_known"))
    placed = schedule.select("request_id", "seq").join(records.select("request_id", "record"), "request_id").withColumn("_round", F.try_variant_get(doc, "$.round_id", "string"))
    rows = placed.join(durable, "request_id", "left").join(skews, "_round", "left").withColumn("_own", F.try_variant_get(doc, "$", VIEWED))

    # lines are made in projections, which are compiled; a generator and the functions of arrays are not
    none = F.create_map().cast("map<string,variant>")
    skew = F.when(F.col("_known"), F.col("_skew")).otherwise(own["launch_skew_ms"])
    identity = _added({k: skew if k == "launch_skew_ms" else own[k] for k in REQUEST_KEYS})
    done = F.coalesce(text(own["terminal_outcome"]) == "completed", F.lit(False))
    objects = F.coalesce(own["stream_events"], F.array().cast("array<map<string,variant>>"))
    others = F.when(F.exists(own["stream_events"], lambda m: m.isNull()), F.try_variant_get(doc, "$.stream_events", "array<variant>"))
    read = rows.select("*", F.coalesce(own["request"], none).alias("_request"), identity.alias("_identity"), _members(doc).alias("_whole"), _added({"launch_skew_ms": F.col("_skew")}).alias("_skewed"), objects.alias("_objects"), others.alias("_inside"), F.col("request_id").cast("variant").alias("_id"), done.alias("_done"))

    def placed_events(**more: Column) -> Column:
        def parts(members: Column, i: Column) -> Column:
            index = F.coalesce(members["event_index"], i.cast("bigint").cast("variant"))
            added = _added({"request_id": F.col("_id"), "event_index": index, **more})
            return F.struct(F.coalesce(members, F.create_map(F.lit("payload"), F.get("_inside", i))).alias("own"), added.alias("added"), members.isNotNull().alias("object"))

        return F.transform("_objects", parts)

    wanted = F.transform(F.filter(placed_events(), lambda x: x["object"]), lambda x: _over(x["own"], x["added"]))
    embedded = F.transform(placed_events(durability=F.lit("terminal_embedded").cast("variant")), lambda x, i: _output("stream-events", i, body=_over(x["own"], x["added"])))
    kept = F.transform("durable", lambda d, i: _output("stream-events", i, d["line"]))
    # most are the same as they stand; the others may still differ only in how a number is written
    bare = F.col("durable.bare")
    alike = F.to_json(wanted) == F.concat(F.lit("["), F.array_join(bare, ",", "null"), F.lit("]"))
    differ = F.col("durable").isNotNull() & ~alike & (F.transform(bare, _normal) != F.transform(wanted, lambda m: _normal(F.to_json(m)))) & ~known_signature(doc, shell=True)
    wrong = F.raise_error(F.concat(F.lit("durable events differ from the record: "), F.col("request_id"))).cast(OUTPUTS)
    said_events = F.when(F.col("_differ"), wrong).when(F.col("durable").isNotNull(), kept).otherwise(embedded)

    empty = F.parse_json(F.lit('""'))
    said = {"answer": F.coalesce(own["reconstructed_answer"], own["answer"], empty), "item_id": own["item_id"], "provider": own["provider"], "reasoning": F.coalesce(own["reconstructed_reasoning"], empty), "request_id": own["request_id"], "task_family": own["task_family"]}
    result = F.when(F.col("_known"), _json(_over(F.coalesce(F.col("_whole"), none), F.col("_skewed")))).otherwise(F.coalesce(F.to_json("_whole"), F.to_json(doc)))
    made = read.select("*", result.alias("_result"), _json(_over(F.col("_request"), F.col("_identity"))).alias("_line"), _json(_added(said)).alias("_said"), differ.alias("_differ"))
    plain = [_output(name, F.lit(0), F.col(c)) for name, c in (("results", "_result"), ("requests", "_line"), ("reconstructed-responses", "_said"))]
    plain = F.when(F.col("_done"), F.array(*plain)).otherwise(F.array(*plain, _output("failures", F.lit(0), F.col("_result"))))
    out = made.select("seq", F.inline_outer(F.concat(plain, said_events))).withColumn("line", F.coalesce("line", _json(F.col("body"))))
    judged = schedule.select("request_id", "seq").join(evaluations.select("request_id", "evaluation"), "request_id")
    return out.select("output", "seq", "place", "line").union(judged.select(F.lit("evaluations"), "seq", F.lit(0), _text(F.col("evaluation"))))


def write_attempt(views: DataFrame, folder: str) -> None:
    """Writes the lines of attempt_views in one job, a folder each output (``output=results``, ..); files in the order of their names hold the lines in order."""
    views.repartitionByRange("output", "seq", "place").sortWithinPartitions("output", "seq", "place").select("output", "line").write.mode("overwrite").partitionBy("output").text(folder)


def reconcile_events(durable: DataFrame, embedded: DataFrame) -> DataFrame:
    """(request_id, event_index, problem): events that the durable and the embedded copy do not share, durability aside."""
    content = [c for c in durable.columns if c not in ("request_id", "event_index", "durability")]
    a = durable.select("request_id", "event_index", F.struct(*content).alias("a"))
    b = embedded.select("request_id", "event_index", F.struct(*content).alias("b"))
    both = a.join(b, ["request_id", "event_index"], "full_outer")
    problem = F.when(F.col("a").isNull(), "not durable").when(F.col("b").isNull(), "not embedded").when(~F.col("a").eqNullSafe(F.col("b")), "different")
    return both.select("request_id", "event_index", problem.alias("problem")).where("problem is not null")
