"""Readers: tables as Parquet, strict JSON lines, JSON folders, templates and file inventories; and request facts from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from pairlens.functions.stats import output_speed, token_cost

FAMILIES = (0, 1, 2)
PRICES = {"default": (0.15, 0.50), "arm3": (0.45, 1.50)}

ITEM_SCHEMA = "id string, use_case string, split string, prompt struct<system:string,user:string>, output_schema map<string,string>, gold string, aliases array<string>, tokens map<string,bigint>"
EVENT_SCHEMA = "request_id string, event_index bigint, monotonic_offset_ms double, classification string, reasoning_content string, answer_content string, durability string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch of whole texts between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Cap Arrow batches at BATCH_BYTES for this session, if it allows more: a worker holds a batch several times over, as bytes and as strings, and 10,000 texts are many bytes."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not now.rstrip("bB").isdigit() or not 0 < int(now.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame, by: str) -> DataFrame:
    """df in three tasks a core, for dear work by row: a file is read in no more tasks than it has row groups."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, by)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a missing path has none, a malformed line raises."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, with its name in ``file``, in the order of names."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path).withColumn("file", F.col("_metadata.file_name")).orderBy("file")


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Whole files in ``value``, without one trailing line break."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\\n\\z", "").alias("value"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file below ``path`` but hidden ones and those in hidden folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    below = F.substring_index("path", "/" + path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.where(~F.concat(F.lit("/"), below).contains("/.")).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def release_hash(files: DataFrame) -> DataFrame:
    """SHA-256 over path:hash lines in path order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: F.concat_ws(":", f["path"], f["sha256"]))
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("release_hash"))


def attempts(spark: SparkSession, sf_dir: str, balanced: bool = True) -> DataFrame:
    """One row for each request: event e is arm e mod 10's request in round e div 10; whole rounds, as many for each family."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    round_ = (F.col("event_id") - F.col("event_id") % 10) / 10
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select(F.col("event_id").alias("seq"), round_.cast("long").alias("round_index"), F.concat(F.lit("arm"), (F.col("event_id") % 10).cast("string")).alias("provider"), F.col("event_type"), "value", k.alias("k"))
    base = base.withColumn("family", (F.col("round_index") % 3).cast("int"))
    if balanced:
        n = events.agg(F.floor(F.count(F.lit(1)) / 30).alias("whole"))
        base = base.crossJoin(F.broadcast(n)).where("round_index < 3 * whole").drop("whole")
    failed = F.element_at(F.array(F.lit("timeout"), F.lit("429"), F.lit("5xx"), F.lit("transport_error")), F.col("k") + 1)
    outcome = F.when((F.col("event_type") == "error") & (F.col("k") < 4), failed).otherwise("2xx")
    return base.withColumn("outcome", outcome)


def request_facts(spark: SparkSession, sf_dir: str, balanced: bool = True) -> DataFrame:
    """attempts with times, tokens, costs and correctness derived from value and k; failed requests have no times."""
    a = attempts(spark, sf_dir, balanced)
    ok = F.col("outcome") == "2xx"
    price_in, price_out = (F.when(F.col("provider") == "arm3", PRICES["arm3"][i]).otherwise(PRICES["default"][i]) for i in (0, 1))
    return a.select(
        "seq", "round_index", F.col("round_index").alias("round_id"), "provider", "family", "outcome", "k",
        F.when(ok, F.col("value")).alias("e2e_ms"), F.when(ok, F.col("value") * 0.5).alias("ttfa_ms"),
        F.when(ok, F.col("value") * 0.25).alias("ttfo_ms"), F.when(ok, F.col("k").cast("long") % 3).alias("pre_answer_reasoning_tokens"), F.when(ok, F.col("k") % 3 > 0).alias("reasoning_emitted"),
        output_speed(F.col("k") + 2, F.col("value") * 0.5, F.col("value"), ok).alias("speed"),
        (ok & (F.col("k") >= 5)).alias("correct"), (ok & (F.col("k") == 4)).alias("invalid"),
        F.when(ok, F.col("k").cast("long") + 20).alias("tokens_in"), F.when(ok, F.col("k").cast("long")).alias("tokens_out"),
        F.when(ok, token_cost(F.col("k") + 20, F.col("k"), price_in, price_out)).alias("cost_usd"),
    )


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as token streams: users reason, assistants answer, the system sends metadata."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("event_index"), F.col("turn").cast("double").alias("offset_ms"), F.when(F.col("role") == "assistant", F.col("text")).alias("answer"), F.when(F.col("role") == "user", F.col("text")).alias("reasoning"), "role")
