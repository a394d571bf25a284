"""Queries that build request bodies and lay out the views of saved records."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.operators import wire
from pairlens.sources.artifacts import attempt_views
from pairlens.sources.tables import attempts, table

from .metrics_queries import FACT
from .registry import query


@query("logical_request_hashes", """SELECT p_partkey, sha256('{"messages":[{"content":"sys","role":"system"},{"content":"' || p_name || '","role":"user"}],"output_schema":{"a":"string","b":"bool"},"schema_name":"' || p_brand || '","settings":{"max_completion_tokens":256,"temperature":0}}') AS logical_hash FROM part""")
def logical_request_hashes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    hash_ = wire.logical_hash(F.lit("sys"), F.col("p_name"), F.lit('{"b":"bool","a":"string"}'), F.col("p_brand"), F.lit('{"temperature":0,"max_completion_tokens":256}'))
    return p.select("p_partkey", hash_.alias("logical_hash"))


def _adapters(spark):
    rows = spark.range(25).select(F.col("id").cast("string").alias("provider"), F.concat(F.lit("model-"), F.col("id").cast("string")).alias("model"), F.when(F.col("id") % 2 == 0, "max_tokens").otherwise("max_completion_tokens").alias("max_tokens_field"))
    return rows.withColumn("top_k", F.when(F.col("provider").cast("int") % 3 == 0, -1)).withColumn("include_usage", F.col("provider").cast("int") % 5 == 0).withColumn("reasoning_docs_status", F.when(F.col("provider").cast("int") % 4 == 0, "pending_smoke").otherwise("documented"))


@query("request_bodies", """SELECT s_suppkey::VARCHAR AS request_id, '{"frequency_penalty":0,' || CASE WHEN n % 2 = 1 THEN '"max_completion_tokens":256,' ELSE '"max_tokens":256,' END || '"messages":[{"content":"sys","role":"system"},{"content":"' || s_name || '","role":"user"}],"model":"model-' || n || '","presence_penalty":0,"reasoning_effort":"low","response_format":{"type":"json_object"},"stream":true,'
 || CASE WHEN n % 5 = 0 THEN '"stream_options":{"include_usage":true},' ELSE '' END || '"temperature":0,' || CASE WHEN n % 3 = 0 THEN '"top_k":-1,' ELSE '' END || '"top_p":1}' AS body FROM (SELECT *, s_nationkey AS n FROM supplier)""")
def request_bodies(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("request_id"), F.col("s_nationkey").cast("string").alias("provider"), F.lit("sys").alias("system"), F.col("s_name").alias("user"))
    return wire.request_bodies(s, _adapters(spark)).select("request_id", "body")


@query("adapter_matrix", "SELECT n_nationkey::VARCHAR AS provider, 'model-' || n_nationkey AS model_key, CASE WHEN n_nationkey % 4 = 0 THEN 'pending_smoke' ELSE 'documented' END AS reasoning_docs_status, CASE WHEN n_nationkey % 3 = 0 THEN '-1' ELSE 'omitted' END AS top_k, true AS eligible FROM nation")
def adapter_matrix(spark, sf_dir):
    return wire.adapter_matrix(_adapters(spark))


def _saved(spark, sf_dir):
    """Attempts as saved records: an answer, one event for each of k % 4, and a request unless k is 0."""
    a = attempts(spark, sf_dir)
    events = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, F.col("k") % 4), lambda i: F.struct((i * 10).alias("event_index"), i.alias("offset_ms")))
    request = F.when(F.col("k") > 0, F.struct(F.col("k").alias("max_tokens")))
    doc = F.to_json(F.struct(F.col("seq").cast("string").alias("request_id"), "provider", "round_index", F.col("family").cast("string").alias("task_family"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("a"), F.col("k"))).alias("answer"), events.alias("stream_events"), request.alias("request")))
    return a.select(F.col("seq").cast("string").alias("request_id"), "seq", "k", F.parse_json(doc).alias("record"))


@query("request_rows", f"{FACT} SELECT seq::VARCHAR AS request_id, provider, round_index, CASE WHEN k > 0 THEN k END AS max_tokens FROM attempts")
def request_rows(spark, sf_dir):
    return wire.request_rows(_saved(spark, sf_dir)).select("request_id", "provider", "round_index", F.try_variant_get("request", "$.max_tokens", "int").alias("max_tokens"))


@query("reconstructed_responses", f"{FACT} SELECT seq::VARCHAR AS request_id, provider, family::VARCHAR AS task_family, '' AS reasoning, CASE WHEN k % 2 = 0 THEN 'a' || k ELSE '' END AS answer FROM attempts")
def reconstructed_responses(spark, sf_dir):
    return wire.reconstructed(_saved(spark, sf_dir)).drop("item_id")


@query("embedded_events", f"{FACT} SELECT seq::VARCHAR AS request_id, i * CASE WHEN seq % 2 = 0 THEN 1 ELSE 10 END AS event_index, CASE WHEN seq % 2 = 0 THEN 'arrival_atomic' ELSE 'terminal_embedded' END AS durability FROM (SELECT seq, unnest(range(k % 4)) AS i FROM attempts)")
def embedded_events(spark, sf_dir):
    """Even requests have durable events as well, numbered from 0; odd ones only those in their record."""
    saved = _saved(spark, sf_dir)
    durable = saved.where("seq % 2 = 0").select("request_id", F.posexplode(F.try_variant_get("record", "$.stream_events", "array<variant>")).alias("event_index", "event"))
    return wire.all_events(saved, durable).select("request_id", "event_index", "durability")


@query("materialised_attempt", f"""{FACT}, d AS (SELECT *, seq::VARCHAR AS id, CASE WHEN outcome = '2xx' THEN 'completed' ELSE outcome END AS label, ['{{"event_index":' || i * 10 || ',"offset_ms":' || i || '}}' FOR i IN range(k % 4)] AS ev,
 CASE WHEN k > 0 THEN '{{"max_tokens":' || k || '}}' END AS req, CASE WHEN round_index % 2 = 0 THEN round_index % 7 END AS skew FROM attempts),
r AS (SELECT *, '{{' || CASE WHEN k % 2 = 0 THEN '"answer":"a' || k || '",' ELSE '' END || CASE WHEN skew IS NOT NULL THEN '"launch_skew_ms":' || skew || ',' ELSE '' END || '"provider":"' || provider || '",' || CASE WHEN req IS NOT NULL THEN '"request":' || req || ',' ELSE '' END || '"request_id":"' || id || '","round_id":"' || round_id || '","round_index":' || round_index || ',"stream_events":[' || array_to_string(ev, ',') || '],"task_family":"' || family || '","terminal_outcome":"' || label || '"}}' AS rec FROM (SELECT *, round_index AS round_id FROM d)),
e AS (SELECT seq, id, unnest(range(k % 4)) AS i FROM d)
SELECT 'results' AS output, seq, 0 AS place, rec AS line FROM r UNION ALL SELECT 'failures', seq, 0, rec FROM r WHERE label <> 'completed'
UNION ALL SELECT 'requests', seq, 0, '{{"item_id":null,"launch_skew_ms":' || coalesce(skew::VARCHAR, 'null') || CASE WHEN k > 0 THEN ',"max_tokens":' || k ELSE '' END || ',"provider":"' || provider || '","request_id":"' || id || '","round_id":"' || round_id || '","round_index":' || round_index || ',"task_family":"' || family || '"}}' FROM r
UNION ALL SELECT 'reconstructed-responses', seq, 0, '{{"answer":"' || CASE WHEN k % 2 = 0 THEN 'a' || k ELSE '' END || '","item_id":null,"provider":"' || provider || '","reasoning":"","request_id":"' || id || '","task_family":"' || family || '"}}' FROM r
UNION ALL SELECT 'evaluations', seq, 0, '{{"correct":' || CASE WHEN k >= 5 THEN 'true' ELSE 'false' END || ',"request_id":"' || id || '"}}' FROM r WHERE k % 5 > 0
UNION ALL SELECT 'stream-events', seq, i::INT, '{{"durability":"' || CASE WHEN seq % 2 = 0 THEN 'arrival_atomic' ELSE 'terminal_embedded' END || '","event_index":' || i * 10 || ',"offset_ms":' || i || ',"request_id":"' || id || '"}}' FROM e""")
def materialised_attempt(spark, sf_dir):
    """Attempts as saved records; even ones have durable events too, and even rounds a known skew. Attempts are dealt before they are made into records, which are larger."""
    all_ = attempts(spark, sf_dir).withColumn("request_id", F.col("seq").cast("string"))
    a = all_.repartition("request_id").withColumn("id", F.col("request_id"))
    events = F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), 1, F.col("k") % 4), lambda i: F.struct((i * 10).alias("event_index"), i.alias("offset_ms")))
    label = F.when(F.col("outcome") == "2xx", "completed").otherwise(F.col("outcome"))
    answer = F.when(F.col("k") % 2 == 0, F.concat(F.lit("a"), F.col("k")))
    saved = F.struct(F.col("id").alias("request_id"), "provider", F.col("round_index").cast("string").alias("round_id"), "round_index", F.col("family").cast("string").alias("task_family"), label.alias("terminal_outcome"), answer.alias("answer"), events.alias("stream_events"), F.when(F.col("k") > 0, F.struct(F.col("k").alias("max_tokens"))).alias("request"))
    records = a.select("request_id", F.parse_json(F.to_json(saved)).alias("record"))
    judged = a.where("k % 5 > 0").select("request_id", F.parse_json(F.to_json(F.struct(F.col("id").alias("request_id"), (F.col("k") >= 5).alias("correct")))).alias("evaluation"))
    each = a.where("seq % 2 = 0").select("request_id", F.explode(events).alias("e"))
    durable = each.select("request_id", "e.event_index", F.parse_json(F.to_json(F.struct("request_id", "e.event_index", "e.offset_ms", F.lit("arrival_atomic").alias("durability")))).alias("event"))
    rounds = all_.where("round_index % 2 = 0").select("round_index").distinct().select(F.col("round_index").alias("round_id"), (F.col("round_index") % 7).alias("launch_skew_ms"))
    return attempt_views(a.select("request_id", "seq"), records, judged, durable, rounds)
