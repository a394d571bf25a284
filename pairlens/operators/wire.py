"""Request bodies as providers take them, their hashes, and the views of saved records that repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.jsonstrict import canonical_json
from pairlens.operators.records import IDENTITY, integer, is_object, known_signature, member, text

#: Fixed members of every body.
SAMPLING = {"frequency_penalty": 0, "presence_penalty": 0, "temperature": 0, "top_p": 1}
CEILING = 256


def logical_hash(system: Column, user: Column, schema: Column, name: Column, settings: Column) -> Column:
    """SHA-256 over what a request asks, whoever is asked: messages, output schema (JSON), schema name, settings (JSON)."""
    said = lambda role, content: F.struct(content.alias("content"), F.lit(role).alias("role"))
    parts = [F.concat(F.lit('{"messages":'), F.to_json(F.array(said("system", system), said("user", user)))), F.concat(F.lit('"output_schema":'), schema), F.concat(F.lit('"schema_name":'), F.substring(F.to_json(F.array(name)), 2, 1 << 30))]
    inner = F.concat(parts[0], F.lit(","), parts[1], F.lit(","), F.regexp_replace(parts[2], "\\]\\z", ""), F.lit(',"settings":'), settings, F.lit("}"))
    return F.sha2(canonical_json(inner).cast("binary"), 256)


def request_bodies(requests: DataFrame, adapters: DataFrame) -> DataFrame:
    """(request_id, provider, body): the canonical JSON body of each request (request_id, provider, system, user).

    ``adapters`` has a row a provider: model, max_tokens_field, top_k (null: none),
    include_usage. A provider without an adapter raises.
    """
    rows = requests.join(adapters.withColumn("adapted", F.lit(True)), "provider", "left")
    message = lambda role: F.struct(F.col(role).alias("content"), F.lit(role).alias("role"))
    fixed = [F.lit(v).alias(k) for k, v in SAMPLING.items()]
    plain = F.to_json(F.struct(*fixed, F.array(message("system"), message("user")).alias("messages"), F.col("model"), F.lit(True).alias("stream"), F.struct(F.lit("json_object").alias("type")).alias("response_format"), F.lit("low").alias("reasoning_effort"), F.col("top_k"), F.when(F.col("include_usage"), F.struct(F.lit(True).alias("include_usage"))).alias("stream_options")))
    body = F.concat(F.regexp_replace(plain, "\\}\\z", ""), F.format_string(',"%s":%d}', "max_tokens_field", F.lit(CEILING)))
    missing = F.raise_error(F.concat(F.lit("no adapter for "), F.col("provider"))).cast("string")
    return rows.select("request_id", "provider", F.when(F.col("adapted").isNull(), missing).otherwise(canonical_json(body)).alias("body"))


def adapter_matrix(adapters: DataFrame) -> DataFrame:
    """(provider, model_key, reasoning_docs_status, top_k, eligible): what each adapter sends, ``omitted`` where it sends no top_k."""
    return adapters.select("provider", F.col("model").alias("model_key"), "reasoning_docs_status", F.coalesce(F.col("top_k").cast("string"), F.lit("omitted")).alias("top_k"), F.lit(True).alias("eligible"))


def request_rows(saved: DataFrame) -> DataFrame:
    """The identity of each saved record (record) with the request it sent, a VARIANT, NULL where that is no object."""
    doc = F.col("record")
    own = [(integer(member(doc, c)) if c in ("round_index", "provider_launch_index") else text(member(doc, c))).alias(c) for c in IDENTITY]
    return saved.select(*own, F.when(is_object(member(doc, "request")), member(doc, "request")).alias("request"))


def reconstructed(saved: DataFrame) -> DataFrame:
    """(request_id, provider, task_family, item_id, reasoning, answer) of saved records."""
    doc = F.col("record")
    answer = F.coalesce(text(member(doc, "reconstructed_answer", "answer")), F.lit(""))
    return saved.select(*[text(member(doc, c)).alias(c) for c in ("request_id", "provider", "task_family", "item_id")], F.coalesce(text(member(doc, "reconstructed_reasoning")), F.lit("")).alias("reasoning"), answer.alias("answer"))


def all_events(saved: DataFrame, durable: DataFrame) -> DataFrame:
    """(request_id, event_index, event, durability): the durable events of each record, or where there are none those in it, tagged as embedded.

    ``durable`` has request_id, event_index and event (VARIANT). Raises where a
    record has both and their numbers of events differ, unless it is the known
    failure that lost its events.
    """
    inside = saved.select("request_id", F.try_variant_get("record", "$.stream_events", "array<variant>").alias("events"), known_signature(F.col("record"), shell=True).alias("shell"))
    kept = durable.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))
    both = inside.join(kept, "request_id", "left")
    differ = F.col("n").isNotNull() & (F.coalesce(F.size("events"), F.lit(0)) != F.col("n")) & ~F.col("shell")
    wrong = F.raise_error(F.concat(F.lit("durable events differ from the record: "), F.col("request_id"))).cast("boolean")
    checked = both.withColumn("own", F.when(differ, wrong).otherwise(F.col("n").isNull()))
    embedded = checked.where("own").select("request_id", F.posexplode("events").alias("at", "event"))
    index = F.coalesce(integer(member(F.col("event"), "event_index")), F.col("at").cast("bigint"))
    embedded = embedded.select("request_id", index.alias("event_index"), "event", F.lit("terminal_embedded").alias("durability"))
    whole = durable.join(checked.where("not own").select("request_id"), "request_id").select("request_id", F.col("event_index").cast("bigint").alias("event_index"), "event", F.lit("arrival_atomic").alias("durability"))
    return whole.union(embedded)
