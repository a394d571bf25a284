"""Saved records as VARIANT: aliases, normalisation, outcomes, event deltas, times, evaluation and compatibility.

A record is one JSON object. Members have several spellings; the first that is
*present* counts, even where it is null. In a VARIANT a missing member is NULL
and a JSON null is not, so ``member`` is a coalesce. Looking a member up is dear, as
the names of a VARIANT are decoded each time: the functions that need many read
all of them at once (``read``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairlens.functions.stats import guarded, output_speed, token_cost
from pairlens.operators import outcomes

OFFSETS = ("monotonic_offset_ms", "offset_ms", "elapsed_ms", "arrival_offset_ms")
ANSWERS = ("reconstructed_answer", "assistant_content", "response_content", "answer")
REASONING_CLASSES = ("reasoning", "reasoning_content", "reasoning_delta")
ANSWER_CLASSES = ("answer", "answer_content", "answer_delta", "visible_answer")
IDENTITY = ("request_id", "round_id", "round_index", "provider", "provider_launch_index", "task_family", "item_id")
#: Error type of a request that failed, by outcome.
FAILED = {"timeout": "timeout", "429": "rate_limited_http_429", "other_4xx": "other_http_4xx", "5xx": "http_5xx", "transport_error": "transport_error"}


@dataclass(frozen=True)
class Members:
    """An object whose members were read at once: a struct column of VARIANTs by name, NULL for all else than an object."""

    at: Column


def _variants(*names: str, **typed: str) -> str:
    return f"struct<{','.join([f'{n}:variant' for n in names] + [f'{n}:{t}' for n, t in typed.items()])}>"


NUMBERS = ("ttfo_ms", "ttfa_ms", "first_answer_token_ms", "last_answer_token_ms", "e2e_latency_ms", "output_tokens_per_second")
COUNTS = ("visible_answer_token_count", "pre_answer_reasoning_tokens")
FLAGS = ("configuration_compatible", "provider_configuration_compatible", "artifact_graph_complete", "local_artifact_graph_complete", "artifact_complete")
#: What is read of an event, and of a record.
EVENT = _variants(*OFFSETS, "classification", "event_type", "kind", "content", "redacted_payload", "payload", "reasoning_content", "answer_content", content_presence="struct<reasoning:variant,answer:variant>")
RECORD = _variants(
    "item_id", "round_id", "provider", "task_family", "http_status", "status_code", "terminal_outcome", "terminal_status", "cost_usd", *ANSWERS, "reconstructed_reasoning", "response", *NUMBERS, *COUNTS, "reasoning_emitted_before_answer", *FLAGS,
    error=_variants("type", "message"), usage=_variants("input_tokens", "prompt_tokens", "output_tokens", "completion_tokens"), timings=_variants(*NUMBERS, *COUNTS, "reasoning_emitted_before_answer"), model_identity=_variants("matches"),
    adapter_compatibility=_variants("status"), configuration_checks="map<string,variant>", stream_events=f"array<{EVENT}>",
)


def read(saved: DataFrame) -> DataFrame:
    """saved with ``_m``: all of RECORD from one pass over each record.

    It is marked nondeterministic, as in ``guarded``: else Spark moves filters on its members (a join
    adds one that its key is not null) below the making of the record, and makes and reads it there again.
    """
    return saved if "_m" in saved.columns else saved.withColumn("_m", F.when(F.spark_partition_id() >= 0, F.try_variant_get("record", "$", RECORD)))


def member(doc: Column | Members, *names: str) -> Column:
    """The first member that is present; NULL without one, a JSON null where that is its value."""
    return F.coalesce(*[doc.at[n] if isinstance(doc, Members) else F.try_variant_get(doc, f"$.{n}", "variant") for n in names])


def below(doc: Column | Members, name: str) -> Column | Members:
    """The object under a name, for member."""
    return Members(doc.at[name]) if isinstance(doc, Members) else member(doc, name)


def kind(v: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, DOUBLE, DECIMAL(p,s), OBJECT<..>, ARRAY<..>, VOID for JSON null; NULL where missing."""
    return F.schema_of_variant(v)


def text(v: Column) -> Column:
    """The string, NULL for all else."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def integer(v: Column) -> Column:
    """The integer; booleans and 12.0 are none."""
    return F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def number(v: Column, name: str) -> Column:
    """A finite number of at least 0, NULL for null and missing; raises for all else."""
    k = kind(v)
    n = F.try_variant_get(v, "$", "double")
    bad = F.raise_error(F.lit(f"{name} is not a finite non-negative number")).cast("double")
    is_number = (k == "BIGINT") | (k == "DOUBLE") | k.startswith("DECIMAL")
    return F.when(k.isNull() | (k == "VOID"), F.lit(None).cast("double")).when(is_number & (n >= 0) & ~F.isnan(n) & (n != float("inf")), n).otherwise(bad)


def is_true(v: Column) -> Column:
    return F.coalesce((kind(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def given(v: Column) -> Column:
    """The value, NULL for a JSON null too."""
    return F.when(~F.is_variant_null(v), v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def rich_text(v: Column) -> Column:
    """A string, or the joined strings and ``text`` or ``content`` strings of an array; '' for all else."""
    parts = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda b: F.coalesce(text(b), text(member(b, "text", "content"))))
    return F.coalesce(text(v), F.when(kind(v).startswith("ARRAY"), F.array_join(parts, "")), F.lit(""))


def reasoning_text(delta: Column) -> Column:
    """The first of three reasoning members with any text."""
    return F.coalesce(*[F.nullif(rich_text(member(delta, n)), F.lit("")) for n in ("reasoning_content", "reasoning", "reasoning_details")], F.lit(""))


def payload_class(payload: Column) -> Column:
    """Class of a stream payload by what its first choice carries."""
    choice = F.try_variant_get(payload, "$.choices[0]", "variant")
    delta = member(choice, "delta")
    keys = F.map_keys(F.try_variant_get(delta, "$", "map<string,variant>"))
    says = F.when(is_object(delta), rich_text(member(delta, "content"))).otherwise("")
    thinks = F.when(is_object(delta), reasoning_text(delta)).otherwise("")
    only_role = given(member(delta, "role")).isNotNull() & (F.size(keys) == 1)
    return outcomes.event_class(thinks, says, is_object(member(payload, "usage")), F.when(given(member(choice, "finish_reason")).isNotNull(), F.lit("finish")), F.when(only_role, F.array(F.lit("role"))).otherwise(F.array(F.lit(""))), is_object(delta))


def line_class(data: Column) -> Column:
    """Class of a framed data line: done, malformed_sse, or that of its payload; sse_comment where there is none."""
    payload = F.try_parse_json(data)
    return F.when(data.isNull(), "sse_comment").when(F.trim(data) == "[DONE]", "done").when(payload.isNull(), "malformed_sse").otherwise(payload_class(payload))


def known_signature(doc: Column | Members, shell: bool = False) -> Column:
    """Whether a record is the one known stream failure that was saved as a runner error; with ``shell`` it must have lost its events and answer as well."""
    error = below(doc, "error")
    found = (text(member(doc, "terminal_outcome", "terminal_status")) == "runner_error") & (text(member(error, "type")) == "AttributeError") & (text(member(error, "message")) == "'NoneType' object has no attribute 'read'") & given(member(doc, "http_status", "status_code")).isNull()
    if shell:
        events, answer = doc.at["stream_events"] if isinstance(doc, Members) else F.try_variant_get(doc, "$.stream_events", "array<variant>"), member(doc, "reconstructed_answer")
        found = found & (F.size(events) == 0) & (answer.isNull() | (text(answer) == ""))
    return F.coalesce(found, F.lit(False))


def record_outcome(doc: Column, strict: bool = True) -> Column:
    """One of outcomes.OUTCOMES; contradictions and run-invalidating records raise, or with ``strict`` off are NULL."""
    status = member(doc, "http_status", "status_code")
    return _outcome_of(status, text(member(doc, "terminal_outcome", "terminal_status")), known_signature(doc), strict)


def _outcome_of(status: Column, label: Column, known: Column, strict: bool) -> Column:
    odd = status.isNotNull() & ~kind(status).isin("BIGINT", "VOID")
    why = F.raise_error(F.lit("http status must be an integer or null")) if strict else F.lit(None)
    return F.when(odd, why.cast("string")).otherwise(outcomes.terminal_outcome(integer(status), label, known, strict))


def with_outcome(df: DataFrame, strict: bool = True) -> DataFrame:
    """df with ``outcome`` of its record; what it is judged by is read from the record once. A frame that has it stays."""
    if "outcome" in df.columns:
        return df
    doc = Members(F.col("_m"))
    seen = read(df).withColumns({"_status": member(doc, "http_status", "status_code"), "_label": text(member(doc, "terminal_outcome", "terminal_status")), "_known": known_signature(doc)})
    return seen.select(*df.columns, _outcome_of(F.col("_status"), F.col("_label"), F.col("_known"), strict).alias("outcome"))


def terminal_label(status: Column) -> Column:
    return F.when(status.between(200, 299), "completed").otherwise("http_error")


def failure_label(status: Column, outcome: Column) -> Column:
    """What kind of failure a transport saw, null for none."""
    return F.when(outcome.isin("timeout", "transport_error"), outcome).when(status == 429, "http_429").when(status.between(400, 499), "other_http_4xx").when(status.between(500, 599), "http_5xx")


def model_matches(requested: Column, reported: Column) -> Column:
    """Whether the reported model is the requested one; null where none is reported."""
    return F.when(F.coalesce(reported, F.lit("")) != "", reported == requested)


def adapter_status(docs_status: Column, status: Column, low_sent: Column, exact_model: Column) -> Column:
    """How far a response shows that the adapter's mapping holds."""
    shown = F.coalesce(low_sent & exact_model, F.lit(False))
    ok = status.between(200, 299)
    return F.when(ok & shown & (docs_status == "pending_smoke"), "smoke_validated").when(ok & shown & (docs_status == "documented"), "documented").when(ok, "incompatible").when((docs_status == "pending_smoke") & status.between(400, 499), "unsupported").otherwise("request_failed")


def normalise(units: DataFrame, saved: DataFrame) -> DataFrame:
    """Scheduled units (the IDENTITY columns) with their saved record (request_id, record): identity from the record where it has it, defaults for the rest."""
    joined = units.join(saved, "request_id")
    doc = F.col("record")
    own = {c: F.coalesce(integer(member(doc, c)), F.col(c)) if dict(units.dtypes)[c] in ("int", "bigint") else F.coalesce(text(member(doc, c)), F.col(c)) for c in IDENTITY}
    status = integer(member(doc, "http_status", "status_code"))
    outcome = F.coalesce(text(member(doc, "terminal_outcome")), F.when(status.isNotNull(), terminal_label(status)).otherwise("transport_error"))
    content = F.coalesce(*[text(member(doc, n)) for n in ANSWERS], F.lit(""))
    return joined.select(
        *[own[c].alias(c) for c in IDENTITY], outcome.alias("terminal_outcome"), F.coalesce(F.try_variant_get(doc, "$.stream_events", "array<variant>"), F.array().cast("array<variant>")).alias("stream_events"),
        F.coalesce(text(member(doc, "reconstructed_reasoning")), F.lit("")).alias("reconstructed_reasoning"), F.coalesce(text(member(doc, "reconstructed_answer")), content).alias("reconstructed_answer"), "record",
    )


def delta(event: Column) -> tuple[Column, Column]:
    """(reasoning, answer) of a saved event: an explicit member, even '', before content by class, before the payload's delta."""
    payload = member(event, "redacted_payload", "payload")
    inner = F.try_variant_get(payload, "$.choices[0].delta", "variant")
    class_, content = text(member(event, "classification", "event_type", "kind")), given(member(event, "content"))

    def pick(name: str, classes: tuple[str, ...], in_payload: str) -> Column:
        found = F.coalesce(given(member(event, name)), F.when(class_.isin(*classes), content), given(member(inner, in_payload)))
        return F.coalesce(text(found), F.lit(""))

    return pick("reasoning_content", REASONING_CLASSES, "reasoning_content"), pick("answer_content", ANSWER_CLASSES, "content")


def events_of(saved: DataFrame) -> DataFrame:
    """(request_id, event_index, offset_ms, reasoning, answer) of the events in saved records (request_id, record); an event without an offset raises."""
    rows = saved.select("request_id", F.posexplode(F.try_variant_get("record", "$.stream_events", "array<variant>")).alias("event_index", "e"))
    offset = F.coalesce(number(member(F.col("e"), *OFFSETS), "stream event offset"), F.raise_error(F.lit("stream event without an offset")).cast("double"))
    reasoning, answer = delta(F.col("e"))
    return rows.select("request_id", "event_index", offset.alias("offset_ms"), reasoning.alias("reasoning"), answer.alias("answer"))


TIMES = ("source", "ttfo_ms", "ttfa_ms", "pre_answer_reasoning_tokens", "reasoning_emitted", "e2e_ms", "last_ms", "answer_tokens", "speed", "answer", "reasoning", "complete")


def number_problem(v: Column, name: str) -> Column:
    """Why a value is neither null nor a finite number of at least 0, or NULL."""
    k, n = kind(v), F.try_variant_get(v, "$", "double")
    good = ((k == "BIGINT") | (k == "DOUBLE") | k.startswith("DECIMAL")) & (n >= 0) & ~F.isnan(n) & (n != float("inf"))
    return F.when(given(v).isNotNull() & ~F.coalesce(good, F.lit(False)), F.lit(f"{name} is not a finite non-negative number"))


def count_problem(v: Column, name: str) -> Column:
    """Why a value is neither null nor an integer of at least 0, or NULL."""
    return F.when(given(v).isNotNull() & ~F.coalesce(integer(v) >= 0, F.lit(False)), F.lit(f"{name} is not a non-negative integer"))


def folded_events(saved: DataFrame) -> DataFrame:
    """saved with ``_e``: what the events of each record give, in order of offset, folded within the record.

    A struct of n, problem, answer, reasoning, ttfo, ttfa, last and before (the
    reasoning up to the first answer). Nothing is exploded or shuffled.
    """

    def opened(e: Column, i: Column) -> Column:
        m = Members(e)
        class_, inner = text(member(m, "classification", "event_type", "kind")), F.try_variant_get(member(m, "redacted_payload", "payload"), "$.choices[0].delta", _variants("reasoning_content", "content"))
        return F.struct(i.alias("i"), e.isNotNull().alias("whole"), member(m, *OFFSETS).alias("at"), class_.alias("class"), given(member(m, "content")).alias("content"), inner.alias("inner"), given(member(m, "reasoning_content")).alias("r"), given(member(m, "answer_content")).alias("a"))

    def chosen(e: Column) -> Column:
        pick = lambda n, classes, inside: F.coalesce(e[n], F.when(e["class"].isin(*classes), e["content"]), given(e["inner"][inside]))
        return F.struct(e["i"].alias("i"), e["whole"].alias("whole"), e["at"].alias("at"), pick("r", REASONING_CLASSES, "reasoning_content").alias("r"), pick("a", ANSWER_CLASSES, "content").alias("a"))

    def plain(e: Column) -> Column:
        why = F.coalesce(F.when(~e["whole"], F.lit("stream_events must contain objects")), F.when(given(e["at"]).isNull(), F.lit("stream event without an offset")), number_problem(e["at"], "stream event offset"))
        said = lambda n: F.coalesce(text(e[n]), F.lit(""))
        return F.struct(F.try_variant_get(e["at"], "$", "double").alias("at"), e["i"].alias("i"), said("r").alias("r"), said("a").alias("a"), why.alias("why"))

    # step by step, as an expression within a lambda is evaluated wherever it stands
    rows = read(saved).withColumn("_rows", F.array_sort(F.transform(F.transform(F.transform("_m.stream_events", opened), chosen), plain)))
    has = lambda *names: lambda e: F.greatest(*[F.length(e[n]) for n in names]) > 0 if len(names) > 1 else F.length(e[names[0]]) > 0
    rows = rows.withColumns({"_says": F.filter("_rows", has("a")), "_any": F.filter("_rows", has("a", "r"))})
    first, whole = F.get("_says", F.lit(0)), lambda part, n: F.array_join(F.transform(part, lambda e: e[n]), "")
    before = F.filter("_any", lambda e: (e["at"] < first["at"]) | ((e["at"] == first["at"]) & (e["i"] <= first["i"])))
    found = F.struct(
        F.coalesce(F.size("_rows"), F.lit(0)).alias("n"), F.get(F.filter(F.transform("_rows", lambda e: e["why"]), lambda w: w.isNotNull()), F.lit(0)).alias("problem"), whole("_says", "a").alias("answer"), whole("_any", "r").alias("reasoning"),
        F.when(F.size("_says") > 0, F.get("_any", F.lit(0))["at"]).alias("ttfo"), first["at"].alias("ttfa"), F.when(F.size("_says") > 0, F.element_at("_says", F.greatest(F.size("_says"), F.lit(1)))["at"]).alias("last"), F.when(F.size("_says") > 0, whole(before, "r")).alias("before"),
    )
    return rows.select(*saved.columns, found.alias("_e"))


def with_timing(saved: DataFrame, count_tokens: Callable[[Column], Column], strict: bool = True) -> DataFrame:
    """saved (request_id, record, ...) with TIMES: from the events of each record or, without any, from its saved times.

    Raises, whatever columns are used, where events do not give the saved answer or
    reasoning, a number is none or negative, or the record has no outcome. With
    ``strict`` off nothing raises and ``problem`` says what would have.
    """
    doc, e = Members(F.col("_m")), lambda n: F.col(f"_e.{n}")
    none = ~F.coalesce(e("n") > 0, F.lit(False))
    timed = lambda n: member(below(doc, "timings"), n)
    held = lambda n: F.coalesce(timed(n), member(doc, n))
    counted = lambda n: F.coalesce(member(doc, n), timed(n))
    told = lambda n, got: F.when(F.coalesce(text(member(doc, n)) != e(got), F.lit(False)), F.lit(f"stream events do not give the saved {n}"))
    problem = F.when(none, F.coalesce(*[number_problem(held(n), n) for n in NUMBERS], *[count_problem(counted(n), n) for n in COUNTS])).otherwise(F.coalesce(e("problem"), told("reconstructed_answer", "answer"), told("reconstructed_reasoning", "reasoning")))
    shown = with_outcome(folded_events(read(saved)), strict).withColumn("_outcome", F.col("outcome"))
    problem = F.when(F.col("_outcome").isNull(), F.lit("no outcome")).otherwise(problem)
    shown = guarded(shown, F.concat(problem, F.lit(" in "), F.col("request_id").cast("string"))) if strict else shown.withColumn("problem", problem)
    value = lambda n: F.try_variant_get(held(n), "$", "double")
    given_count = lambda n: integer(counted(n))
    own_text = lambda *names: F.coalesce(text(member(doc, *names)), F.lit(""))
    first, last = F.coalesce(value("first_answer_token_ms"), value("ttfa_ms")), F.coalesce(value("last_answer_token_ms"), value("e2e_latency_ms"))
    shown = shown.withColumns({
        "_none": none, "answer": F.when(none, own_text("reconstructed_answer", "answer")).otherwise(e("answer")), "reasoning": F.when(none, own_text("reconstructed_reasoning")).otherwise(e("reasoning")),
        "_first": F.when(none, first).otherwise(e("ttfa")), "last_ms": F.when(none, last).otherwise(e("last")),
    }).withColumn("_before", F.when(F.col("_none"), F.col("reasoning")).otherwise(e("before")))
    tokens = lambda c: F.when(F.col(c) != "", count_tokens(F.col(c)).cast("bigint"))
    started, ok = F.col("_first").isNotNull(), F.col("_outcome") == "2xx"
    shown = shown.withColumns({"_said": tokens("answer"), "_thought": F.when(started, F.coalesce(tokens("_before"), F.lit(0)))})
    shown = shown.withColumns({
        "answer_tokens": F.when(F.col("_none"), F.coalesce(given_count("visible_answer_token_count"), F.col("_said"))).otherwise(F.coalesce("_said", F.lit(0))),
        "pre_answer_reasoning_tokens": F.when(F.col("_none"), F.coalesce(given_count("pre_answer_reasoning_tokens"), F.col("_thought"))).otherwise(F.col("_thought")),
        "complete": ok & (F.col("answer") != ""),
    })
    speed = output_speed(F.col("answer_tokens"), F.col("_first"), F.col("last_ms"), F.lit(True))
    return shown.select(
        *saved.columns, F.when(F.col("_none"), "persisted_timings").otherwise("stream_events").alias("source"), F.when(started, F.when(F.col("_none"), F.coalesce(value("ttfo_ms"), F.col("_first"))).otherwise(e("ttfo"))).alias("ttfo_ms"), F.col("_first").alias("ttfa_ms"),
        "pre_answer_reasoning_tokens", F.when(started, F.coalesce(F.col("pre_answer_reasoning_tokens") > 0, F.lit(False))).alias("reasoning_emitted"), F.when(F.col("complete"), F.when(F.col("_none"), value("e2e_latency_ms")).otherwise(F.col("last_ms"))).alias("e2e_ms"), "last_ms", "answer_tokens",
        F.when(F.col("complete"), F.when(F.col("_none"), F.coalesce(value("output_tokens_per_second"), speed)).otherwise(speed)).alias("speed"), "answer", "reasoning", "complete", *([] if strict else ["problem"]),
    )


def record_timing(saved: DataFrame, count_tokens: Callable[[Column], Column]) -> DataFrame:
    """(request_id, *TIMES) of saved records (request_id, record); see with_timing."""
    return with_timing(saved.select("request_id", "record"), count_tokens).select("request_id", *TIMES)


def assistant_content(doc: Column | Members) -> Column:
    """The answer of a record: the first present of four members, else the message of its response (NULL where that is no string)."""
    alias = member(doc, *ANSWERS)
    inner = F.try_variant_get(member(doc, "response"), "$.body", "variant")
    body = F.when(is_object(inner), inner).otherwise(member(doc, "response"))
    return F.when(alias.isNotNull(), text(alias)).otherwise(text(F.try_variant_get(body, "$.choices[0].message.content", "variant")))


def aliases_of(v: Column) -> Column:
    """Accepted answers beside the gold as an array of strings: from an array, a single string, or either under ``answer``."""
    inner = F.when(is_object(v), member(v, "answer")).otherwise(v)
    many = F.filter(F.transform(F.try_variant_get(inner, "$", "array<variant>"), text), lambda x: x.isNotNull())
    return F.when(kind(inner) == "STRING", F.array(text(inner))).when(kind(inner).startswith("ARRAY"), many).otherwise(F.array().cast("array<string>"))


JUDGEMENT = ("classification", "error_type", "schema_valid", "correct", "correct_field_count")


def with_evaluation(saved: DataFrame, items: DataFrame, families: tuple[str, str, str], strict: bool = True) -> DataFrame:
    """saved (request_id, item_id, record, ...) with family, outcome and JUDGEMENT, in one pass over records and items.

    ``items`` has item_id, family, gold (canonical JSON) and aliases (array of
    strings); ``families`` names lookup, triage and extraction. A record of another
    family or without a provider raises, whatever columns are used; one whose
    request failed has its error type and no evaluation. Records without an item
    and items of other families are left out. With ``strict`` off a record without
    an outcome counts as failed and does not raise.
    """
    doc = Members(F.col("_m"))
    # what an item wants is read from its gold once, not for each of its answers
    gold = F.try_parse_json("gold")
    held = F.coalesce(text(gold), text(member(gold, "value")), text(member(gold, "answer")))
    wanted = F.when(F.col("family") == families[0], F.concat(F.array(held), F.coalesce("aliases", F.array().cast("array<string>")))).when(F.col("family") == families[1], F.array(text(member(gold, "category")), text(member(gold, "priority")))).otherwise(F.array("gold"))
    joined = read(saved).join(items.where(F.col("family").isin(*families)).select("item_id", "family", wanted.alias("_wanted")), "item_id")
    own, by = text(member(doc, "task_family")), F.coalesce(text(member(doc, "provider")), F.lit(""))
    odd = F.when(~own.eqNullSafe(F.col("family")), "family").when(by == "", "provider")
    rows = guarded(joined, F.concat(F.lit("record with a wrong or missing "), odd, F.lit(": "), F.col("request_id")))
    rows = with_outcome(rows, strict)
    ok = F.col("outcome") == "2xx"
    kind_ = F.when(ok, F.when(F.col("family") == families[0], "lookup").when(F.col("family") == families[1], "triage").otherwise("contract"))
    rows = rows.withColumn("_j", outcomes.judged(kind_, F.when(ok, assistant_content(doc)), F.when(ok, F.col("_wanted"))))
    error = F.create_map(*[F.lit(x) for pair in FAILED.items() for x in pair])
    return rows.select(
        *saved.columns, "family", "outcome", outcomes.classification(F.col("outcome"), F.col("_j.schema_valid"), F.col("_j.correct")).alias("classification"), F.when(ok, F.col("_j.error_type")).otherwise(error[F.col("outcome")]).alias("error_type"), "_j.schema_valid", F.coalesce("_j.correct", F.lit(False)).alias("correct"),
        F.when(ok & (F.col("family") == families[2]), outcomes.field_count(F.col("_j.fields"))).alias("correct_field_count"),
    )


def evaluate_records(items: DataFrame, saved: DataFrame, families: tuple[str, str, str]) -> DataFrame:
    """(request_id, family, outcome, *JUDGEMENT) of saved records; see with_evaluation."""
    return with_evaluation(saved.select("request_id", "item_id", "record"), items, families).select("request_id", "family", "outcome", *JUDGEMENT)


def with_usage(saved: DataFrame, prices: DataFrame) -> DataFrame:
    """saved (provider, record, ...) with tokens_in, tokens_out, cost_usd.

    Token counts are those of ``usage`` by either spelling, both or none. A cost
    that the record holds, null too, is its cost; without the member it is priced
    by ``prices`` (provider, price_in, price_out; per million tokens). Costs and
    prices that are no finite numbers, or prices of 0, raise.
    """
    doc = Members(F.col("_m"))
    usage, cost = below(doc, "usage"), member(doc, "cost_usd")
    count = lambda *names: F.when(integer(member(usage, *names)) >= 0, integer(member(usage, *names)))
    into, out = count("input_tokens", "prompt_tokens"), count("output_tokens", "completion_tokens")
    known = into.isNotNull() & out.isNotNull()
    positive = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    priced = guarded(prices.select("provider", "price_in", "price_out"), F.when(~(positive("price_in") & positive("price_out")), F.concat(F.lit("no price of "), F.col("provider"))))
    rows = guarded(read(saved).join(priced, "provider", "left"), number_problem(cost, "cost_usd"))
    rows = rows.withColumns({"tokens_in": F.when(known, into), "tokens_out": F.when(known, out)})
    paid = F.when(cost.isNotNull(), F.try_variant_get(cost, "$", "double")).otherwise(token_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))
    return rows.select(*saved.columns, "tokens_in", "tokens_out", paid.alias("cost_usd"))


FACT = ("request_id", "round_id", "provider", "item_id", "family", "outcome", *JUDGEMENT, "invalid", *TIMES, "tokens_in", "tokens_out", "cost_usd", "compatible", "artifact_complete")


def record_facts(saved: DataFrame, items: DataFrame, prices: DataFrame, families: tuple[str, str, str], count_tokens: Callable[[Column], Column], watch: Observation | None = None, strict: bool = True) -> DataFrame:
    """The fact frame (FACT) of saved records (request_id, record): times, evaluation, usage, cost and flags of each, ready for ``metrics`` and ``paired``.

    Items and prices are joined; records are neither exploded nor shuffled but for
    those joins. ``watch`` counts records, records that failed, that have the known
    failure signature, saved times in place of events, no usage and no cost, in the
    same pass. With ``strict`` off, for audits, ``problem`` and ``record`` come too
    and records whose times cannot be derived do not raise.
    """
    doc = Members(F.col("_m"))
    own = read(saved).select("request_id", *([] if strict else ["record"]), "_m", text(member(doc, "item_id")).alias("item_id"), F.coalesce(text(member(doc, "round_id")), integer(member(doc, "round_id")).cast("string")).alias("round_id"), text(member(doc, "provider")).alias("provider"))
    rows = with_usage(with_timing(with_evaluation(own, items, families, strict), count_tokens, strict), prices)
    rows = rows.withColumns({"invalid": F.col("classification") == "invalid_result", "compatible": record_compatible(doc), "artifact_complete": artifact_complete(doc)})
    if watch is not None:
        n = lambda c, name: F.count_if(c).alias(name)
        rows = rows.observe(watch, F.count(F.lit(1)).alias("records"), n(F.col("outcome") != "2xx", "failed"), n(known_signature(doc), "normalised_failures"), n(F.col("source") != "stream_events", "saved_times"), n(F.col("tokens_in").isNull(), "without_usage"), n(F.col("cost_usd").isNull(), "without_cost"))
    return rows.select(*FACT, *([] if strict else ["problem", "record"]))


def record_compatible(doc: Column | Members) -> Column:
    """Saved evidence in this order: an explicit flag, the model's identity, the adapter's status, all configuration checks; true without any."""
    explicit = member(doc, "configuration_compatible", "provider_configuration_compatible")
    match = member(below(doc, "model_identity"), "matches")
    checks = doc.at["configuration_checks"] if isinstance(doc, Members) else F.try_variant_get(doc, "$.configuration_checks", "map<string,variant>")
    return (
        F.when(explicit.isNotNull(), is_true(explicit)).when(match.isNotNull() & ~is_true(match), False)
        .when(F.coalesce(text(member(below(doc, "adapter_compatibility"), "status")).isin("unsupported", "request_failed", "incompatible"), F.lit(False)), False)
        .otherwise(F.coalesce(F.forall(F.map_values(checks), is_true), F.lit(True)))
    )


def artifact_complete(doc: Column | Members) -> Column:
    """The first present of three flags, true without one."""
    found = member(doc, "artifact_graph_complete", "local_artifact_graph_complete", "artifact_complete")
    return F.when(found.isNotNull(), is_true(found)).otherwise(True)


def provider_flag(flags: Column, key: str, default: bool) -> Column:
    """A provider's flag from a VARIANT that is a boolean or an object; the default where the provider is not listed."""
    inner = F.coalesce(member(flags, key), member(flags, "complete"), member(flags, "compatible"))
    return F.when(flags.isNull(), F.lit(default)).when(is_object(flags), F.when(inner.isNull(), F.lit(default)).otherwise(is_true(inner))).otherwise(is_true(flags))


def compatibility_evidence(doc: Column, schema_valid: Column) -> Column:
    """A struct of four facts about a terminal record, and whether all hold."""
    facts = {"terminal_record": F.lit(True), "http_2xx": record_outcome(doc) == "2xx", "nonempty_answer_content": F.coalesce(F.trim(assistant_content(doc)) != "", F.lit(False)), "schema_valid": F.coalesce(schema_valid, F.lit(False))}
    all_ = facts["http_2xx"] & facts["nonempty_answer_content"] & facts["schema_valid"]
    return F.struct(*[c.alias(n) for n, c in facts.items()], all_.alias("compatible"))


def configuration_checks(doc: Column, model: Column, ceiling: int = 256) -> Column:
    """Names of the configuration checks that a record fails against its provider's model, in order; a null model is an unknown provider."""
    at = lambda path: F.try_variant_get(doc, f"$.{path}", "variant")
    says = lambda path, value: F.coalesce(text(at(path)) == value, F.lit(False))
    equals = lambda path, value: F.coalesce((kind(at(path)) != "BOOLEAN") & (F.try_variant_get(at(path), "$", "double") == float(value)), F.lit(False))
    status, outcome = integer(member(doc, "http_status", "status_code")), given(member(doc, "terminal_outcome"))
    answered = F.coalesce((text(outcome) == "completed") & status.between(200, 299), F.lit(False)) | (outcome.isNull() & is_object(at("model_identity")) & (F.size(F.map_keys(F.try_variant_get(at("model_identity"), "$", "map<string,variant>"))) > 0))
    same = says("model_identity.requested", model) & says("model_identity.reported", model) & is_true(at("model_identity.matches"))
    pending = says("adapter_metadata.reasoning_docs_status", "pending_smoke")
    shown = says("adapter_compatibility.status", "smoke_validated") & is_true(at("adapter_compatibility.exact_low_reasoning_evidenced"))
    json_only = F.coalesce(F.to_json(at("request.body.response_format")) == '{"type":"json_object"}', F.lit(False))
    checks = {
        "provider_model_matches_spec": says("provider_model", model), "request_model_matches_spec": says("request.body.model", model), "reported_model_matches_intended": ~answered | same, "adapter_model_matches_spec": says("adapter_metadata.model_key", model),
        "protocol_matches": says("adapter_metadata.protocol", "openai-chat-completions"), "endpoint_class_matches": says("adapter_metadata.endpoint_class", "serverless_or_shared"), "streaming_matches": is_true(at("adapter_metadata.streaming")) & is_true(at("request.body.stream")),
        "structured_output_matches": says("adapter_metadata.structured_output_mode", "json_object") & says("adapter_metadata.schema_enforcement", "local_strict") & json_only, "single_attempt_matches": equals("adapter_metadata.max_attempts", 1),
        "sampling_matches": equals("request.body.temperature", 0) & equals("request.body.top_p", 1) & equals("request.body.presence_penalty", 0) & equals("request.body.frequency_penalty", 0),
        "completion_ceiling_matches": equals("request.body.max_completion_tokens", ceiling) | equals("request.body.max_tokens", ceiling),
        "low_reasoning_mapped": says("adapter_metadata.reasoning_effort", "low") & says("adapter_metadata.reasoning_wire_mapping.reasoning_effort", "low") & says("request.body.reasoning_effort", "low"),
        "pending_low_reasoning_genuinely_evidenced": ~pending | ~answered | shown, "low_reasoning_documented": pending | says("adapter_metadata.reasoning_docs_status", "documented"),
    }
    return F.when(model.isNull(), F.array(F.lit("unknown provider"))).otherwise(outcomes.failed_checks(checks))


def event_channels(event: Column | Members) -> Column:
    """What of a saved event is judged by channel_error."""
    reasoning, answer = F.coalesce(text(member(event, "reasoning_content")), F.lit("")), F.coalesce(text(member(event, "answer_content")), F.lit(""))
    presence = below(event, "content_presence")
    whole = presence.at.isNotNull() if isinstance(presence, Members) else is_object(presence)
    boolean = lambda n: F.when(kind(member(presence, n)) == "BOOLEAN", F.try_variant_get(member(presence, n), "$", "boolean"))
    inner = F.try_variant_get(member(event, "redacted_payload", "payload"), "$.choices[0].delta", _variants("reasoning_content", "reasoning", "reasoning_details", "content"))
    return F.struct((reasoning != "").alias("thinks"), (answer != "").alias("says"), whole.alias("whole"), boolean("reasoning").alias("r"), boolean("answer").alias("a"), text(member(event, "classification")).alias("class"), inner.alias("inner"))


def channel_error(e: Column) -> Column:
    """Why the presence flags, class, channels and payload of event_channels contradict each other, or NULL."""
    thinks, says, class_, inner = e["thinks"], e["says"], e["class"], e["inner"]
    due = F.when(thinks & says, "reasoning_and_answer").when(thinks, "reasoning").when(says, "answer")
    full = lambda v: F.coalesce((text(v) != "") | (kind(v).startswith("ARRAY") & (F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)) | (kind(v).startswith("OBJECT") & (F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))) > 0)), F.lit(False))
    payload_thinks = full(inner["reasoning_content"]) | full(inner["reasoning"]) | full(inner["reasoning_details"])
    payload_says = F.coalesce(text(inner["content"]) != "", F.lit(False))
    return (
        F.when(~e["whole"], "missing content_presence").when(~e["r"].eqNullSafe(thinks) | ~e["a"].eqNullSafe(says), "content_presence does not match distinct channel fields")
        .when(due.isNotNull() & ~class_.eqNullSafe(due), "content-bearing event is misclassified").when((class_ == "reasoning_and_answer") & ~(thinks & says), "combined event does not preserve both explicit channels")
        .when(inner.isNotNull() & ((payload_thinks != thinks) | (payload_says != says)), "payload channels were conflated or dropped")
    )


def event_channel_error(event: Column | Members) -> Column:
    """Why a saved event's presence flags, class, channels and payload contradict each other, or NULL."""
    return channel_error(event_channels(event))
