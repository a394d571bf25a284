"""Whole runs: dataset and gold checks, provider roll-ups, audits, acceptance, manifests and locks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.functions.jsonstrict import canonical, iso_date
from pairlens.operators import outcomes
from pairlens.operators.records import integer, is_object, kind, known_signature, member, text
from pairlens.operators.reconcile import differences

REQUIRED = ("id", "use_case", "split", "prompt", "output_schema", "gold", "aliases", "tokens")
RUN_ID = r"^run-\d{8}-\d{6}$"


def load_spec(path: str) -> dict:
    """A YAML or JSON run specification with a slug, families, providers and prices; what is missing or no mapping raises."""
    with open(path, encoding="utf-8") as f:
        raw = f.read()
    try:
        spec = json.loads(raw)
    except ValueError:
        import yaml  # optional: only YAML needs it

        spec = yaml.safe_load(raw)
    if not isinstance(spec, dict):
        raise ValueError(f"{path}: no mapping")
    lacking = [k for k in ("benchmark_slug", "task_families", "providers", "pricing") if not spec.get(k)]
    unpriced = [p for p in spec.get("providers") or [] if p not in (spec.get("pricing") or {})]
    if lacking or unpriced:
        raise ValueError(f"{path}: missing {', '.join(lacking + [f'price of {p}' for p in unpriced])}")
    return spec


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of JSON-lines files, which are read whole; a last empty line is none."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "\\n\\z", "").alias("value"))
    return files.select("file", F.posexplode(F.split("value", "\\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def _named(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that does not hold."""
    out = None
    for name, holds in checks:
        bad = ~F.coalesce(holds, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def _keys(v: Column) -> Column:
    return F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))


def gold_problem(family: Column, gold: Column, aliases: Column, families: tuple[str, str, str]) -> Column:
    """What is wrong with an item's gold for its family (lookup, triage, extraction), or NULL."""
    keys = _keys(gold)
    exactly = lambda *names: keys == F.array(*[F.lit(n) for n in sorted(names)])
    of = lambda n: member(gold, n)
    texts = F.coalesce(F.forall(F.try_variant_get(aliases, "$", "array<variant>"), lambda a: F.coalesce(kind(a) == "STRING", F.lit(False))), F.lit(False))
    terms = []
    for name, form in outcomes.CONTRACT_FIELDS.items():
        v = of(name)
        k = kind(v)
        good = {"string": text(v).isin(*outcomes.AGREEMENTS), "date": iso_date(text(v)), "boolean": k == "BOOLEAN", "integer?": k.isin("BIGINT", "VOID")}[form]
        terms.append((f"gold {name}", good))
    by = {
        families[0]: _named(("gold is no object", is_object(gold)), ("gold fields", exactly("type", "value")), ("gold value", kind(of("value")) == "STRING"), ("aliases", texts)),
        families[1]: _named(("gold is no object", is_object(gold)), ("gold fields", exactly("category", "priority")), ("gold category", text(of("category")).isin(*outcomes.CATEGORIES)), ("gold priority", text(of("priority")).isin(*outcomes.PRIORITIES))),
        families[2]: _named(("gold is no object", is_object(gold)), ("gold fields", exactly(*outcomes.CONTRACT_FIELDS)), *terms),
    }
    out = F.when(family == families[0], by[families[0]])
    for f in families[1:]:
        out = out.when(family == f, by[f])
    return out.otherwise("unknown family")


def item_problems(lines: DataFrame, spec: DataFrame, families: tuple[str, str, str]) -> DataFrame:
    """(file, line_no, id, problem): every line of read_items that is no valid item, with what is wrong first.

    ``spec`` has a row a family: family, template (system prompt), schema (map of
    field kinds), low and high (band of input tokens), token_field. The family is
    the file's name without its ending. An id that stands twice is a problem of
    all its lines but the first, by file and line. The gold of extraction items has
    its fields in one order, which is read from the line, as VARIANT does not keep it.
    """
    row = F.try_parse_json("line")
    rows = lines.withColumn("row", row).withColumn("family", F.regexp_replace("file", "\\.jsonl$", "")).join(spec, "family", "left")
    doc = F.col("row")
    rows = rows.withColumn("id", text(member(doc, "id")))
    place = F.struct("file", "line_no")
    twice = rows.where("id is not null").groupBy("id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    in_order = F.expr("json_object_keys(get_json_object(line, '$.gold'))") == F.array(*[F.lit(c) for c in outcomes.CONTRACT_FIELDS])
    prompt, tokens = member(doc, "prompt"), F.try_variant_get(doc, "$.tokens", "map<string,variant>")
    count = integer(F.element_at(tokens, F.col("token_field")))
    schema = F.try_variant_get(doc, "$.output_schema", "map<string,string>")
    sorted_ = lambda m: F.array_sort(F.map_entries(m))
    problem = _named(
        ("invalid JSON", doc.isNotNull()), ("missing fields", is_object(doc) & (F.size(F.array_except(F.array(*[F.lit(r) for r in REQUIRED]), _keys(doc))) == 0)), ("id", F.coalesce("id", F.lit("")) != ""), ("repeated id", F.col("first").isNull() | (F.col("first") == place)),
        ("family or split", (text(member(doc, "use_case")) == F.col("family")) & (text(member(doc, "split")) == "private")), ("prompt", (_keys(prompt) == F.array(F.lit("system"), F.lit("user"))) & (text(member(prompt, "system")) == F.col("template")) & (text(member(prompt, "user")) != "")),
        ("output schema", sorted_(schema) == sorted_(F.col("schema"))), ("gold", gold_problem(F.col("family"), member(doc, "gold"), member(doc, "aliases"), families).isNull()), ("gold order", (F.col("family") != families[2]) | in_order), ("input token band", count.between(F.col("low"), F.col("high"))),
    )
    return rows.join(twice, "id", "left").select("file", "line_no", "id", problem.alias("problem")).where("problem is not null")


def item_counts(lines: DataFrame, expected: DataFrame, total: int) -> DataFrame:
    """(family, expected, found) of every family, and of all ids together under the family NULL, where the two numbers differ.

    ``lines`` is read_items'; ``expected`` has a row a family: family and items. A
    line counts for the family its file is named after, whatever is in it; the
    total is of different ids. A family that is not expected is expected to have 0.
    """
    rows = lines.select(F.regexp_replace("file", "\\.jsonl$", "").alias("family"), text(member(F.try_parse_json("line"), "id")).alias("id"))
    each = expected.select("family", F.col("items").cast("long").alias("expected")).join(rows.groupBy("family").agg(F.count(F.lit(1)).alias("found")), "family", "full_outer").fillna(0, ["expected", "found"])
    whole = rows.agg(F.count_distinct("id").alias("found")).select(F.lit(None).cast("string").alias("family"), F.lit(total).cast("long").alias("expected"), "found")
    return each.select("family", "expected", "found").union(whole).where("expected <> found")


def manifest_problem(doc: Column, counts: dict[str, int]) -> Column:
    """What is wrong with a dataset manifest for the expected private items by family, or NULL."""
    uses = member(doc, "use_cases")
    right = [(f"count of {f}", integer(F.try_variant_get(uses, f"$['{f}'].private_items", "variant")) == n) for f, n in counts.items()]
    return _named(("not frozen", text(member(doc, "status")) == "frozen"), ("not ready", F.try_variant_get(doc, "$.freeze_ready", "boolean")), ("families", _keys(uses) == F.array(*[F.lit(f) for f in sorted(counts)])), *right)


def provider_compatibility(records: DataFrame, providers: DataFrame, expected: int, failed: Column) -> DataFrame:
    """(provider, compatible, records, expected_records, evidence_records, normalised_failures, reasons) of every provider.

    ``failed`` is a record's array of failed configuration checks. Records with the
    known failure signature give no evidence; a provider is compatible if it has
    all expected records, some evidence, and no failed check.
    """
    known = known_signature(F.col("record"))
    rows = records.select("provider", known.alias("known"), F.when(~known, failed).alias("failed"))
    per = rows.groupBy("provider").agg(F.count(F.lit(1)).alias("records"), F.count_if(~F.col("known")).alias("evidence_records"), F.count_if("known").alias("normalised_failures"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("failed")))).alias("reasons"))
    out = providers.select("provider").join(per, "provider", "left").fillna(0, ["records", "evidence_records", "normalised_failures"]).withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))
    ok = (F.col("records") == expected) & (F.col("evidence_records") > 0) & (F.size("reasons") == 0)
    return out.select("provider", ok.alias("compatible"), "records", F.lit(expected).alias("expected_records"), "evidence_records", "normalised_failures", "reasons")


def artifact_completeness(records: DataFrame, evaluations: DataFrame, providers: DataFrame, expected: int) -> DataFrame:
    """(provider, records, evaluations, complete): complete with the expected number of both."""
    n = lambda df, name: df.groupBy("provider").agg(F.count(F.lit(1)).alias(name))
    out = providers.select("provider").join(n(records, "records"), "provider", "left").join(n(evaluations, "evaluations"), "provider", "left").fillna(0)
    return out.withColumn("complete", (F.col("records") == expected) & (F.col("evaluations") == expected))


def audit(pairs: dict[str, tuple[DataFrame, DataFrame, list[str], list[str]]], channels: DataFrame | None = None) -> DataFrame:
    """(part, key, column, saved, recomputed): every value that a saved frame and its recomputation do not share.

    ``pairs`` names parts (evaluations, timings, metrics, paired) with saved rows,
    recomputed rows, keys and columns. ``channels`` has request_id, event_index and
    problem of the events with contradictory channels.
    """
    out = None
    for part, (saved, now, keys, columns) in pairs.items():
        found = differences(saved, now, keys, columns).select(F.lit(part).alias("part"), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"), "column", "saved", "recomputed")
        out = found if out is None else out.union(found)
    if channels is not None:
        rows = channels.select(F.lit("channels").alias("part"), F.concat_ws("|", "request_id", F.col("event_index").cast("string")).alias("key"), F.lit("channel").alias("column"), F.col("problem").alias("saved"), F.lit(None).cast("string").alias("recomputed"))
        out = rows if out is None else out.union(rows)
    return out


PARTS = {"stream_events_reconstruct_final_answers": "reconstruction", "evaluations_recompute_from_raw_results": "evaluations", "timing_metrics_recompute_from_raw_stream_events": "timings", "aggregate_metrics_recompute_exactly": "metrics", "paired_comparisons_recompute_exactly": "paired", "every_observed_reasoning_stream_is_timed_separately_from_answer_content": "channels"}


def _found(violations: DataFrame, parts: Iterable[str]) -> DataFrame:
    """A condition for each part: it was audited and nothing was found."""
    looked = frozenset(parts)
    return violations.agg(*[((F.count_if(F.col("part") == p) == 0) & F.lit(p in looked)).alias(c) for c, p in PARTS.items()])


def smoke_acceptance(records: DataFrame, expected: DataFrame, compatibility: DataFrame, violations: DataFrame, requests: int, parts: Iterable[str]) -> DataFrame:
    """One row: three counters that must be 0, twelve conditions, and ``accepted``.

    ``records`` has provider, family, terminal_outcome, status, answer and
    schema_valid; ``expected`` has each (provider, family) that must stand in them;
    ``parts`` are those that ``violations`` come from: a part that is missing fails.
    """
    pair = records.groupBy("provider", "family").agg(
        F.bool_or(F.coalesce(F.col("terminal_outcome") == "completed", F.lit(False))).alias("done"), F.bool_or(F.coalesce(F.col("status").between(200, 299), F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.trim("answer") != "", F.lit(False))).alias("said"),
    )
    each = expected.join(pair, ["provider", "family"], "left")
    all_ = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False))
    by_pair = each.agg(all_("done").alias("every_provider_completes_at_least_one_request_per_task_family"), all_("good").alias("every_provider_returns_http_2xx_per_task_family"), all_("said").alias("every_provider_returns_nonempty_answer_content_per_task_family"))
    rows = records.agg(
        F.count_if(F.col("terminal_outcome") == "runner_error").alias("runner_errors"), F.lit(0).alias("local_artifact_errors"), F.lit(0).alias("database_writes"), (F.count(F.lit(1)) == requests).alias("raw_result_count_matches_submitted_request_count"),
        ((F.count(F.lit(1)) == requests) & all_("schema_valid")).alias("every_provider_returns_schema_valid_result_per_task_family"),
    )
    fits = compatibility.agg(all_("compatible").alias("every_provider_uses_intended_model_and_compatible_configuration"))
    out = rows.crossJoin(F.broadcast(by_pair)).crossJoin(F.broadcast(fits)).crossJoin(F.broadcast(_found(violations, parts)))
    good = (F.col("runner_errors") == 0) & (F.col("local_artifact_errors") == 0) & (F.col("database_writes") == 0)
    for c, k in out.dtypes:
        good = good & F.col(c) if k == "boolean" else good
    return out.withColumn("accepted", good)


def full_success(scheduled: DataFrame, completeness: DataFrame, compatibility: DataFrame, violations: DataFrame, parts: Iterable[str]) -> DataFrame:
    """One row: whether all units are recorded and evaluated, all providers compatible, and nothing violated, part by part and together.

    ``scheduled`` has recorded and evaluated, two booleans, for each unit; ``parts``
    are those that ``violations`` come from: a part that is missing fails.
    """
    whole = scheduled.agg(F.coalesce(F.bool_and(F.col("recorded") & F.col("evaluated")), F.lit(True)).alias("all")).crossJoin(F.broadcast(completeness.agg(F.bool_and("complete").alias("complete"))))
    out = whole.select((F.col("all") & F.col("complete")).alias("artifact_graph_complete")).crossJoin(F.broadcast(compatibility.agg(F.bool_and("compatible").alias("provider_configuration_compatible")))).crossJoin(F.broadcast(_found(violations, parts)))
    good = F.lit(True)
    for c in out.columns:
        good = good & F.col(c)
    return out.withColumn("success", good)


def manifest(records: DataFrame, evaluations: DataFrame, rounds: int, requests: int) -> DataFrame:
    """One row: expected and recorded counts, classes of evaluations, and the wall-clock period as the first start and last end by text."""
    r = records.agg(F.lit(rounds).alias("expected_rounds"), F.lit(requests).alias("expected_requests"), F.count(F.lit(1)).alias("raw_records"), F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"))
    c = lambda name: F.count_if(F.col("classification") == name)
    e = evaluations.agg(F.count(F.lit(1)).alias("evaluation_records"), (c("valid_result") + c("incorrect_result")).alias("valid_records"), c("invalid_result").alias("invalid_records"), c("failed_request").alias("failed_records"))
    return r.crossJoin(F.broadcast(e))


def attempt_summary(records: DataFrame, log: DataFrame, kind_name: str = "external_call_started") -> DataFrame:
    """(attempt, finished, failed, calls) by attempt: terminal records and log events of one kind."""
    done = records.groupBy("attempt").agg(F.count(F.lit(1)).alias("finished"), F.count_if(~F.col("outcome").eqNullSafe(F.lit("2xx"))).alias("failed"))
    calls = log.groupBy("attempt").agg(F.count_if(F.col("kind") == kind_name).alias("calls"))
    return done.join(calls, "attempt", "full_outer").fillna(0, ["finished", "failed", "calls"])


def with_prior(prior: DataFrame, new: DataFrame, key: str = "request_id") -> DataFrame:
    """Prior and new records, each key once: new ones are saved before they are merged, so they can stand in both."""
    return prior.unionByName(new, allowMissingColumns=True).dropDuplicates([key])


def with_round_skew(records: DataFrame, skew: DataFrame) -> DataFrame:
    """Records with the launch skew of their round, null where it is not known."""
    return records.join(skew.select("round_id", F.col("skew_ms").alias("round_launch_skew_ms")), "round_id", "left")


def run_id(taken: set[str], now: datetime) -> str:
    """The first free run id at ``now`` or so many seconds later."""
    while (name := f"run-{now:%Y%m%d-%H%M%S}") in taken:
        now += timedelta(seconds=1)
    return name


def is_run_id(name: str) -> bool:
    return re.fullmatch(RUN_ID[1:-1], name) is not None


def digest(value, size: int = 64) -> str:
    """SHA-256 of canonical JSON, or the first characters of it."""
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:size]


def lock_changes(saved: dict | None, now: dict, ignore: tuple[str, ...] = ("created_at",)) -> list[str]:
    """Members in which two run locks differ, by name; none against no lock."""
    return [] if saved is None else sorted(k for k in {*saved, *now} if k not in ignore and digest(saved.get(k)) != digest(now.get(k)))


def may_start(state: dict, attempt: int | None) -> str | None:
    """Why an attempt (1 or 2), or with None the full run, may not start, or None."""
    if state.get("full_run") == "complete":
        return "the run is finished"
    done = state.get("attempts", {})
    if attempt is None:
        return None if state.get("full_run_authorized") and any(done.values()) else "no accepted attempt or no approval"
    if attempt not in (1, 2) or attempt in done or (attempt == 2 and done.get(1) is not False):
        return "the attempt is not due"
    return None
