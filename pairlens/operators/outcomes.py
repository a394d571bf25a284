"""Terminal outcomes, filters, evaluations and contract checks on record frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.functions.jsonstrict import canonical, is_iso_date, kind_of, parse_strict

OUTCOMES = ("2xx", "429", "other_4xx", "5xx", "timeout", "transport_error")
#: Names fixed by the result contract.
CATEGORIES = ("bug", "feature", "improvement", "customer_support")
PRIORITIES = ("p0", "p1", "p2", "p3")
AGREEMENTS = ("saas_subscription", "software_license", "support_maintenance", "technology_services")
CONTRACT_FIELDS = {
    "agreement_type": "string", "effective_date": "date", "initial_term_end_date": "date", "auto_renews": "boolean", "renewal_term_months": "integer?",
    "non_renewal_notice_days": "integer?", "payment_terms_days": "integer?", "termination_for_convenience": "boolean", "termination_notice_days": "integer?", "security_incident_notice_hours": "integer?",
}


def terminal_outcome(status: Column, label: Column, known: Column | None = None, strict: bool = True) -> Column:
    """One of OUTCOMES from an HTTP status and a terminal label.

    A record with the ``known`` failure signature is a transport error, whatever
    its label. Then labels that invalidate a run raise, timeouts and transport
    errors come before the status, and labels that stand for a status come last.
    A status outside 2xx, 4xx and 5xx, an HTTP error with status 2xx or none, and
    a record without either raise, or with ``strict`` off are NULL.
    """
    wrong = lambda *parts: F.raise_error(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])).cast("string") if strict else F.lit(None).cast("string")
    start = F.when(F.coalesce(known, F.lit(False)), "transport_error") if known is not None else F.when(F.lit(False), "")
    found = start.when(label.isin("runner_error", "evaluator_error"), wrong("run-invalidating terminal outcome ", label)).when(label.isin("timeout", "timed_out"), "timeout").when(label.isin("transport_error", "transport-error"), "transport_error")
    found = found.when(status.between(200, 299) & (label == "http_error"), wrong("an HTTP error with a status of success")).when(status.between(200, 299), "2xx").when(status == 429, "429").when(status.between(400, 499), "other_4xx").when(status.between(500, 599), "5xx")
    found = found.when(status.isNotNull(), wrong("no outcome for status ", status.cast("string")))
    for name, outcome in {"http_2xx": "2xx", "http_429": "429", "http_other_4xx": "other_4xx", "http_5xx": "5xx", "completed": "2xx"}.items():
        found = found.when(label == name, outcome)
    return found.otherwise(wrong("a terminal record without an outcome"))


def failures(records: DataFrame, outcome: str = "outcome", good: str = "2xx") -> DataFrame:
    """Records that did not complete; an unknown outcome is a failure."""
    return records.where(~F.col(outcome).eqNullSafe(F.lit(good)))


def event_class(reasoning: Column, answer: Column, usage: Column, finish: Column, keys: Column, has_delta: Column) -> Column:
    """Class of a stream event from what its payload carries."""
    r, a = F.coalesce(reasoning, F.lit("")) != "", F.coalesce(answer, F.lit("")) != ""
    return F.when(r & a, "reasoning_and_answer").when(r, "reasoning").when(a, "answer").when(usage, "usage").when(finish.isNotNull(), "finish").when((F.size(keys) == 1) & (F.get(keys, 0) == "role"), "role").when(has_delta, "empty_delta").otherwise("metadata")


def rate_limit_headers(headers: Column) -> Column:
    """Entries of a header map that tell of rate limits."""
    low = lambda k: F.lower(k)
    return F.map_filter(headers, lambda k, v: (low(k) == "retry-after") | low(k).contains("ratelimit") | low(k).contains("rate-limit") | low(k).contains("quota"))


def failed_checks(checks: dict[str, Column]) -> Column:
    """Names of the checks that are not true, in the order given."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())


JUDGED = T.StructType([T.StructField("schema_valid", T.BooleanType()), T.StructField("correct", T.BooleanType()), T.StructField("error_type", T.StringType()), T.StructField("fields", T.ArrayType(T.BooleanType()))])


def _folded(text: str) -> str:
    return " ".join(text.split()).casefold()


def _lookup(value, wanted: list) -> tuple:
    if not isinstance(value, dict):
        return False, False, "schema_invalid", None
    if "answer" not in value:
        return False, False, "missing_required_field", None
    if len(value) > 1 or not isinstance(value["answer"], str):
        return False, False, "schema_invalid", None
    return True, _folded(value["answer"]) in {_folded(w) for w in wanted if w is not None}, None, None


def _triage(value, wanted: list) -> tuple:
    if not isinstance(value, dict):
        return False, False, "schema_invalid", None
    if not {"category", "priority"} <= value.keys():
        return False, False, "missing_required_field", None
    said = [value["category"], value["priority"]]
    if len(value) > 2 or said[0] not in CATEGORIES or said[1] not in PRIORITIES:
        return False, False, "schema_invalid", None
    return True, said == list(wanted), None, None


def _is(value, form: str) -> bool:
    kind = kind_of(value)
    if form == "string":
        return kind == "string" and value in AGREEMENTS
    if form == "date":
        return kind == "string" and is_iso_date(value)
    if form == "boolean":
        return kind == "boolean"
    return isinstance(value, int) and kind == "number" or kind == "null" and form.endswith("?")


def _same(a, b) -> bool:
    """Of one kind, where all numbers are one, and equal."""
    kind = kind_of(a)
    if kind != kind_of(b):
        return False
    if kind == "number":
        return type(a) is type(b) and a == b or float(a) == float(b)
    return canonical(a) == canonical(b) if kind in ("array", "object") else a == b


def _contract(value, wanted: list, golds: dict) -> tuple:
    gold = golds.get(wanted[0])
    if gold is None:
        try:
            gold = parse_strict(wanted[0])
        except (ValueError, RecursionError):
            gold = {}
        if len(golds) >= 4096:
            golds.clear()
        golds[wanted[0]] = gold = gold if isinstance(gold, dict) else {}
    if not isinstance(value, dict):
        return False, False, "schema_invalid", [False] * len(CONTRACT_FIELDS)
    fields = [n in value and n in gold and _same(value[n], gold[n]) for n in CONTRACT_FIELDS]
    if not CONTRACT_FIELDS.keys() <= value.keys():
        return False, False, "missing_required_field", fields
    valid = len(value) == len(CONTRACT_FIELDS) and all(_is(value[n], form) for n, form in CONTRACT_FIELDS.items())
    return valid, valid and all(fields), None if valid else "schema_invalid", fields


@F.pandas_udf(JUDGED)
def judged(kinds: pd.Series, texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    """One answer against what its kind wants: ``lookup`` accepted answers, ``triage`` category and priority, ``contract`` the gold as JSON. Each text is parsed once, a gold once for all its answers; null for other kinds."""
    golds: dict = {}
    rows = []
    for kind, t, w in zip(kinds, texts, wanted, strict=True):
        if kind is None:
            rows.append((None, None, None, None))
            continue
        try:
            value = parse_strict(t)
        except (ValueError, RecursionError):
            rows.append((False, False, "malformed_json", [False] * len(CONTRACT_FIELDS) if kind == "contract" else None))
            continue
        w = [] if w is None else w
        rows.append(_lookup(value, w) if kind == "lookup" else _triage(value, w) if kind == "triage" else _contract(value, w, golds))
    return pd.DataFrame(rows, columns=["schema_valid", "correct", "error_type", "fields"])


def field_count(fields: Column) -> Column:
    return F.size(F.filter(fields, lambda x: x))


def evaluate_lookup(answers: DataFrame, text: str, accepted: str) -> DataFrame:
    """Adds schema_valid, correct, error_type: an object of one string ``answer`` that matches an accepted one, white space and case aside."""
    kept = [F.col(f"`{c}`") for c in answers.columns if c != accepted]
    return answers.withColumn("_j", judged(F.lit("lookup"), F.col(text), F.col(accepted))).select(*kept, "_j.schema_valid", "_j.correct", "_j.error_type")


def evaluate_ticket(answers: DataFrame, text: str, category: str, priority: str) -> DataFrame:
    """Adds schema_valid, correct, error_type for an object of exactly category and priority from their lists."""
    found = answers.withColumn("_j", judged(F.lit("triage"), F.col(text), F.array(category, priority)))
    return found.select(*answers.columns, "_j.schema_valid", "_j.correct", "_j.error_type")


def evaluate_contract(answers: DataFrame, text: str, gold: str) -> DataFrame:
    """Adds field_correct, correct_field_count, schema_valid, correct, error_type; gold is JSON of the ten fields.

    Fields are compared even where the schema is invalid: of one kind (numbers are
    one kind) and equal.
    """
    found = answers.withColumn("_j", judged(F.lit("contract"), F.col(text), F.array(gold)))
    names = F.array(*[F.lit(n) for n in CONTRACT_FIELDS])
    return found.select(*answers.columns, F.map_from_arrays(names, "_j.fields").alias("field_correct"), field_count(F.col("_j.fields")).alias("correct_field_count"), "_j.schema_valid", "_j.correct", "_j.error_type")


def classification(outcome: Column, schema_valid: Column, correct: Column) -> Column:
    """valid_result, incorrect_result, invalid_result or failed_request."""
    return F.when(~outcome.eqNullSafe(F.lit("2xx")), "failed_request").when(~F.coalesce(schema_valid, F.lit(False)), "invalid_result").when(F.coalesce(correct, F.lit(False)), "valid_result").otherwise("incorrect_result")
