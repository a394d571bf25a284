"""Strict JSON, canonical JSON, Unicode answer normalisation, redaction and token counts, as Arrow-batched UDFs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A type, not its text: executors import this module before they have a session.
STRICT = T.StructType(
    [
        T.StructField("ok", T.BooleanType()), T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType()),
        T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("kinds", T.MapType(T.StringType(), T.StringType())),
        T.StructField("values", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _unique(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("repeated key")
    return found


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON number")


def parse_strict(text: str):
    """One JSON value, nothing but JSON white space around it, no repeated keys, no NaN or Infinity."""
    if text is None:
        raise ValueError("no text")
    return json.loads(text.strip(" \t\n\r"), object_pairs_hook=_unique, parse_constant=_no_constant)


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(value)]


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(STRICT)
def strict_json(texts: pd.Series) -> pd.DataFrame:
    """ok is false where the text is not exactly one JSON value; integer kinds read ``integer``. keys, kinds and values (canonical JSON) are those of an object's members."""
    rows = []
    for t in texts:
        try:
            v = parse_strict(t)
        except (ValueError, RecursionError):
            rows.append((False, None, None, None, None, None))
            continue
        members = v if isinstance(v, dict) else {}
        rows.append((True, kind_of(v), canonical(v), sorted(members), {k: "integer" if kind_of(x) == "number" and isinstance(x, int) else kind_of(x) for k, x in members.items()}, {k: canonical(x) for k, x in members.items()}))
    return pd.DataFrame(rows, columns=["ok", "kind", "canonical", "keys", "kinds", "values"])


@F.pandas_udf(T.StringType())
def normalize_answer(texts: pd.Series) -> pd.Series:
    """White space collapsed by Unicode rules, then case-folded."""
    return texts.map(lambda t: None if t is None else " ".join(t.split()).casefold())


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, UTF-8 kept; null where the text is not strict JSON."""

    def one(t):
        try:
            return canonical(parse_strict(t))
        except (ValueError, RecursionError):
            return None

    return texts.map(one)


SECRET_KEYS = ("authorization", "api_key", "apikey", "x-api-key", "cookie", "set-cookie")


def redact(secrets: list[str], keys: tuple[str, ...] = SECRET_KEYS) -> Callable[[Column], Column]:
    """A function of a JSON text column: values of the keys at any depth, and the secrets in any string, become [REDACTED]."""
    named = frozenset(k.lower() for k in keys)
    found = re.compile("|".join(re.escape(s) for s in sorted(secrets, key=len, reverse=True))) if secrets else None

    def walk(v):
        if isinstance(v, dict):
            return {k: "[REDACTED]" if k.lower() in named else walk(x) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x) for x in v]
        return found.sub("[REDACTED]", v) if found and isinstance(v, str) else v

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else canonical(walk(json.loads(t)))
            except ValueError:
                return found.sub("[REDACTED]", t) if found else t

        return texts.map(one)

    return run


_token_counters: dict[str, Callable] = {}


def token_count(encoding: str | None = None) -> Callable[[Column], Column]:
    """Token counts: words and marks by pattern without an encoding, else a tiktoken encoding whose vocabulary is at hand."""
    if encoding is None:
        return lambda c: F.regexp_count(c, F.lit("\\w+|[^\\w\\s]"))

    @F.pandas_udf(T.IntegerType())
    def run(texts: pd.Series) -> pd.Series:
        if encoding not in _token_counters:
            import tiktoken

            _token_counters[encoding] = tiktoken.get_encoding(encoding).encode_ordinary
        return texts.map(lambda t: None if t is None else len(_token_counters[encoding](t)))

    return run


def iso_date(c: Column) -> Column:
    """Whether a text is a real date written as exactly YYYY-MM-DD, years 0001 to 9999."""
    return F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.length(c) == 10) & F.try_to_date(c, "yyyy-MM-dd").isNotNull() & (c >= "0001"), F.lit(False))


def is_iso_date(text: str) -> bool:
    """iso_date of a Python string."""
    if re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", text) is None:
        return False
    try:
        return date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False
