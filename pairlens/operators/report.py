"""Run checks and the Markdown report, from small aggregated frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The metric columns of a report: percentiles of five measures and eight rates.
METRICS = [f"{m}_{p}" for m in ("ttfo_ms", "ttfa_ms", "pre_answer_reasoning_tokens") for p in ("p50", "p95", "p99")] + ["reasoning_emission_rate"] + [f"{m}_{p}" for m in ("e2e_ms", "speed") for p in ("p50", "p95", "p99")]
METRICS += ["success_rate", "failure_rate", "timeout_rate", "http_429_rate", "other_http_4xx_rate", "http_5xx_rate", "transport_error_rate"]
COLUMNS = {"provider": "Provider", "rank": "Rank", "eligible": "Eligible", "submitted": "Requests"} | {c: c for c in METRICS}
_FORMATS = {"rate": lambda v: format(v, ".2%"), "double": lambda v: format(v, ".2f"), "boolean": lambda v: ("no", "yes")[v], "array<string>": ", ".join}


def text_of(value, kind: str = "string") -> str:
    """A value by the kind of its column: rates as percent, numbers with two places, yes or no; unavailable for null."""
    return "unavailable" if value is None else _FORMATS.get(kind, str)(value)


def markdown(df: DataFrame, columns: dict[str, str]) -> str:
    kinds = {c: "rate" if c.endswith("_rate") else k for c, k in df.dtypes}
    rows = df.select(*columns).collect()
    lines = ["| " + " | ".join(columns.values()) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(text_of(r[c], kinds[c]) for c in columns) + " |" for r in rows])


def report(name: str, ranked: DataFrame, wins: DataFrame, pairs: DataFrame) -> str:
    """Ranked providers first, then others by name; wins and pairwise differences below. The frames hold one row a provider or pair."""
    table = ranked.orderBy(F.col("rank").asc_nulls_last(), "provider")
    parts = [f"# {name}", "Percentiles are nearest-rank over all samples; no confidence intervals.", markdown(table, COLUMNS)]
    excluded = ranked.where("not eligible").orderBy("provider").select("provider", F.array_join("ineligibility_reasons", ", ").alias("why"))
    parts += ["## Not eligible", markdown(excluded, {"provider": "Provider", "why": "Reasons"})]
    parts += ["## Fastest in a round", markdown(wins.orderBy(F.desc("credit"), "provider"), {"provider": "Provider", "credit": "Credit", "outright": "Outright", "tied": "Tied", "win_rate": "Rate"})]
    parts += ["## Paired differences", markdown(pairs.orderBy("provider_a", "provider_b"), {"provider_a": "A", "provider_b": "B", "paired_count": "Pairs", "coverage_rate": "Coverage", "difference_p50": "A - B p50"})]
    return "\n\n".join(parts) + "\n"


def acceptance(fact: DataFrame, expected: int, violations: DataFrame) -> DataFrame:
    """One row: which conditions of a finished run hold, and whether all do."""
    checks: dict[str, Column] = {
        "all_requests": F.count(F.lit(1)) == expected,
        "unique_requests": F.count_distinct("round_id", "provider") == F.count(F.lit(1)),
        "outcomes_known": F.count_if(F.col("outcome").isNull()) == 0,
        "times_in_order": F.coalesce(F.bool_and(F.col("ttfa_ms").isNull() | F.col("e2e_ms").isNull() | (F.col("ttfa_ms") <= F.col("e2e_ms"))), F.lit(True)),
        "no_failed_correct": F.count_if(F.col("correct") & (F.col("outcome") != "2xx")) == 0,
    }
    found = fact.agg(*[c.alias(n) for n, c in checks.items()]).crossJoin(F.broadcast(violations.agg((F.count(F.lit(1)) == 0).alias("no_violations"))))
    names = [*checks, "no_violations"]
    total = F.lit(True)
    for n in names:
        total = total & F.col(n)
    return found.withColumn("accepted", total)


def drift(specification: DataFrame, adapters: DataFrame, columns: list[str]) -> DataFrame:
    """(provider, problem): providers one side lacks, and columns in which they differ."""
    a = specification.select("provider", F.struct(*columns).alias("a"))
    b = adapters.select("provider", F.struct(*columns).alias("b"))
    both = a.join(b, "provider", "full_outer")
    differ = F.array_join(F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull()), ",")
    problem = F.when(F.col("a").isNull(), "not specified").when(F.col("b").isNull(), "no adapter").when(differ != "", differ)
    return both.select("provider", problem.alias("problem")).where("problem is not null")
