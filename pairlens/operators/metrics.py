"""Family and pooled provider metrics, eligibility and ranks from one fact frame.

Fact columns: provider, family, outcome, correct, invalid, ttfo_ms, ttfa_ms,
pre_answer_reasoning_tokens, reasoning_emitted, e2e_ms, speed, cost_usd, tokens_in,
tokens_out. Failed requests stay in every denominator of a rate; times that are null
leave the latency populations only. Measures and costs that are no finite numbers
of at least 0 raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.functions.stats import LOWER, UPPER, finite, percentile_array, rank_of, ratio, reasons
from pairlens.operators.selection import exact_percentiles

#: Measures, and whether their percentiles are those of the lower tail.
MEASURES = {"ttfo_ms": False, "ttfa_ms": False, "pre_answer_reasoning_tokens": False, "e2e_ms": False, "speed": True}
#: Names of the failure rates by outcome.
FAILURES = {"timeout": "timeout", "429": "http_429", "other_4xx": "other_http_4xx", "5xx": "http_5xx", "transport_error": "transport_error"}


def _order_free_sum(name: str) -> Column:
    """The sum of a column of doubles, the same in any order: as decimals of 18 places, or as doubles where those would not hold it."""
    plain = F.sum(name)
    fixed = F.expr(f"try_cast({name} AS decimal(38, 18))")
    return F.when(F.count(fixed) == F.count(name), F.coalesce(F.try_sum(fixed).cast("double"), plain)).otherwise(plain)


def _aggregates(order_free: bool = False) -> list[Column]:
    one = F.count(F.lit(1))
    failed = ~F.col("outcome").eqNullSafe(F.lit("2xx"))
    out = [one.alias("submitted"), F.count_if(F.col("correct")).alias("correct_count"), F.count_if(failed).alias("failed_count"), F.count_if(F.col("invalid")).alias("invalid_count")]
    out += [F.count_if(~failed & ~F.coalesce("invalid", F.lit(False)) & ~F.coalesce("correct", F.lit(False))).alias("incorrect_count"), F.count_if("reasoning_emitted").alias("reasoning_count")]
    out += [F.count_if(F.col("outcome") == o).alias(f"{n}_count") for o, n in FAILURES.items()]
    known = F.col("tokens_in").isNotNull() & F.col("tokens_out").isNotNull()
    return [*out, F.sum(F.when(known, F.col("tokens_in"))).alias("tokens_in"), F.sum(F.when(known, F.col("tokens_out"))).alias("tokens_out"), F.count_if(known).alias("usage_rows"), F.count("cost_usd").alias("cost_rows"), F.round(_order_free_sum("cost_usd") if order_free else F.sum("cost_usd"), 6).alias("known_cost_usd")]


def _rates(df: DataFrame) -> DataFrame:
    n = F.col("submitted")
    return df.withColumns({"success_rate": ratio(F.col("correct_count"), n), "failure_rate": ratio(F.col("failed_count"), n), "invalid_rate": ratio(F.col("invalid_count"), n), "reasoning_emission_rate": ratio(F.col("reasoning_count"), F.col("ttfa_ms_population")), **{f"{f}_rate": ratio(F.col(f"{f}_count"), n) for f in FAILURES.values()}, "total_cost_usd": F.when(F.col("cost_rows") == n, F.col("known_cost_usd"))})


def _checked(fact: DataFrame) -> DataFrame:
    return fact.withColumns({m: finite(F.col(m), m) for m in (*MEASURES, "cost_usd")})


def _grouped(fact: DataFrame, keys: list[str], large: bool, *more: Column, order_free: bool = False) -> DataFrame:
    """Counts, sums and percentiles by group. Percentiles from one count of values a measure and group, or for large groups by selection."""
    rows = _checked(fact)
    if not large:
        found = [c for m, lower in MEASURES.items() for c in (F.count(m).alias(f"{m}_population"), percentile_array(m, lower).alias(f"_{m}"))]
        counts = rows.groupBy(*keys).agg(*_aggregates(order_free), *found, *more)
        return counts.withColumns({f"{m}_{k}": F.get(f"_{m}", F.lit(i)).cast("double") for m in MEASURES for i, k in enumerate(UPPER)}).drop(*[f"_{m}" for m in MEASURES])
    counts = rows.groupBy(*keys).agg(*_aggregates(order_free), *more)
    wanted = {m: {k: rank_of(q) for k, q in (LOWER if lower else UPPER).items()} for m, lower in MEASURES.items()}
    found = exact_percentiles(rows.select(*keys, *[F.col(m).cast("double").alias(m) for m in MEASURES]), keys, wanted)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}"))
    return counts.alias("c").join(found.alias("p"), same).select("c.*", *[F.col(f"p.{c}").alias(c) for c in found.columns if c not in keys])


def family_metrics(fact: DataFrame, large: bool = False, order_free: bool = False) -> DataFrame:
    """Metrics by provider and family. ``large``: for groups whose distinct values do not fit a task; the rows are the same, from more passes over the facts.

    ``order_free``: costs add up to the same in any order, as an audit needs them; a sum of
    doubles in the order of tasks can round to either side.
    """
    return _rates(_grouped(fact, ["provider", "family"], large, order_free=order_free))


def combined_metrics(fact: DataFrame, families: list, min_success: float = 0.95, max_failure: float = 0.01, large: bool = False) -> DataFrame:
    """Pooled over families: percentiles rank the raw samples of all of them again; ``large`` as in family_metrics."""
    sizes = [F.count_if(F.col("family").eqNullSafe(F.lit(f))).alias(f"_n{i}") for i, f in enumerate(families)]
    pooled = _rates(_grouped(fact, ["provider"], large, *sizes, F.count_if(~F.coalesce(F.col("family").isin(*families), F.lit(False))).alias("_other")))
    n = F.array(*[F.col(f"_n{i}") for i in range(len(families))])
    missing = F.filter(F.array(*[F.when(F.col(f"_n{i}") == 0, F.lit(f)) for i, f in enumerate(families)]), lambda x: x.isNotNull())
    joined = pooled.withColumn("missing_families", missing).withColumn("balanced", (F.array_min(n) > 0) & (F.array_min(n) == F.array_max(n)) & (F.col("_other") == 0)).drop("_other", *[f"_n{i}" for i in range(len(families))])
    why = reasons((F.col("success_rate") < min_success, "success_rate_below_minimum"), (F.col("failure_rate") > max_failure, "failure_rate_above_maximum"), (~F.col("balanced"), "unbalanced_families"))
    return joined.withColumn("ineligibility_reasons", why).withColumn("eligible", F.size("ineligibility_reasons") == 0)


def ranked(combined: DataFrame, by: str = "e2e_ms_p99") -> DataFrame:
    """Rank 1..n of eligible providers that have a value; equal values rank by name. A value of zero sorts last, as the contract has it."""
    key = F.when(F.col(by) == 0, F.lit(float("inf"))).otherwise(F.col(by))
    can = F.col("eligible") & F.col(by).isNotNull()
    order = Window.partitionBy(can).orderBy(key.asc_nulls_last(), "provider")
    return combined.withColumn("rank", F.when(can, F.row_number().over(order)))


def median_fields(evaluations: DataFrame) -> DataFrame:
    """Interpolated median of correct_field_count by provider."""
    return evaluations.groupBy("provider").agg(F.median("correct_field_count").alias("median_fields"), F.count("correct_field_count").alias("n"))
