"""Nearest-rank percentiles and guarded arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = {"p50": "0.5D", "p95": "0.95D", "p99": "0.99D"}
#: Lower-tail ranks of speed metrics; the double subtraction decides ties of rank.
LOWER = {"p50": "0.5D", "p95": "1D - 0.95D", "p99": "1D - 0.99D"}


def rank_of(quantile: str) -> float:
    """A quantile as the double that Spark reads."""
    first, *rest = (float(x.strip().rstrip("D")) for x in quantile.split("-"))
    return first - sum(rest)


def nearest_rank(column: str, quantile: str) -> Column:
    """The value at one-based rank ceil(quantile * n) of the non-null values, null without any."""
    return F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY {column})")


def percentiles(column: str, prefix: str, lower_tail: bool = False) -> list[Column]:
    """Percentiles of groups whose distinct values fit a task; see ``selection`` for those of any size."""
    return [nearest_rank(column, q).alias(f"{prefix}_{label}") for label, q in (LOWER if lower_tail else UPPER).items()]


def percentile_array(column: str, lower_tail: bool = False) -> Column:
    """The three of ``percentiles`` as one array, from one count of the values."""
    return F.expr(f"percentile_disc(array({', '.join((LOWER if lower_tail else UPPER).values())})) WITHIN GROUP (ORDER BY {column})")


def ratio(num: Column, den: Column) -> Column:
    return num.cast("double") / F.nullif(den, F.lit(0))


def reasons(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that hold, in order; a null check holds."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())


def finite(column: Column, name: str, positive: bool = False) -> Column:
    """The number itself; raises for NaN, infinities and negative (or, if positive, zero) values."""
    bad = F.isnan(column) | (F.abs(column) == float("inf")) | (column <= 0 if positive else column < 0)
    return F.when(bad, F.raise_error(F.lit(f"{name} is not a finite {'positive' if positive else 'non-negative'} number"))).otherwise(column)


def output_speed(tokens: Column, first_ms: Column, last_ms: Column, complete: Column) -> Column:
    """Visible tokens a second after the first; null under two tokens, without elapsed time or when incomplete."""
    return F.when((tokens >= 2) & (last_ms > first_ms) & complete, (tokens - 1) / ((last_ms - first_ms) / 1000))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """USD at prices per million tokens; null when usage is incomplete."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def short_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 24 hex characters of the SHA-256 of the NUL-joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 24))


def guarded(df: DataFrame, problem: Column) -> DataFrame:
    """df; a row whose problem is not null raises it, whatever columns are used afterwards.

    A check in a column goes with the column. This one is in a filter that reads a
    nondeterministic column, which Spark neither drops nor moves.
    """
    seen = df.withColumn("_problem", F.when(F.spark_partition_id() >= 0, problem))
    return seen.where(F.when(F.col("_problem").isNotNull(), F.raise_error(F.col("_problem")).cast("boolean")).otherwise(F.lit(True))).drop("_problem")
