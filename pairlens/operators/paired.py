"""Paired comparisons of providers over rounds: eligibility, wins, pairwise differences.

Frames have round_id, provider and a measure that is null where the request has
none. A provider stands at most once in a round; twice raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.stats import UPPER, percentile_array, rank_of, ratio
from pairlens.operators.selection import exact_percentiles

#: Fixed texts of the result contract.
INCOMPATIBLE = "incompatible model or request configuration"
INCOMPLETE = "incomplete or internally inconsistent local artifact graph"


def paired_eligibility(fact: DataFrame, compatible: Column | None = None, complete: Column | None = None, flags: DataFrame | None = None) -> DataFrame:
    """(provider, compatible, complete, rounds, exclusion_reasons, eligible).

    All rows of a provider must be compatible and complete, where null means
    yes, and it must stand in every observed round. ``flags`` has one row a
    provider at most, with the columns compatible and complete, and can only
    take away; a null flag of a listed provider takes away too.
    """
    yes = lambda c: F.coalesce(F.bool_and(F.lit(True) if c is None else F.coalesce(c, F.lit(True))), F.lit(True))
    per = fact.groupBy("provider").agg(yes(compatible).alias("compatible"), yes(complete).alias("complete"), F.count_distinct("round_id").alias("rounds"))
    per = per.crossJoin(F.broadcast(fact.agg(F.count_distinct("round_id").alias("all_rounds"))))
    if flags is not None:
        listed = flags.select("provider", F.coalesce("compatible", F.lit(False)).alias("may"), F.coalesce("complete", F.lit(False)).alias("whole"))
        per = per.join(listed, "provider", "left").withColumns({"compatible": F.col("compatible") & F.coalesce("may", F.lit(True)), "complete": F.col("complete") & F.coalesce("whole", F.lit(True))})
    per = per.withColumn("complete", F.col("complete") & (F.col("rounds") == F.col("all_rounds")))
    why = F.filter(F.array(F.when(~F.col("compatible"), F.lit(INCOMPATIBLE)), F.when(~F.col("complete"), F.lit(INCOMPLETE))), lambda x: x.isNotNull())
    return per.select("provider", "compatible", "complete", "rounds", why.alias("exclusion_reasons"), (F.size(why) == 0).alias("eligible"))


def _rounds(fact: DataFrame, measure: str, eligible: DataFrame | None) -> DataFrame:
    """(round_id, present): each round with its providers' values in name order; a provider that is not eligible has none."""
    rows = fact.select("round_id", "provider", F.col(measure).alias("v"))
    if eligible is not None:
        may = eligible.select("provider", "eligible")
        rows = rows.join(may, "provider", "left").withColumn("v", F.when(F.col("eligible"), F.col("v")))
    held = rows.groupBy("round_id").agg(F.array_sort(F.collect_list(F.struct("provider", "v"))).alias("all"))
    names = F.transform("all", lambda x: x["provider"])
    twice = F.when(F.size(F.array_distinct(names)) != F.size(names), F.raise_error(F.concat(F.lit("a provider stands twice in round "), F.col("round_id").cast("string"))).cast("boolean"))
    return held.where(F.coalesce(twice, F.lit(True))).select("round_id", F.filter("all", lambda x: x["v"].isNotNull()).alias("present"))


def _providers(fact: DataFrame, eligible: DataFrame | None) -> DataFrame:
    """(provider, eligible, exclusion_reasons) of all providers of the facts."""
    names = fact.select("provider").distinct()
    if eligible is None:
        return names.select("provider", F.lit(True).alias("eligible"), F.array().cast("array<string>").alias("exclusion_reasons"))
    return names.join(eligible.select("provider", "eligible", "exclusion_reasons"), "provider", "left")


def fastest_wins(fact: DataFrame, measure: str, eligible: DataFrame | None = None) -> DataFrame:
    """Credit 1/k to each of k providers that tie for a round's smallest value, for every provider.

    (provider, eligible, exclusion_reasons, credit, outright, tied, rounds,
    samples, missing, total_rounds, win_rate): the rate divides by the rounds in
    which any eligible provider has a value, and is null for those that are not.
    """
    rounds = _rounds(fact, measure, eligible)
    best = F.array_min(F.transform("present", lambda x: x["v"]))
    held = rounds.withColumn("best", best).withColumn("k", F.size(F.filter("present", lambda x: x["v"] == F.col("best"))))
    rows = held.select("k", "best", F.explode("present").alias("p")).select(F.col("p.provider").alias("provider"), (F.col("p.v") == F.col("best")).alias("won"), "k")
    # wins by number of ties first, as a sum of 1/k round by round depends on their order
    by_ties = rows.groupBy("provider", "k").agg(F.count_if("won").alias("won"), F.count(F.lit(1)).alias("n"))
    credit = F.aggregate(F.array_sort(F.collect_list(F.struct("k", "won"))), F.lit(0.0), lambda sum_, x: sum_ + x["won"] / x["k"])
    of = lambda ties: F.sum(F.when(ties, F.col("won")).otherwise(0))
    wins = by_ties.groupBy("provider").agg(F.round(credit, 9).alias("credit"), of(F.col("k") == 1).alias("outright"), of(F.col("k") > 1).alias("tied"), F.sum("n").alias("samples"))
    counts = rounds.agg(F.count_if(F.size("present") > 0).alias("rounds"), F.count(F.lit(1)).alias("total_rounds"))
    out = _providers(fact, eligible).join(wins, "provider", "left").fillna(0, ["credit", "outright", "tied", "samples"]).crossJoin(F.broadcast(counts))
    out = out.withColumn("missing", F.col("total_rounds") - F.col("samples")).withColumn("win_rate", F.when(F.col("eligible"), ratio(F.col("credit"), F.col("rounds"))))
    return out.select("provider", "eligible", "exclusion_reasons", "credit", "outright", "tied", "rounds", "samples", "missing", "total_rounds", "win_rate")


def pairwise(fact: DataFrame, measure: str, eligible: DataFrame | None = None, large: bool = False) -> DataFrame:
    """For provider_a < provider_b: in how many of all observed rounds both have a value, and upper-tail percentiles of a - b.

    Pairs without such rounds and pairs with a provider that is not eligible stay;
    the latter pair nowhere and carry the reasons. A round travels as one array,
    so the facts are shuffled once; ``large`` as in metrics.family_metrics.
    """
    rounds = _rounds(fact, measure, eligible)
    total = rounds.agg(F.count(F.lit(1)).alias("total_round_count"))
    later = lambda x: F.transform(F.filter("present", lambda y: y["provider"] > x["provider"]), lambda y: F.struct(x["provider"].alias("provider_a"), y["provider"].alias("provider_b"), (x["v"] - y["v"]).alias("difference")))
    differences = rounds.select(F.inline(F.flatten(F.transform("present", later))))
    pair = ["provider_a", "provider_b"]
    if large:
        found = exact_percentiles(differences, pair, {"difference": {k: rank_of(q) for k, q in UPPER.items()}}).withColumnRenamed("difference_population", "paired_count")
    else:
        at = differences.groupBy(*pair).agg(F.count(F.lit(1)).alias("paired_count"), percentile_array("difference").alias("d"))
        found = at.select(*pair, "paired_count", *[F.get("d", F.lit(i)).alias(f"difference_{k}") for i, k in enumerate(UPPER)])
    names = _providers(fact, eligible)
    reasons = lambda: F.transform("exclusion_reasons", lambda r: F.concat("provider", F.lit(": "), r))
    side = lambda s: names.select(F.col("provider").alias(f"provider_{s}"), F.col("eligible").alias(f"may_{s}"), reasons().alias(f"why_{s}"))
    pairs = side("a").join(side("b"), F.col("provider_a") < F.col("provider_b"))
    out = pairs.join(found, ["provider_a", "provider_b"], "left").fillna(0, ["paired_count"]).crossJoin(F.broadcast(total))
    return out.select(
        "provider_a", "provider_b", (F.col("may_a") & F.col("may_b")).alias("eligible_comparison"), F.array_sort(F.array_distinct(F.concat("why_a", "why_b"))).alias("exclusion_reasons"), "paired_count", "total_round_count",
        (F.col("total_round_count") - F.col("paired_count")).alias("missing_pair_count"), ratio(F.col("paired_count"), F.col("total_round_count")).alias("coverage_rate"), "difference_p50", "difference_p95", "difference_p99",
    )
