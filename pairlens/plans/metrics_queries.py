"""Metric, rank and paired queries over request facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions.stats import percentiles, ratio
from pairlens.operators import metrics, outcomes, paired, schedule
from pairlens.sources.tables import FAMILIES, attempts, request_facts

from .registry import ORACLES, query

#: DuckDB twin of request_facts.
FACT = """
WITH a0 AS (SELECT event_id AS seq, event_id // 10 AS round_index, 'arm' || CAST(event_id % 10 AS VARCHAR) AS provider, CAST((event_id // 10) % 3 AS INT) AS family,
  event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
attempts AS (SELECT *, CASE WHEN event_type = 'error' AND k < 4 THEN ['timeout','429','5xx','transport_error'][k + 1] ELSE '2xx' END AS outcome
  FROM a0 WHERE round_index < 3 * ((SELECT count(*) FROM events) // 30)),
f0 AS (SELECT seq, round_index, round_index AS round_id, provider, family, outcome, k, outcome = '2xx' AS ok, value FROM attempts),
fact AS (SELECT seq, round_index, round_id, provider, family, outcome, k, CASE WHEN ok THEN value END AS e2e_ms, CASE WHEN ok THEN value * 0.5e0 END AS ttfa_ms, CASE WHEN ok THEN value * 0.25e0 END AS ttfo_ms, CASE WHEN ok THEN CAST(k % 3 AS BIGINT) END AS pre_answer_reasoning_tokens, CASE WHEN ok THEN k % 3 > 0 END AS reasoning_emitted,
  CASE WHEN ok AND value > value * 0.5e0 THEN CAST(k + 1 AS DOUBLE) / ((value - value * 0.5e0) / 1000e0) END AS speed,
  ok AND k >= 5 AS correct, ok AND k = 4 AS invalid, CASE WHEN ok THEN CAST(k + 20 AS BIGINT) END AS tokens_in, CASE WHEN ok THEN CAST(k AS BIGINT) END AS tokens_out,
  CASE WHEN ok THEN ((k + 20) * (CASE WHEN provider = 'arm3' THEN 0.45e0 ELSE 0.15e0 END) + k * (CASE WHEN provider = 'arm3' THEN 1.5e0 ELSE 0.5e0 END)) / 1e6 END AS cost_usd FROM f0)
"""


def rank_sql(x: str, p: str) -> str:
    return f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))[CAST(greatest(1, ceil({p} * count({x}))) AS INT)]"


def percentiles_sql(x: str, name: str, lower: bool = False) -> str:
    at = {"p50": "0.5e0", "p95": "(1e0 - 0.95e0)" if lower else "0.95e0", "p99": "(1e0 - 0.99e0)" if lower else "0.99e0"}
    return ", ".join(f"{rank_sql(x, p)} AS {name}_{k}" for k, p in at.items())


AGG = f"""count(*) AS submitted, count_if(correct) AS correct_count, count_if(outcome <> '2xx') AS failed_count, count_if(invalid) AS invalid_count, count_if(outcome = '2xx' AND NOT invalid AND NOT correct) AS incorrect_count, count_if(reasoning_emitted) AS reasoning_count,
{", ".join(f"count_if(outcome = '{o}') AS {n}_count, count_if(outcome = '{o}') / count(*) AS {n}_rate" for o, n in metrics.FAILURES.items())}, count_if(reasoning_emitted) / nullif(count(ttfa_ms), 0) AS reasoning_emission_rate,
count(ttfo_ms) AS ttfo_ms_population, {percentiles_sql('ttfo_ms', 'ttfo_ms')}, count(pre_answer_reasoning_tokens) AS pre_answer_reasoning_tokens_population, {percentiles_sql('pre_answer_reasoning_tokens', 'pre_answer_reasoning_tokens')},
count(e2e_ms) AS e2e_ms_population, {percentiles_sql('e2e_ms', 'e2e_ms')}, count(ttfa_ms) AS ttfa_ms_population, {percentiles_sql('ttfa_ms', 'ttfa_ms')},
count(speed) AS speed_population, {percentiles_sql('speed', 'speed', True)}, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
count(tokens_in) AS usage_rows, count(cost_usd) AS cost_rows, round(sum(cost_usd), 6) AS known_cost_usd,
count_if(correct) / count(*) AS success_rate, count_if(outcome <> '2xx') / count(*) AS failure_rate, count_if(invalid) / count(*) AS invalid_rate,
CASE WHEN count(cost_usd) = count(*) THEN round(sum(cost_usd), 6) END AS total_cost_usd"""

COMBINED = f"""{FACT}, c0 AS (SELECT provider, {AGG} FROM fact GROUP BY provider),
n AS (SELECT provider, family, count(*) AS n FROM fact GROUP BY ALL),
s0 AS (SELECT provider, list(family) AS fams, count(*) = 3 AND min(n) = max(n) AS balanced FROM n GROUP BY provider),
s AS (SELECT provider, balanced, list_filter([0, 1, 2], lambda x: NOT list_contains(fams, x)) AS missing_families FROM s0),
combined AS (SELECT c0.*, s.missing_families, s.balanced, list_filter([CASE WHEN success_rate < 0.95 THEN 'success_rate_below_minimum' END, CASE WHEN failure_rate > 0.01 THEN 'failure_rate_above_maximum' END,
 CASE WHEN NOT balanced THEN 'unbalanced_families' END], lambda x: x IS NOT NULL) AS why FROM c0 JOIN s USING (provider))
"""


def _combined(spark, sf_dir):
    return metrics.combined_metrics(request_facts(spark, sf_dir), list(FAMILIES))


@query("family_metrics", f"{FACT} SELECT provider, family, {AGG} FROM fact GROUP BY provider, family")
def family_metrics(spark, sf_dir):
    return metrics.family_metrics(request_facts(spark, sf_dir))


@query("family_latency_percentiles", f"{FACT} SELECT provider, family, count(*) AS submitted, count(e2e_ms) AS population, count(*) - count(e2e_ms) AS missing, count(e2e_ms) / count(*) AS population_rate, {percentiles_sql('e2e_ms', 'e2e')} FROM fact GROUP BY ALL")
def family_latency(spark, sf_dir):
    n = F.count(F.lit(1))
    return request_facts(spark, sf_dir).groupBy("provider", "family").agg(n.alias("submitted"), F.count("e2e_ms").alias("population"), (n - F.count("e2e_ms")).alias("missing"), ratio(F.count("e2e_ms"), n).alias("population_rate"), *percentiles("e2e_ms", "e2e"))


@query("outcome_rates", f"{FACT} SELECT provider, outcome, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY provider) AS rate FROM fact GROUP BY provider, outcome")
def outcome_rates(spark, sf_dir):
    from pyspark.sql import Window

    counts = attempts(spark, sf_dir).groupBy("provider", "outcome").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rate", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("provider"))))


@query("failure_filter", f"{FACT} SELECT seq, provider, outcome FROM attempts WHERE outcome <> '2xx'")
def failure_filter(spark, sf_dir):
    return outcomes.failures(attempts(spark, sf_dir)).select("seq", "provider", "outcome")


@query("recent_failures", f"{FACT} SELECT seq, provider, family, round_index, outcome FROM attempts WHERE outcome <> '2xx' ORDER BY seq DESC LIMIT 5")
def recent_failures(spark, sf_dir):
    return outcomes.failures(attempts(spark, sf_dir)).select("seq", "provider", "family", "round_index", "outcome").orderBy(F.desc("seq")).limit(5)


@query("terminal_outcome", f"{FACT} SELECT seq, outcome FROM attempts")
def terminal_outcome(spark, sf_dir):
    a = attempts(spark, sf_dir)
    status = F.when(F.col("outcome") == "2xx", 200 + F.col("k")).when(F.col("outcome") == "429", 429).when(F.col("outcome") == "5xx", 503)
    return a.select("seq", outcomes.terminal_outcome(status, F.when(F.col("outcome").isin("timeout", "transport_error"), F.col("outcome"))).alias("outcome"))


@query("combined_pooled", f"{COMBINED} SELECT * EXCLUDE (why, missing_families), len(missing_families) AS missing_families FROM combined")
def combined_pooled(spark, sf_dir):
    return _combined(spark, sf_dir).drop("ineligibility_reasons", "eligible").withColumn("missing_families", F.size("missing_families").cast("long"))


@query("speed_lower_tail", f"{FACT} SELECT provider, {percentiles_sql('speed', 'speed', True)} FROM fact GROUP BY provider")
def speed_lower_tail(spark, sf_dir):
    return request_facts(spark, sf_dir).groupBy("provider").agg(*percentiles("speed", "speed", True))


@query("balance_check", FACT.replace("WHERE round_index < 3 * ((SELECT count(*) FROM events) // 30)", "") + ", n AS (SELECT provider, family, count(*) AS n FROM fact GROUP BY ALL) SELECT provider, count(*) = 3 AND min(n) = max(n) AS balanced FROM n GROUP BY provider")
def balance_check(spark, sf_dir):
    return metrics.combined_metrics(request_facts(spark, sf_dir, balanced=False), list(FAMILIES)).select("provider", "balanced")


@query("eligibility_reasons", COMBINED + "SELECT provider, array_to_string(why, ',') AS reasons, len(why) = 0 AS eligible FROM combined")
def eligibility_reasons(spark, sf_dir):
    return _combined(spark, sf_dir).select("provider", F.array_join("ineligibility_reasons", ",").alias("reasons"), "eligible")


@query("provider_rank", COMBINED + "SELECT provider, e2e_ms_p99, CASE WHEN len(why) = 0 THEN row_number() OVER (PARTITION BY len(why) = 0 ORDER BY CASE WHEN e2e_ms_p99 = 0 THEN 'inf'::DOUBLE ELSE e2e_ms_p99 END, provider) END AS rank FROM combined")
def provider_rank(spark, sf_dir):
    return metrics.ranked(_combined(spark, sf_dir)).select("provider", "e2e_ms_p99", F.col("rank").cast("long").alias("rank"))


@query("grouping_sets_rollup", f"{FACT} SELECT provider, family, grouping(family) = 1 AS pooled, count(*) AS n, {percentiles_sql('e2e_ms', 'e2e')} FROM fact GROUP BY GROUPING SETS ((provider, family), (provider))")
def grouping_sets_rollup(spark, sf_dir):
    f = request_facts(spark, sf_dir).select("provider", "family", "e2e_ms")
    return f.groupingSets([["provider", "family"], ["provider"]], "provider", "family").agg((F.grouping("family") == 1).alias("pooled"), F.count(F.lit(1)).alias("n"), *percentiles("e2e_ms", "e2e"))


WINS = f"""{FACT}, b AS (SELECT provider, round_id, e2e_ms, min(e2e_ms) OVER (PARTITION BY round_id) AS best FROM fact WHERE e2e_ms IS NOT NULL),
t AS (SELECT *, count(*) OVER (PARTITION BY round_id) AS k FROM b WHERE e2e_ms = best), sm AS (SELECT provider, count(e2e_ms) AS samples FROM fact GROUP BY 1),
w AS (SELECT provider, round(sum(1e0 / k), 9) AS credit, count_if(k = 1) AS outright, count_if(k > 1) AS tied FROM t GROUP BY provider),
r AS (SELECT count(DISTINCT round_id) FILTER (WHERE e2e_ms IS NOT NULL) AS rounds, count(DISTINCT round_id) AS total_rounds FROM fact), p AS (SELECT DISTINCT provider FROM fact)
"""


@query("fastest_wins", WINS + "SELECT provider, coalesce(credit, 0) AS credit, coalesce(outright, 0) AS outright, coalesce(tied, 0) AS tied, rounds, samples, total_rounds - samples AS missing, total_rounds FROM p LEFT JOIN w USING (provider) JOIN sm USING (provider), r")
def fastest_wins(spark, sf_dir):
    return paired.fastest_wins(request_facts(spark, sf_dir), "e2e_ms").drop("eligible", "exclusion_reasons", "win_rate")


@query("win_rate", WINS + "SELECT provider, round(coalesce(credit, 0) / rounds, 9) AS win_rate FROM p LEFT JOIN w USING (provider), r")
def win_rate(spark, sf_dir):
    return paired.fastest_wins(request_facts(spark, sf_dir), "e2e_ms").select("provider", F.round("win_rate", 9).alias("win_rate"))


ELIGIBLE = "e AS (SELECT provider, bool_and(NOT (provider = 'arm7' AND k = 0)) AS compatible, bool_and(NOT (provider = 'arm8' AND outcome = '5xx')) AND count(DISTINCT round_id) = (SELECT count(DISTINCT round_id) FROM fact) AS complete, count(DISTINCT round_id) AS rounds FROM fact GROUP BY provider)"


def _eligible(fact):
    return paired.paired_eligibility(fact, ~((F.col("provider") == "arm7") & (F.col("k") == 0)), ~((F.col("provider") == "arm8") & (F.col("outcome") == "5xx")))


@query("paired_eligibility", f"{FACT}, {ELIGIBLE} SELECT provider, compatible, complete, rounds, compatible AND complete AS eligible, array_to_string(list_filter([CASE WHEN NOT compatible THEN 'incompatible model or request configuration' END, CASE WHEN NOT complete THEN 'incomplete or internally inconsistent local artifact graph' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM e")
def paired_eligibility(spark, sf_dir):
    return _eligible(request_facts(spark, sf_dir)).withColumn("reasons", F.array_join("exclusion_reasons", "; ")).drop("exclusion_reasons")


PAIRS = FACT + """, j AS (SELECT a.provider AS provider_a, b.provider AS provider_b, a.e2e_ms - b.e2e_ms AS d FROM fact a JOIN fact b ON a.round_id = b.round_id AND a.provider < b.provider {more})"""


@query("pairwise_diff", PAIRS.format(more="") + f" SELECT provider_a, provider_b, true AS eligible_comparison, count(d) AS paired_count, any_value(total) AS total_round_count, any_value(total) - count(d) AS missing_pair_count, count(d) / any_value(total) AS coverage_rate, {percentiles_sql('d', 'difference')} FROM j, (SELECT count(DISTINCT round_id) AS total FROM fact) GROUP BY ALL")
def pairwise_diff(spark, sf_dir):
    return paired.pairwise(request_facts(spark, sf_dir), "e2e_ms").drop("exclusion_reasons")


@query("pair_coverage_empty_pairs", f"{FACT}, {ELIGIBLE}, p AS (SELECT DISTINCT provider FROM fact), g AS (SELECT provider FROM e WHERE compatible AND complete), "
       "j AS (SELECT a.provider AS provider_a, b.provider AS provider_b, count(a.e2e_ms - b.e2e_ms) AS n FROM fact a JOIN fact b ON a.round_id = b.round_id AND a.provider < b.provider WHERE a.provider IN (SELECT provider FROM g) AND b.provider IN (SELECT provider FROM g) GROUP BY ALL) "
       "SELECT x.provider AS provider_a, y.provider AS provider_b, coalesce(n, 0) AS paired_count, (SELECT count(DISTINCT round_id) FROM fact) - coalesce(n, 0) AS missing_pair_count, x.provider IN (SELECT provider FROM g) AND y.provider IN (SELECT provider FROM g) AS eligible_comparison FROM p x JOIN p y ON x.provider < y.provider LEFT JOIN j ON j.provider_a = x.provider AND j.provider_b = y.provider")
def pair_coverage(spark, sf_dir):
    fact = request_facts(spark, sf_dir)
    return paired.pairwise(fact, "e2e_ms", _eligible(fact)).select("provider_a", "provider_b", "paired_count", "missing_pair_count", "eligible_comparison")


@query("token_cost", f"{FACT} SELECT provider, round(sum(cost_usd), 6) AS cost_usd, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM fact GROUP BY provider")
def token_cost(spark, sf_dir):
    return request_facts(spark, sf_dir).groupBy("provider").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


@query("cost_coverage", f"{FACT} SELECT provider, family, count(cost_usd) AS known, count(*) AS submitted, CASE WHEN count(cost_usd) = count(*) THEN round(sum(cost_usd), 6) END AS total FROM fact GROUP BY ALL")
def cost_coverage(spark, sf_dir):
    return metrics.family_metrics(request_facts(spark, sf_dir)).select("provider", "family", F.col("cost_rows").alias("known"), "submitted", F.col("total_cost_usd").alias("total"))


@query("launch_skew", f"{FACT} SELECT round_index AS round_id, (max(seq * 1000 + k) - min(seq * 1000 + k)) / 1e6 AS skew_ms FROM attempts GROUP BY 1")
def launch_skew(spark, sf_dir):
    a = attempts(spark, sf_dir)
    return schedule.launch_skew(a.select(F.col("round_index").alias("round_id"), (F.col("seq") * 1000 + F.col("k")).alias("start_ns")))


@query("budget_running_total", f"{FACT} SELECT provider, seq, sum(k) OVER (PARTITION BY provider ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM attempts")
def budget_running_total(spark, sf_dir):
    return schedule.running_total(attempts(spark, sf_dir), "seq", "k", "provider").select("provider", "seq", "running")


@query("eta_summary", f"{FACT} SELECT provider, round(sum(e2e_ms) / 1000, 6) AS elapsed_s, round(avg(e2e_ms) / 1000 * count_if(e2e_ms IS NULL), 6) AS remaining_s FROM fact GROUP BY provider")
def eta_summary(spark, sf_dir):
    return request_facts(spark, sf_dir).groupBy("provider").agg(F.round(F.sum("e2e_ms") / 1000, 6).alias("elapsed_s"), F.round(F.avg("e2e_ms") / 1000 * F.count_if(F.col("e2e_ms").isNull()), 6).alias("remaining_s"))


@query("round_completeness", f"{FACT} SELECT round_index, count(*) AS arms, count_if(outcome = '2xx') = 10 AS all_completed FROM attempts GROUP BY 1 HAVING count(DISTINCT provider) = 10")
def round_completeness(spark, sf_dir):
    g = attempts(spark, sf_dir).groupBy("round_index").agg(F.count(F.lit(1)).alias("arms"), (F.count_if(F.col("outcome") == "2xx") == 10).alias("all_completed"), F.count_distinct("provider").alias("p"))
    return g.where("p = 10").drop("p")


def _twin(name: str, of: str, fn) -> None:
    """A query that gives the rows of another by another plan."""
    query(name, ORACLES[of])(fn)


_twin("family_metrics_selection", "family_metrics", lambda spark, sf_dir: metrics.family_metrics(request_facts(spark, sf_dir), large=True))
_twin("combined_pooled_selection", "combined_pooled", lambda spark, sf_dir: metrics.combined_metrics(request_facts(spark, sf_dir), list(FAMILIES), large=True).drop("ineligibility_reasons", "eligible").withColumn("missing_families", F.size("missing_families").cast("long")))
_twin("pairwise_diff_selection", "pairwise_diff", lambda spark, sf_dir: paired.pairwise(request_facts(spark, sf_dir), "e2e_ms", large=True).drop("exclusion_reasons"))
