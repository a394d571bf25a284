"""Exact nearest-rank percentiles of large groups by selection.

A sketch of each group gives two values between which a rank must lie; one more
pass counts what is below them and how often each value between them stands, and
the rank is found there. Sketches and counts are combined in the tasks before they
are shuffled, and no task sees a group's values but those between its brackets. The
counts prove the bracket: where a rank is outside, brackets widen and the pass is
run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a sketch's error, and half the width of the first brackets as a share of the ranks: more than twice that error.
ACCURACY, MARGIN = 5_000, 0.0005
#: Brackets up to this number are broadcast, more are joined by a shuffle.
SMALL = 50_000
#: Largest integer up to which whole numbers pass through doubles unchanged.
WHOLE = 1 << 53


def _same(left: str, right: str, names: list[str]) -> Column:
    both = F.lit(True)
    for n in names:
        both = both & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return both


def exact_percentiles(df: DataFrame, keys: list[str], measures: dict[str, dict[str, float]]) -> DataFrame:
    """(keys, <measure>_population, <measure>_<label>...): the value at rank ceil(quantile * n) of each measure's non-null values, by group.

    ``measures`` maps numeric columns to labels and quantiles. Values are those of
    percentile_disc with the same double arithmetic; null without any value. NaN
    sorts last; whole numbers past 2^53 raise. The sketches run when this is called.
    """
    names = list(measures)
    kinds = dict(df.dtypes)
    as_double = lambda m: F.when(F.abs(F.col(m)) > WHOLE, F.raise_error(F.lit(f"{m} is past 2^53")).cast("double")).otherwise(F.col(m).cast("double")) if kinds[m] in ("bigint", "int") else F.col(m).cast("double")
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("m"), as_double(m).alias("v")) for i, m in enumerate(names)])).alias("x")).select(*keys, "x.m", (F.col("x.v") + 0.0).alias("v")).where("v IS NOT NULL")
    ranks = [(i, label, q) for i, m in enumerate(names) for label, q in measures[m].items()]
    margin = MARGIN
    found = None
    left = None
    while True:
        ends = sorted({min(1.0, max(0.0, q + s * margin)) for _, _, q in ranks for s in (-1, 1)})
        at = {e: n for n, e in enumerate(ends)}
        sketch = long.groupBy(*keys, "m").agg(F.count("v").alias("n"), F.percentile_approx("v", ends, ACCURACY).alias("e"), F.min("v").alias("low"), F.max("v").alias("high"))
        one = lambda i, label, q: F.struct(F.lit(i).alias("i"), F.lit(label).alias("label"), F.greatest(F.ceil(F.lit(q) * F.col("n")).cast("long"), F.lit(1).cast("long")).alias("rank"), (F.col("low") if q - margin <= 0 else F.get("e", F.lit(at[max(0.0, q - margin)]))).alias("lo"), (F.col("high") if q + margin >= 1 else F.get("e", F.lit(at[min(1.0, q + margin)]))).alias("hi"))  # noqa: E731,B023
        brackets = sketch.select(*keys, "m", "n", F.explode(F.filter(F.array(*[one(*r) for r in ranks]), lambda x: x["i"] == F.col("m"))).alias("x")).select(*keys, "m", "n", "x.label", "x.rank", "x.lo", "x.hi")
        if left is not None:
            brackets = brackets.alias("b").join(left.alias("l"), _same("b", "l", [*keys, "m", "label"]), "left_semi")
        brackets = brackets.persist()
        side = F.broadcast(brackets) if brackets.limit(SMALL + 1).count() <= SMALL else brackets
        inside = F.when(F.col("v") >= F.col("lo"), F.col("v"))
        hit = long.alias("r").join(side.alias("b"), _same("r", "b", [*keys, "m"]) & (F.col("r.v") <= F.col("b.hi")))
        counts = hit.select(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("b.m").alias("m"), F.col("b.label").alias("label"), F.col("b.n").alias("n"), F.col("b.rank").alias("rank"), inside.alias("v")).groupBy(*keys, "m", "label", "n", "rank", "v").agg(F.count(F.lit(1)).alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "m", "label").orderBy(F.col("v").asc_nulls_first()))
        picked = counts.withColumn("upto", upto).where("upto >= rank").groupBy(*keys, "m", "label", "n").agg(F.min_by(F.struct(F.col("v").alias("v")), "upto").alias("p")).select(*keys, "m", "label", "n", F.col("p.v").alias("v"))
        picked = picked.persist()
        found = picked.where("v IS NOT NULL") if found is None else found.unionByName(picked.where("v IS NOT NULL"))
        sought = brackets.select(*keys, "m", "label").alias("b")
        left = sought.join(picked.where("v IS NOT NULL").alias("l"), _same("b", "l", [*keys, "m", "label"]), "left_anti").select("b.*")
        if left.isEmpty():
            break
        margin = max(8 * margin, 2 / ACCURACY)
    back = lambda i, m, label: F.max(F.when((F.col("m") == i) & (F.col("label") == label), F.col("v"))).cast(kinds[m])
    columns = [F.coalesce(F.max(F.when(F.col("m") == i, F.col("n"))), F.lit(0).cast("long")).alias(f"{m}_population") for i, m in enumerate(names)]
    columns += [back(i, m, label).alias(f"{m}_{label}") for i, m in enumerate(names) for label in measures[m]]
    groups = df.select(*keys).distinct()
    return groups.alias("g").join(found.groupBy(*keys).agg(*columns).alias("f"), _same("g", "f", keys), "left").select(*[F.col(f"g.{k}").alias(k) for k in keys], *[F.coalesce(F.col(f"f.{m}_population"), F.lit(0).cast("long")).alias(f"{m}_population") for m in names], *[F.col(f"f.{m}_{label}").alias(f"{m}_{label}") for m in names for label in measures[m]])
