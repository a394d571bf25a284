"""Mix sources to target weights by entropy balancing, in DataFrame operations only.

Every document gets a rate r between 0 and ``most`` copies: those that keep the
rates as close to 1 as possible, in relative entropy, while each source yields
its target of words. The optimum is r = min(most, exp(lambda * size / mean size))
with one multiplier a source. Newton steps on the dual, safeguarded by a bracket,
find the multipliers; they need only sums over (source, size), so documents are
read twice whatever the number of steps. Rates become copies by carrying the
rounding error from larger to smaller sizes, and what is still missing is filled
up with the largest documents that fit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

WORD = "[^\\x20\\x09-\\x0D]+"
KEY = ["no_source", "src"]
#: Documents of one source and size that are ranked together at most, on average.
STRATUM = 10_000


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Adds target to (no_source, src, words): share of all words by weight, at most ``most`` times a source's words."""
    order = Window.orderBy("no_source", "src")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("words"))
    by_room = Window.orderBy(F.col("cap") / F.col("w"), "no_source", "src")
    all_ = Window.partitionBy()
    level = weighed.select("*", (F.col("cap") / F.col("w")).alias("room"), F.row_number().over(by_room).alias("nth"), ((F.lit(share) * F.sum("words").over(all_) - F.sum("cap").over(by_room) + F.col("cap")) / (F.sum("w").over(all_) - F.sum("w").over(by_room) + F.col("w"))).alias("level"))
    level = level.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("room"), F.col("nth"))).over(all_))
    return level.withColumn("target", F.least("cap", F.coalesce(F.col("w") * F.col("level"), "cap"))).drop("w", "room", "nth", "level")


def _newton(strata: DataFrame, sources: DataFrame, most: int, steps: int) -> DataFrame:
    """Adds lambda to sources; raises if a source's words are still off by more than a millionth of its target."""
    free = F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean")))
    state = sources.select("*", F.lit(0.0).alias("lam"), F.lit(-700.0).alias("lo"), (F.log(F.lit(float(most))) * F.col("mean") / F.col("least") + 1).alias("hi"))
    for step in range(steps):
        terms = strata.join(state.select(*KEY, "lam", "mean"), KEY)
        sums = terms.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size") * free).alias("got"), F.sum(F.when(free < most, F.col("n") * F.col("size") * free * F.col("size") / F.col("mean"))).alias("slope"))
        under = F.col("got") < F.col("target")
        lo, hi = F.when(under, F.col("lam")).otherwise(F.col("lo")), F.when(under, F.col("hi")).otherwise(F.col("lam"))
        moved = state.join(sums, KEY, "left").withColumn("lo", lo).withColumn("hi", hi)
        to = F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope")
        near = F.abs(F.col("got") - F.col("target")) <= 1e-9 * F.col("target")
        moved = moved.withColumn("lam", F.when(near | F.col("got").isNull(), F.col("lam")).when(F.col("slope").isNotNull() & (to > F.col("lo")) & (to < F.col("hi")), to).otherwise((F.col("lo") + F.col("hi")) / 2))
        state = cut(moved.drop("got", "slope"))
        if step % 4 == 3 and moved.where(~near).isEmpty():
            return state.withColumn("lam", F.round("lam", 12))
    off = moved.where(F.abs(F.col("got") - F.col("target")) > 1e-6 * F.col("target")).select(*KEY, "got", "target").take(5)
    if off:
        raise RuntimeError(f"entropy balancing did not reach its targets in {steps} steps: {off}")
    return state.withColumn("lam", F.round("lam", 12))


def _round(strata: DataFrame, sources: DataFrame, most: int, seed: int) -> DataFrame:
    """Adds base and extra: every document of a stratum is taken base times, extra of them once more."""
    rate = F.when(F.col("target") >= F.col("cap"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))
    rated = strata.join(sources.select(*KEY, "target", "cap", "lam", "mean"), KEY).withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(1.0)))
    base = F.floor("rate")
    want = F.sum(F.col("n") * (F.col("rate") - base)).over(Window.partitionBy(*KEY).orderBy(F.desc("size"), "sub"))
    rated = rated.withColumn("base", base).withColumn("upto", F.floor(want + 0.5))
    before = F.lag("upto", 1, 0).over(Window.partitionBy(*KEY).orderBy(F.desc("size"), "sub"))
    out = cut(rated.withColumn("extra", F.least(F.col("n"), F.greatest(F.lit(0), F.col("upto") - before))).select(*KEY, "size", "sub", "n", "base", "extra", "target"))
    for _ in range(4):
        gap = F.col("target") - F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).over(Window.partitionBy(*KEY))
        seen = out.withColumn("gap", gap)
        short = F.col("gap") > 0
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap"))
        room = F.when(fits, F.when(~short, F.col("extra")).when(F.col("base") >= most, F.lit(0)).otherwise(F.col("n") - F.col("extra"))).otherwise(F.lit(0))
        seen = seen.withColumn("room", room)
        larger = Window.partitionBy(*KEY).orderBy(F.desc("size"), "sub").rowsBetween(Window.unboundedPreceding, -1)
        rest = F.greatest(F.lit(0.0), F.abs("gap") - F.coalesce(F.sum(F.col("size") * F.col("room")).over(larger), F.lit(0)))
        can = F.least(F.col("room"), F.floor(rest / F.col("size")))
        move = F.when(F.col("room") > 0, F.when(short, can).otherwise(-can)).otherwise(F.lit(0))
        out = cut(seen.withColumn("extra", F.col("extra") + move).select(*out.columns))
    return out


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 29, steps: int = 60) -> DataFrame:
    """Copies of each document so that sources meet their shares of ``share`` times all words.

    Returns (id, source, size, source_size, target, copies, taken), one row for
    each input row; size counts words, taken = size * copies. Sources in code
    point order, null last, weigh ``weights`` in turn. Null and empty texts have
    size 0 and are taken once. Rows that share an id or a text are rated alike and
    rounded by a seeded hash of id and text; equal rows may differ by one copy.
    Sums are over all rows. Other columns are ignored, whatever their names.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("draw"))
    sized = cut(sized)
    plain = cut(sized.groupBy(*KEY, "size").agg(F.count(F.lit(1)).alias("n")))
    totals = plain.groupBy(*KEY).agg(F.sum(F.col("n") * F.col("size")).alias("words"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    aimed = cut(targets(totals, weights, share, most))
    solved = _newton(plain, aimed.where("target < cap and target > 0"), most, steps)
    sources = aimed.join(solved.select(*KEY, "lam"), KEY, "left").fillna(0.0, ["lam"])
    heavy = plain.where(F.col("n") > STRATUM).select(*KEY, "size", F.ceil(F.col("n") / STRATUM).alias("parts"))
    placed = sized.join(heavy, [*KEY, "size"], "left").withColumn("sub", F.pmod("draw", F.coalesce("parts", F.lit(1)))).drop("parts")
    strata = placed.groupBy(*KEY, "size", "sub").agg(F.count(F.lit(1)).alias("n"))
    rounded = _round(strata, sources, most, seed)
    ranked = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*KEY, "size", "sub").orderBy("draw", "id")))
    out = ranked.join(rounded.select(*KEY, "size", "sub", "base", "extra"), [*KEY, "size", "sub"]).join(aimed.select(*KEY, F.col("words").alias("source_size"), "target"), KEY)
    copies = F.col("base") + F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
