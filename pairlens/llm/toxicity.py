"""Toxicity by two class-conditional Kneser-Ney models.

Toxic and ordinary texts get an interpolated bigram model each. Bigram counts back
off to the class's continuation counts of words (after how many different words
one stands), these to the continuation counts of word stems (the first five
bytes), and those to the counts of both classes together, which the two models
share: an expression whose word and stem are rare in the sample says little about
the class.
Discounting is absolute. A text is judged by its log-likelihood ratio, normalised by length, over
the whole text and over its most toxic stretch of 1, 2, 8 and 32 words. A
logistic function fitted on out-of-fold ratios turns these into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bound_batches, cut, tidy
from .words import Runs, U, Words, blocks, grouped

STRETCHES = (1, 2, 8, 32)
FEATURES = len(STRETCHES) + 2
STEM_BYTES = 5
#: Taken from every count, or all of it: so many sightings of an expression in a class are no evidence yet.
DISCOUNT = 3.0
#: Counts of a class in fold 0, in fold 1 and in both: out-of-fold models use the other fold.
MODELS = 3


@dataclass
class Ratios:
    """log P(toxic) - log P(ordinary) by word and by bigram, one column a model.

    A pair without a row of its own has its context's backoff weight times its
    word's probability, a word without one its class's backoff weight times its
    stem's, and a stem without one the same probability in both classes.
    """

    words: np.ndarray
    word_ratio: np.ndarray
    pairs: np.ndarray
    pair_ratio: np.ndarray
    stems: np.ndarray
    stem_ratio: np.ndarray
    contexts: np.ndarray
    context_ratio: np.ndarray
    word_backoff: np.ndarray

    def of(self, w: Words, model: int) -> np.ndarray:
        """The ratio of each word of a block, given the word before."""
        out = _lookup(self.words, self.word_ratio[:, model], w.hashes, np.nan)
        rare = np.flatnonzero(np.isnan(out))
        stem = _lookup(self.stems, self.stem_ratio[:, model], w.stems(STEM_BYTES)[rare], np.nan)
        out[rare] = np.where(np.isnan(stem), 0.0, stem + self.word_backoff[model])
        if len(w.hashes) > 1:
            inner = np.ones(len(w.hashes), bool)
            inner[w.bounds[:-1][w.bounds[:-1] < len(inner)]] = False
            at = np.flatnonzero(inner)
            found = _lookup(self.pairs, self.pair_ratio[:, model], Runs(w.hashes).at(at - 1, 2), np.nan)
            below = out[at] + _lookup(self.contexts, self.context_ratio[:, model], w.hashes[at - 1], 0.0)
            out[at] = np.where(np.isnan(found), below, found)
        return out


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def stretch_features(ratio: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of FEATURES length-normalised ratios by text; zeros without words."""
    n = np.diff(bounds)
    out = np.zeros((len(n), FEATURES))
    full = np.flatnonzero(n > 0)
    if not len(full):
        return out
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    start = np.arange(len(ratio))
    stop = np.repeat(bounds[1:], n)
    for k, size in enumerate(STRETCHES):
        value = (sums[np.minimum(start + size, stop)] - sums[:-1]) / size
        out[full, k] = np.maximum.reduceat(value, bounds[:-1][full])
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    out[full, -2] = (total / np.maximum(n, 1))[full]
    out[full, -1] = (total / np.sqrt(np.maximum(n, 1)))[full]
    return out


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often a word pair stands in each class and fold; a text's first word follows word 0."""
    for batch in batches:
        cell_of = batch.column(1).to_numpy()
        for lo, hi, w in blocks(batch.column(0), True, 4 << 20, True):
            if not len(w.hashes):
                continue
            before = np.concatenate([np.zeros(1, U), w.hashes[:-1]])
            before[w.bounds[:-1][w.bounds[:-1] < len(before)]] = 0
            two = np.concatenate([np.zeros(1, U), Runs(w.hashes).at(np.arange(len(w.hashes) - 1), 2)])
            two[before == 0] = w.hashes[before == 0]
            cell = cell_of[lo:hi][w.text_of()]
            order, starts = grouped(two)
            counts = np.stack([np.add.reduceat((cell == c)[order].astype(np.int64), starts) for c in range(4)])
            at = order[starts]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (two[at], before[at], w.hashes[at], w.stems(STEM_BYTES)[at])] + [pa.array(c) for c in counts], ["pair", "u", "w", "stem", "c0", "c1", "c2", "c3"])


def fit_ratios(sample: DataFrame) -> Ratios:
    """Both models from (text, cell) with cell = 2 * toxic + fold.

    No expression is cut: rows are left out only where they add nothing to what
    the levels below give, which holds for counts up to DISCOUNT, as these go to
    the backoff whole.
    """
    pairs = cut(sample.mapInArrow(_count, "pair long, u long, w long, stem long, c0 long, c1 long, c2 long, c3 long").groupBy("pair", "u", "w", "stem").agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(4)]))
    cols = {"o0": "c0", "o1": "c1", "o2": "c0 + c1", "t0": "c2", "t1": "c3", "t2": "c2 + c3"}
    grid = [f"{c}{m}" for m in range(MODELS) for c in "ot"]
    words = cut(pairs.groupBy("w", "stem").agg(*[F.count(F.when(F.expr(f"{cols[g]} > 0"), 1)).alias(g) for g in grid], F.count(F.lit(1)).alias("all")))
    stems = words.groupBy("stem").agg(*[F.sum(g).alias(g) for g in grid], F.sum("all").alias("all"))

    left = lambda of: of.agg(*[F.sum(g).alias(f"{g}_sum") for g in grid], *[F.sum(F.least(F.col(g).cast("double"), F.lit(DISCOUNT))).alias(f"{g}_left") for g in grid], F.sum("all").alias("all")).first()
    word_n, stem_n = ({g: (max(row[f"{g}_sum"] or 0, 1), max(row[f"{g}_left"] or 0, 0.5), max(row["all"] or 0, 1)) for g in grid} for row in (left(words), left(stems)))
    more = lambda count: " or ".join(f"{count(g)} > {DISCOUNT}" for g in ("o2", "t2"))
    above = lambda count: F.greatest(F.expr(f"double({count})") - DISCOUNT, F.lit(0.0))

    def own(g: str, of: dict, under: Column) -> Column:
        n, left, _ = of[g]
        return above(g) / n + left / n * under

    stem_p = stems.select("stem", F.col("all").alias("stem_all"), *[own(g, stem_n, F.col("all") / stem_n[g][2]).alias(f"s{g}") for g in grid])
    word_p = words.join(stem_p, "stem").select("w", *[F.col(g) for g in grid], *[own(g, word_n, F.col(f"s{g}") * F.col("all") / F.col("stem_all")).alias(f"w{g}") for g in grid])
    contexts = pairs.where("u <> 0").groupBy("u").agg(*[F.sum(F.expr(cols[g])).alias(f"n{g}") for g in grid], *[F.sum(F.least(F.expr(f"double({cols[g]})"), F.lit(DISCOUNT))).alias(f"d{g}") for g in grid])
    weighed = cut(contexts.select("u", *[f"n{g}" for g in grid], *[F.when(F.col(f"n{g}") > 0, F.col(f"d{g}") / F.col(f"n{g}")).otherwise(1.0).alias(f"l{g}") for g in grid]).where(" or ".join(f"l{g} < 1" for g in grid)))
    kept = pairs.where(f"u <> 0 and ({more(lambda g: '(' + cols[g] + ')')})")
    pair_p = kept.join(weighed, "u").join(word_p.select("w", *[f"w{g}" for g in grid]), "w").select("pair", *[(above(cols[g]) / F.greatest(F.col(f"n{g}"), F.lit(1)) + F.col(f"l{g}") * F.col(f"w{g}")).alias(f"p{g}") for g in grid])

    def table(df: DataFrame, key: str, of: str) -> tuple[np.ndarray, np.ndarray]:
        """Rising keys and a row of log ratios each."""
        found = df.select(F.col(key), *[(F.log(f"{of}t{m}") - F.log(f"{of}o{m}")).alias(f"r{m}") for m in range(MODELS)]).toArrow()
        keys = found.column(0).to_numpy().view(U)
        order = np.argsort(keys)
        return keys[order], np.stack([found.column(m + 1).to_numpy()[order] for m in range(MODELS)], 1)

    back = np.array([np.log(word_n[f"t{m}"][1] / word_n[f"t{m}"][0]) - np.log(word_n[f"o{m}"][1] / word_n[f"o{m}"][0]) for m in range(MODELS)])
    return Ratios(*table(word_p.where(more(lambda g: g)), "w", "w"), *table(pair_p, "pair", "p"), *table(stem_p, "stem", "s"), *table(weighed, "u", "l"), back)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with intercept last, means, deviations) by Newton's method with a ridge."""
    mean, dev = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.c_[(x - mean) / dev, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, dev


def _features(ratios):
    """Out-of-fold features of sample rows (text, cell)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ratios.value
        for batch in batches:
            cell = batch.column(1).to_numpy()
            out = np.zeros((batch.num_rows, FEATURES))
            for lo, hi, w in blocks(batch.column(0), True, bare=True):
                for fold in (0, 1):
                    f = stretch_features(r.of(w, 1 - fold), w.bounds)
                    own = cell[lo:hi] % 2 == fold
                    out[lo:hi][own] = f[own]
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(out[:, i]) for i in range(FEATURES))], ["cell", *(f"f{i}" for i in range(FEATURES))])

    return run


def _scorer(ratios, fitted):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ratios.value
        w_, mean, dev = fitted
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, w in blocks(batch.column(batch.num_columns - 1), True, bare=True):
                f = (stretch_features(r.of(w, 2), w.bounds) - mean) / dev
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(f @ w_[:-1] + w_[-1], -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 12_000, threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """(id, score, predicted), one row for each input row.

    ``labels`` marks some ids 0 or 1; ``trainable``, a condition on its columns,
    says which of these may be learned from. At most about ``sample_rows`` of
    them, picked by a hash of the id, fit the models: that bounds the model
    tables, which are broadcast. Null labels are ignored. Null and empty texts
    and texts without letters or digits get the score of a neutral text. Without
    a usable label of each class every score is 0. Other columns are ignored,
    whatever their names; with ``carry`` the result is all columns of ``docs`` as
    a struct ``record``, score and predicted.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    usable = labels.where(trainable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    total = usable.count()
    part = min(1.0, sample_rows / max(total, 1))
    pick = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 20)) < int(part * (1 << 20)) + (part == 1)
    cell = (2 * F.col("label") + F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(2))).cast("int").alias("cell")
    sample = cut(rows.join(usable.where(pick), "id").select("text", cell))
    head = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record") if carry else F.col(id_col).alias("id")
    given = docs.select(head, F.col(text_col).alias("text"))
    named = lambda df: df if carry else df.withColumnRenamed("id", id_col)
    if sample.where("cell >= 2").isEmpty() or sample.where("cell < 2").isEmpty():
        return named(given.select(given.columns[0], F.lit(0.0).alias("score"), F.lit(0).alias("predicted")))
    sc = docs.sparkSession.sparkContext
    ratios = sc.broadcast(fit_ratios(sample))
    found = sample.mapInArrow(_features(ratios), "cell int, " + ", ".join(f"f{i} double" for i in range(FEATURES))).toPandas().sort_values(["cell", *(f"f{i}" for i in range(FEATURES))])
    fitted = logistic(found[[f"f{i}" for i in range(FEATURES)]].to_numpy(), (found["cell"].to_numpy() >= 2).astype(float))
    scored = given.mapInArrow(_scorer(ratios, fitted), given.select(given.columns[0]).schema.add("score", "double"))
    return named(scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")))
