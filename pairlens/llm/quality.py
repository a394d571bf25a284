"""Document quality by hierarchical empirical Bayes over hosts and paths.

A logistic classifier on text statistics, fitted on a bounded sample of labelled
rows, gives each document its evidence. Host and path means of that evidence are
shrunk: hosts toward the corpus, paths toward their host, by beta priors whose
strengths come from the spread between sites (method of moments). A document's
score adds to its own log-odds those of its path, without the document's own
share, relative to the corpus: a site with few documents says little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bound_batches, cut
from .toxicity import logistic
from .words import U, Words, blocks

STATISTICS = ("words", "length", "distinct", "upper", "exclaim", "bars", "digits", "marks", "lines", "doubled", "high")
_GROUPS = np.zeros((6, 256))
_GROUPS[0, 65:91] = 1
_GROUPS[1, 33] = 1
_GROUPS[2, [124, 60, 62, 123, 125]] = 1
_GROUPS[3, 48:58] = 1
_GROUPS[4, [33, 34, *range(39, 48), 58, 59, 63]] = 1
_GROUPS[5, 128:] = 1


def statistics(w: Words) -> np.ndarray:
    """One row of STATISTICS a text, squares after them; zeros for texts without words."""
    n = np.diff(w.bounds)
    size = np.maximum(np.diff(w.offsets), 1)
    text = w.text_of()
    per = lambda x, by: np.bincount(text if by == "word" else np.repeat(np.arange(len(n)), np.diff(w.offsets)), x, minlength=len(n))
    m = np.maximum(n, 1)
    keys = w.hashes ^ (text.astype(U) * U(0x9E3779B97F4A7C15))
    distinct = np.bincount(text[np.unique(keys, return_index=True)[1]], minlength=len(n))
    same = np.zeros(len(w.hashes))
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (text[1:] == text[:-1])
    shares = [per(g[w.data], "byte") / size for g in _GROUPS]
    lines = per((w.data == 10).astype(float), "byte")
    cols = [np.log1p(n), per((w.ends - w.starts).astype(float), "word") / m, distinct / m, *shares[:5], lines / m, per(same, "word") / m, shares[5]]
    x = np.stack(cols, 1)
    return np.concatenate([x, x * x], 1) * (n > 0)[:, None]


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, w in blocks(batch.column(0), False):
            x = statistics(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(1))[lo:hi]), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])


def _evidence(fitted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, mean, dev = fitted
        for batch in batches:
            odds = np.zeros(batch.num_rows)
            for lo, hi, w in blocks(batch.column(batch.num_columns - 1), False):
                odds[lo:hi] = np.clip((statistics(w) - mean) / dev @ weights[:-1] + weights[-1], -12, 12)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(odds)], [*batch.schema.names[:-1], "odds"])

    return run


def _strength(sites: DataFrame, n: str, mean: Column, overall: Column) -> Column:
    """Beta prior strength from sites (n, mean): overall variance over the variance between sites beyond that within."""
    within = overall * (1 - overall)
    between = F.sum(F.col(n) * (mean - overall) ** 2) / F.sum(n)
    noise = within * F.count(F.lit(1)) / F.sum(n)
    return F.least(F.lit(1e4), F.greatest(F.lit(1.0), within / F.greatest(between - noise, F.lit(1e-9)) - 1))


def quality(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", sample_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """(id, evidence, host_posterior, path_posterior, score, keep), one row for each input row.

    ``labels`` marks some ids 1 (good) or 0; at most about ``sample_rows`` of those
    for which ``trainable`` holds are learned from, picked by a hash of the id.
    Null hosts and paths are sites of their own. Null and empty texts have the
    evidence of a text with zero statistics. Without both labels the evidence is
    0.5 for all and everything is kept. Other columns are ignored, whatever their
    names.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(host_col).isNull().alias("no_host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(path_col).isNull().alias("no_path"), F.col(text_col).alias("text"))
    usable = labels.where(trainable & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    part = min(1.0, sample_rows / max(usable.count(), 1))
    pick = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 20)) < int(part * (1 << 20)) + (part == 1)
    sample = rows.join(usable.where(pick), "id").select("text", "label").mapInArrow(_sample, "label int, x array<double>").toPandas()
    y = sample["label"].to_numpy().astype(float)
    k = 2 * len(STATISTICS)
    if 0 < y.sum() < len(y):
        x = np.stack(sample["x"].to_numpy())
        order = np.lexsort((*x.T, y))
        fitted = logistic(x[order], y[order])
    else:
        fitted = (np.zeros(k + 1), np.zeros(k), np.ones(k))
    site = ["no_host", "host", "no_path", "path"]
    judged = cut(rows.mapInArrow(_evidence(fitted), "id " + docs.schema[id_col].dataType.simpleString() + ", host string, no_host boolean, path string, no_path boolean, odds double")).withColumn("p", 1 / (1 + F.exp(-F.col("odds"))))
    paths = cut(judged.groupBy(*site).agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("no_host", "host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    overall = hosts.agg((F.sum("hs") / F.sum("hn")).alias("m"))
    host_k = hosts.crossJoin(F.broadcast(overall)).groupBy("m").agg(_strength(hosts, "hn", F.col("hs") / F.col("hn"), F.col("m")).alias("hk"))
    hosted = hosts.crossJoin(F.broadcast(host_k)).withColumn("host_posterior", (F.col("hs") + F.col("hk") * F.col("m")) / (F.col("hn") + F.col("hk")))
    placed = paths.join(hosted, ["no_host", "host"])
    path_k = placed.groupBy("m").agg(_strength(placed, "n", F.col("s") / F.col("n") - F.col("host_posterior") + F.col("m"), F.col("m")).alias("pk")).select("pk")
    sites = cut(placed.crossJoin(F.broadcast(path_k)).select(*site, "n", "s", "m", "pk", "host_posterior"))
    joined = judged.join(sites, site)
    prior = (F.col("s") - F.col("p") + F.col("pk") * F.col("host_posterior")) / (F.col("n") - 1 + F.col("pk"))
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    score = 1 / (1 + F.exp(-(F.col("odds") + logit(prior) - logit(F.col("m")))))
    out = joined.select(F.col("id").alias(id_col), F.col("p").alias("evidence"), "host_posterior", ((F.col("s") + F.col("pk") * F.col("host_posterior")) / (F.col("n") + F.col("pk"))).alias("path_posterior"), score.alias("score"))
    return out.withColumn("keep", F.col("score") >= threshold)
