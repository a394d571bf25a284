"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles. Register j of its sketch
keeps the smallest value of the set under hash j as a leading-zero count and six
mantissa bits. Bands of five registers make 32 keys, and documents that share a
key are candidates. Candidates go through three gates: set sizes that allow the
threshold, the Jaccard estimate from all registers, corrected for registers that
agree by chance, and the exact comparison of the full sets.

Copies with the same set are one class and only its smallest id is sketched. In
a bucket every member is held against the one that shares buckets with most
documents, the likely original of its copies. Links are merged to components.
Where a bucket then still holds several, those outside its largest component are
compared with it and with each other, in blocks, first by sketches, then by full
sets, and only links leave a block. A group of n near copies thus costs about n
comparisons a band instead of n squared, no candidate pair of different
components goes unseen, and no list of candidate pairs of a group is ever made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import bound_batches, cut, tidy
from .words import Runs, U, Words, blocks, mix, run_starts

BANDS, ROWS, MANTISSA = 32, 5, 6
REGISTERS = BANDS * ROWS
_LANE = 6 + MANTISSA
_MUL = mix(np.arange(1, REGISTERS + 1, dtype=U)) | U(1)
_ADD = mix(np.arange(1001, REGISTERS + 1001, dtype=U))
#: Chance agreement of two registers without mantissa bits (HyperMinHash paper, approximate expected collisions).
_CHANCE = 0.169919487159739093975315012348
#: The estimate may be this much under the threshold; its deviation at 0.8 is 0.032, so a pair of that similarity fails with a probability of 1e-6.
SLACK = 0.15
#: Guests, and members, of one block.
BLOCK_ROWS = 1500
#: Pairs whose sets a verifier holds at a time.
VERIFY_ROWS = 128


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their bounds by text."""
    at = run_starts(w.bounds, size)
    runs = Runs(w.hashes)
    all_ = runs.at(at, size)
    count = np.diff(w.bounds)
    first = np.concatenate([[0], np.cumsum(np.maximum(count - size + 1, 0))])
    sets = [np.unique(all_[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    for i in np.flatnonzero((count > 0) & (count < size)):
        sets[i] = runs.at(w.bounds[i : i + 1], int(count[i]))
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def registers(minima: np.ndarray) -> np.ndarray:
    """Leading zeros (6 bits) and the bits after the leading one (MANTISSA bits) of 64-bit minima."""
    zeros = np.minimum(53 - np.frexp((minima >> U(11)).astype(np.float64))[1], 53).astype(U)
    return (zeros << U(MANTISSA)) | ((minima << (zeros + U(1))) >> U(64 - MANTISSA))


def sketch(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Band keys (sets x BANDS) of non-empty sets that begin at ``starts``."""
    out = np.zeros((len(starts), BANDS), U)
    for j in range(REGISTERS):
        r = registers(np.minimum.reduceat(values * _MUL[j] + _ADD[j], starts))
        out[:, j // ROWS] |= r << U(_LANE * (j % ROWS))
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates from band keys (pairs x BANDS) and set sizes."""
    lane = U((1 << _LANE) - 1)
    same = sum((((a ^ b) >> U(_LANE * k)) & lane == 0).sum(1) for k in range(ROWS)) / REGISTERS
    chance = _CHANCE * 2.0**-MANTISSA * 4 * n * m / (n + m) ** 2
    return (same - chance) / (1 - chance)


def _sketcher(size: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_all, hi_all, lo_all, keys = [], [], [], []
            for _, _, w in blocks(batch.column(1), True):
                values, bounds = shingle_sets(w, size)
                n = np.diff(bounds)
                full = n > 0
                hi, lo = np.zeros(len(n), U), np.zeros(len(n), U)
                bands = np.zeros((len(n), BANDS), U)
                if len(values):
                    starts = bounds[:-1][full]
                    hi[full] = np.add.reduceat(mix(values ^ U(0x5851F42D4C957F2D)), starts)
                    lo[full] = np.add.reduceat(mix(values ^ U(0x14057B7EF767814F)), starts)
                    bands[full] = sketch(values, starts)
                n_all.append(n)
                hi_all.append(hi)
                lo_all.append(lo)
                keys.append(bands)
            if not n_all:
                continue
            k = np.concatenate(keys).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1) * BANDS, pa.int32()), pa.array(k.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_all)), pa.array(np.concatenate(hi_all).view(np.int64)), pa.array(np.concatenate(lo_all).view(np.int64)), lists], ["id", "n", "hi", "lo", "bands"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(U).reshape(-1, BANDS)


def _estimator(percent: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy().astype(np.float64) for c in ("n", "m"))
            fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            fits &= estimate(_matrix(batch.column("bands_a")), _matrix(batch.column("bands_b")), n, m) >= percent / 100 - SLACK
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(fits))

    return run


def _verifier(size: int, percent: int):
    def sets(column: pa.Array) -> list[np.ndarray]:
        out = []
        for _, _, w in blocks(column, True):
            values, bounds = shingle_sets(w, size)
            out += np.split(values, bounds[1:-1])
        return out

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, VERIFY_ROWS):
                part = batch.slice(lo, VERIFY_ROWS)
                for x, y in zip(sets(part.column("ta")), sets(part.column("tb")), strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    of = lambda side, n: sketches.select(F.col("id").alias(side), F.col("n").alias(n), F.col("bands").alias(f"bands_{side}"))
    likely = cut(pairs.join(of("a", "n"), "a").join(of("b", "m"), "b").mapInArrow(_estimator(percent), "a long, b long"))
    needed = likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct()
    some = cut(texts.join(needed, "id", "left_semi").dropDuplicates(["id"]))
    both = likely.join(some.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(some.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(_verifier(size, percent), "a long, b long"))


def _blocks(size: int, percent: int):
    """Links between the guests of a block and all that is in it, for rows sorted by block."""

    def one(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows).combine_chunks()
        ids, comp, n = (t.column(c).to_numpy() for c in ("id", "c", "n"))
        guest = t.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        bands = _matrix(t.column("bands").combine_chunks())
        sets: list[np.ndarray] = []
        for _, _, w in blocks(t.column("text").combine_chunks(), True):
            values, bounds = shingle_sets(w, size)
            sets += np.split(values, bounds[1:-1])
        a, b = [], []
        for i in np.flatnonzero(guest):
            likely = estimate(bands[i], bands, n[i], n) >= percent / 100 - SLACK
            likely &= (comp != comp[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
            joined = set()
            for j in np.flatnonzero(likely):
                if comp[j] not in joined:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        joined.add(comp[j])
                        a.append(min(ids[i], ids[j]))
                        b.append(max(ids[i], ids[j]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("hub", "row", "col")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if key is not None and tuple(keys[lo]) != key:
                    if (out := one(held)) is not None:
                        yield out
                    held = []
                key = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held and (out := one(held)) is not None:
            yield out

    return run


def _settle(ranked: DataFrame, label: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components that share a bucket.

    The largest component of a bucket is its hub, and members of others are guests
    of the hub. A hub's guests are compared with its members and with each other
    in blocks of a bounded size; only links leave a block.
    """
    known = ranked.join(label, "id", "left").withColumn("c", F.coalesce("component", "id")).select("band", "key", "id", "c")
    sizes = known.groupBy("band", "key", "c").agg(F.count(F.lit(1)).alias("size"))
    hubs = sizes.groupBy("band", "key").agg(F.max(F.struct("size", "c")).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("size").alias("all")).where("parts > 1 and all > 2").select("band", "key", F.col("main.c").alias("hub"))
    guests = cut(known.join(hubs, ["band", "key"]).where("c <> hub").select("hub", "id", "c").distinct())
    members = known.select("id", "c").distinct().join(guests.select(F.col("hub").alias("c")).distinct(), "c", "left_semi").select(F.col("c").alias("hub"), "id", "c")
    present = guests.withColumn("guest", F.lit(True)).union(members.select("hub", "id", "c").withColumn("guest", F.lit(False)))
    shape = present.groupBy("hub").agg(F.ceil(F.count_if("guest") / BLOCK_ROWS).cast("int").alias("rows"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("cols"))
    spread = F.xxhash64("id")
    placed = present.join(shape, "hub")
    asked = placed.where("guest").select("hub", "id", "c", F.lit(True).alias("guest"), F.pmod(spread, F.col("rows")).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    all_ = placed.select("hub", "id", "c", F.lit(False).alias("guest"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(spread, F.col("cols")).cast("int").alias("col"))
    needed = present.select("id").distinct()
    facts = texts.join(needed, "id", "left_semi").dropDuplicates(["id"]).join(sketches.select("id", "n", "bands").dropDuplicates(["id"]), "id")
    dealt = asked.union(all_).join(facts, "id").select("hub", "row", "col", "guest", "id", "c", "n", "bands", "text")
    sorted_ = dealt.repartition("hub", "row", "col").sortWithinPartitions("hub", "row", "col")
    return cut(sorted_.mapInArrow(_blocks(size, percent), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` or more, directly or through others.

    Returns (id, n_shingles, component_id, kept), one row for each input row;
    component_id is the smallest id of the group and kept marks its row. Words
    are lower-cased in A-Z. A text with fewer words than a shingle is one shingle
    of all its words; null and empty texts have none and are linked with nothing.
    Rows that share an id are one document in the grouping (of different texts
    under one id any may stand for it). Rows with a null id stand alone, with a
    null component, and are kept. Other columns are ignored, whatever their names.
    A pair of similarity 0.8 shares no band with a probability of 3e-6.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    every = cut(rows.mapInArrow(_sketcher(shingle_words), "id long, n long, hi long, lo long, bands array<long>"))
    sketches = every.where("n > 0 and id is not null")
    classes = cut(sketches.groupBy("hi", "lo", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").drop("last"))
    copies = cut(sketches.join(classes, ["hi", "lo", "n"]).where("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b")))
    singles = sketches.join(copies.select(F.col("b").alias("id")), "id", "left_anti").dropDuplicates(["id"])
    banded = singles.select("id", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(banded.join(shared, ["band", "key"]))
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = cut(members.drop("size").join(degree, "id"))

    tops = ranked.groupBy("band", "key").agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"))).alias("top")).select("band", "key", (-F.col("top.neg")).alias("pivot"))
    stars = ranked.join(tops, ["band", "key"]).where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    links = _links(stars, sketches, rows, shingle_words, percent)
    label = components(links)
    links = links.union(_settle(ranked, label, sketches, rows, shingle_words, percent))

    final = components(copies.union(links))
    out = every.select("id", "n").join(final, "id", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), (F.col("component").isNull() | (F.col("id") == F.col("component"))).alias("kept"))
