"""Chroma audio fingerprints and alignment of recordings.

Audio is 16-bit little-endian mono PCM. Frames are Fourier-transformed and their
energy folded into twelve pitch classes. Sixteen box filters over a window of
WIDTH frames, evaluated on an integral image, compare the energies of two areas;
each result becomes two Gray-coded bits, which makes one 32-bit code a position.
Two codes a window apart, less a quarter of their bits, make a key, for each
quarter in turn: single codes have too few distinct values to tell recordings
apart in a large collection, and leaving out bits lets noisy codes meet.
Recordings that share a key are compared bit by bit at every offset between two
positions of a shared key, however often a key repeats; the best offset counts.

Recordings with equal codes are one class, and only classes are aligned: a
recording that stands a million times is looked up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bound_batches, cut
from .words import U, mix

WIDTH, FILTERS, CLASSES = 8, 16, 12
#: Bits of a code that the keys of each turn use.
_KEPT = [U(sum(1 << i for i in range(2 * FILTERS) if i % 4 != k)) for k in range(4)]
#: Codes of one block of recordings; a longer recording is a block by itself.
BLOCK_CODES = 200_000


def _filters() -> list[tuple[int, int, int, int, bool]]:
    """(first class, classes, first frame, frames, split by time) by rule: three heights over the classes, split by class or by time in turn."""
    out = []
    for i in range(FILTERS):
        high = (4, 6, 12)[i % 3]
        out.append(((i * 5) % (CLASSES - high + 1), high, (i * 3) % 3, (WIDTH - 2, 4)[i % 2], bool((i // 3) % 2)))
    return out


_BOXES = _filters()


def chroma(samples: np.ndarray, rate: int, frame: int, hop: int) -> np.ndarray:
    """(frames, 12) energies by pitch class, each frame of unit sum; silent frames are zero."""
    if len(samples) < frame:
        samples = np.pad(samples, (0, frame - len(samples)))
    views = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]
    power = np.abs(np.fft.rfft(views * np.hanning(frame), axis=1)) ** 2
    freq = np.fft.rfftfreq(frame, 1 / rate)
    use = np.flatnonzero((freq >= 60) & (freq <= 0.45 * rate))
    fold = np.zeros((len(freq), CLASSES))
    fold[use, np.round(12 * np.log2(freq[use] / 440)).astype(int) % CLASSES] = 1
    out = power @ fold
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 1e-3)


def codes(image: np.ndarray) -> np.ndarray:
    """32-bit codes of the windows of a chroma image; none for images shorter than a window."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    sums = np.zeros((len(image) + 1, CLASSES + 1))
    sums[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)
    area = lambda t0, t1, c0, c1: sums[at + t1, c1] - sums[at + t0, c1] - sums[at + t1, c0] + sums[at + t0, c0]
    out = np.zeros(n, np.uint32)
    for c, high, t, wide, by_time in _BOXES:
        if by_time:
            a, b = area(t, t + wide // 2, c, c + high), area(t + wide // 2, t + wide, c, c + high)
        else:
            a, b = area(t, t + wide, c, c + high // 2), area(t, t + wide, c + high // 2, c + high)
        level = np.log((a + 0.01) / (b + 0.01))
        step = np.searchsorted([-0.6, 0.0, 0.6], level)
        out = (out << np.uint32(2)) | (step ^ (step >> 1)).astype(np.uint32)
    return out


def _printer(rate: int, frame: int, hop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for audio in batch.column(1):
                raw = audio.as_py() if audio.is_valid else b""
                samples = np.frombuffer(raw, "<i2", len(raw) // 2).astype(np.float64) / 32768
                out.append(codes(chroma(samples, rate, frame, hop)).view(np.int32) if len(samples) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], ["id", "codes"])

    return run


def fingerprint_audio(media: DataFrame, id_col: str, audio_col: str, rate: int = 4000, frame: int = 512, hop: int = 250) -> DataFrame:
    """(id, codes) by row; null, empty and too short recordings have no codes."""
    bound_batches(media.sparkSession)
    return media.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio")).mapInArrow(_printer(rate, frame, hop), f"id {media.schema[id_col].dataType.simpleString()}, codes array<int>")


def _turn_keys(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each turn, the keys of the positions ``at``."""
    return [mix((((values[at] & m) << U(32)) | (values[at + WIDTH] & m)) ^ U(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) for k, m in enumerate(_KEPT)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct keys of recordings (class_id, codes)."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
        block = (np.cumsum(sizes) - sizes) // BLOCK_CODES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part, n = batch.slice(lo, hi - lo), sizes[lo:hi]
            values = part.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(U)
            row = np.repeat(np.arange(hi - lo), n)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = np.flatnonzero(pos + WIDTH < n[row])
            if not len(at):
                continue
            key = np.concatenate(_turn_keys(values, at))
            row = np.tile(row[at], len(_KEPT))
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[new])), pa.array(key[new].view(np.int64))], ["class_id", "key"])


def voted_offsets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All offsets between a position of a key in ``a`` and one in ``b``, rising."""
    voted = np.zeros(len(a) + len(b), bool)
    ka, kb = (_turn_keys(x.astype(U), np.arange(max(len(x) - WIDTH, 0))) for x in (a, b))
    for x, y in zip(ka, kb, strict=True):
        order = np.argsort(y, kind="stable")
        lo, hi = (np.searchsorted(y[order], x, side) for side in ("left", "right"))
        n = hi - lo
        met = np.flatnonzero(n)
        block = (np.cumsum(n[met]) - n[met]) // BLOCK_CODES
        for part in np.split(met, np.flatnonzero(np.diff(block)) + 1):
            m = n[part]
            within = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            voted[order[np.repeat(lo[part], m) + within] - np.repeat(part, m) + len(a)] = True
    return np.flatnonzero(voted) - len(a)


def _verify(max_error: float, min_overlap: int):
    """The offset with the smallest error of each pair (a, b, members_b, codes_a, codes_b), the longest overlap of equal ones; pairs over ``max_error`` give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (va, oa), (vb, ob) = ((c.values.to_numpy(zero_copy_only=False).view(np.uint32), c.offsets.to_numpy()) for c in (batch.column(3), batch.column(4)))
            row, offset, error = [], [], []
            for i in range(batch.num_rows):
                a, b = va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]
                best = None
                for o in voted_offsets(a, b).tolist():
                    x, y = a[max(0, -o) :], b[max(0, o) :]
                    m = min(len(x), len(y))
                    if m >= min_overlap:
                        found = (int(np.bitwise_count(x[:m] ^ y[:m]).sum(dtype=np.int64)) / (m * 32.0), -m, o)
                        best = found if best is None else min(best, found)
                if best is not None and best[0] <= max_error:
                    row.append(i)
                    offset.append(best[2])
                    error.append(best[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row, pa.int32())) for c in range(3)), pa.array(offset, pa.int32()), pa.array(error, pa.float64())], ["a", "b", "members_b", "offset", "error"])

    return run


def _classes(prints: DataFrame, is_query: Column) -> tuple[DataFrame, DataFrame]:
    """(recordings with their codes' hashes, classes of equal codes)."""
    full = prints.where("size(codes) > 0")
    keyed = full.select("id", "codes", F.xxhash64("codes").alias("h1"), F.sha2(F.array_join("codes", ",").cast("binary"), 256).alias("h2"), is_query.alias("q"))
    return keyed, cut(keyed.groupBy("h1", "h2").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"), F.bool_or("q").alias("asked"), F.any_value("codes").alias("codes")))


def _links(classes: DataFrame, max_error: float, min_overlap: int) -> DataFrame:
    if min_overlap <= WIDTH:
        raise ValueError(f"min_overlap must be more than {WIDTH}")
    kind = classes.schema["class_id"].dataType.simpleString()
    keys_of = lambda df, s: df.select("class_id", "codes").mapInArrow(_keys, f"class_id {kind}, key long").select(F.col("class_id").alias(s), "key")
    pairs = keys_of(classes.where("asked"), "a").join(keys_of(classes, "b"), "key").where("a <> b").select("a", "b").distinct()
    codes_of = lambda s: classes.select(F.col("class_id").alias(s), F.col("codes").alias(f"codes_{s}"), F.col("members").alias(f"members_{s}"))
    pair = pairs.join(codes_of("a"), "a").join(codes_of("b"), "b").select("a", "b", "members_b", "codes_a", "codes_b")
    return pair.mapInArrow(_verify(max_error, min_overlap), f"a {kind}, b {kind}, members_b long, offset int, error double")


def recording_links(prints: DataFrame, is_query: Column, max_error: float = 0.06, min_overlap: int = 16) -> DataFrame:
    """(a, b, members_b, offset, error): the classes b that a class a with a query among its recordings is linked with, by the smallest ids of both.

    Rows of (id, codes) with a null id or without codes are in no class.
    """
    return _links(_classes(cut(prints.where("id is not null")), is_query)[1], max_error, min_overlap)


def align_recordings(prints: DataFrame, is_query: Column, max_error: float = 0.06, min_overlap: int = 16) -> DataFrame:
    """(id, n_codes, class_id, is_query, n_links, best_match, best_offset, best_error) of each row of (id, codes) with an id.

    A query is linked with every other recording whose codes, at an offset between
    positions of a shared key, differ in at most ``max_error`` of the bits over at
    least ``min_overlap`` positions, and with the other recordings of its own class.
    best_match is the class it aligns with best, its own if that has others.
    Recordings without codes and those that are no query have no links (null).
    Rows with a null id are left out; of rows with one id and the same codes each
    comes back. Other columns are ignored. An empty table gives no rows. Keys span
    two windows, so ``min_overlap`` must be more than WIDTH.
    """
    prints = cut(prints.where("id is not null"))
    keyed, classes = _classes(prints, is_query)
    linked = _links(classes, max_error, min_overlap)
    per = linked.groupBy("a").agg(F.sum("members_b").alias("others"), F.min(F.struct("error", "b", "offset")).alias("near"))
    asked = classes.join(per, classes["class_id"] == per["a"], "left").select("h1", "h2", "class_id", "members", "others", "near")
    out = keyed.select("id", "h1", "h2", "q").join(asked, ["h1", "h2"])
    rest = prints.select("id", F.size("codes").alias("n_codes"), is_query.alias("is_query"))
    links = F.when(F.col("q"), F.coalesce("others", F.lit(0)) + F.col("members") - 1)
    copy = F.col("members") > 1
    found = out.select("id", "class_id", links.alias("n_links"), F.when(F.col("q"), F.when(copy, F.col("class_id")).otherwise(F.col("near.b"))).alias("best_match"), F.when(F.col("q"), F.when(copy, 0).otherwise(F.col("near.offset"))).alias("best_offset"), F.when(F.col("q"), F.when(copy, 0.0).otherwise(F.col("near.error"))).alias("best_error")).dropDuplicates(["id"])
    return rest.join(found, "id", "left")


def with_echoes(vectors: DataFrame, id_col: str, vector_col: str, every: int = 20, after: int = 7) -> DataFrame:
    """(id, v, noisy): the vectors, where that of every id n * every + after goes on from the last two thirds of the vector of n * every into the first third of its own. ``noisy`` marks those."""
    own = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    source = own.where(F.col("id") % every == 0).groupBy((F.col("id") + after).alias("id")).agg(F.min("v").alias("s"))
    third = F.greatest((F.size("s") / 3).cast("int"), F.lit(0))
    echo = F.concat(F.slice("s", third + 1, F.greatest(F.size("s") - third, F.lit(0))), F.slice("v", F.lit(1), third))
    return own.join(source, "id", "left").select("id", F.when(F.col("s").isNotNull() & F.col("v").isNotNull(), echo).otherwise(F.col("v")).alias("v"), (F.col("s").isNotNull() & F.col("v").isNotNull()).alias("noisy"))


def render_tones(vectors: DataFrame, id_col: str, vector_col: str, rate: int = 4000, samples: int = 250, noisy: str | None = None) -> DataFrame:
    """(id, audio): each value of a vector sounds as one tone of five octaves' notes, loudness rising with its size; where the column ``noisy`` is true, under noise of a thirtieth of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(samples) / rate
        tones = np.sin(2 * np.pi * (110 * 2 ** (np.arange(48) / 12))[:, None] * t)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for v, loud in zip(part.column(1), part.column(2).to_pylist(), strict=True):
                    x = np.nan_to_num(np.array(v.as_py() or [], np.float64).astype(float))
                    note = np.clip(np.round(24 + 80 * x), 0, 47).astype(int)
                    sound = tones[note] * 20000
                    if loud:
                        sound = sound + np.random.default_rng(len(sound)).uniform(-700, 700, sound.shape)
                    out.append(sound.astype("<i2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["id", "audio"])

    loud = F.lit(False) if noisy is None else F.coalesce(noisy, F.lit(False))
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), loud.alias("loud")).mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, audio binary")
