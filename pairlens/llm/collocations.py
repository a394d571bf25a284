"""Phrase collocations by level-wise passes over the corpus.

Pass k reads every text once and emits a k-word phrase only where both of its
(k-1)-word parts are frequent. What is frequent reaches the tasks as a bit table of
hashes, built by Spark and never larger than 32 MB: it lets a rare phrase through
where hashes meet, never loses a frequent one, and exact counts decide afterwards,
so results do not depend on its size. Tasks count within their blocks of text before
anything is shuffled. Scores of cuts come from the level tables: parts that are too
common for a shuffled join, of which there are a bounded number, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import bound_batches, cut, tidy

U = np.uint64
#: Bytes of text that a task counts at a time.
BLOCK_BYTES = 4 << 20
#: Smallest and largest number of bits of a table of frequent phrases; bits a phrase.
BITS, BITS_EACH = (1 << 20, 1 << 28), 16
#: A part with at least one in so many words is broadcast: a level has at most so many of them.
COMMON = 2000
#: Groups in which a language's phrases are ranked first.
RANK_GROUPS = 256
#: 0: of a word, 1: between words, 2: between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2


class Block:
    """Words of some texts: distinct words, the number of each word, and whether word i and the next are of one piece."""

    def __init__(self, texts: list[str]):
        data = np.frombuffer("\n".join(texts).encode(), np.uint8)
        upper = (data >= 65) & (data <= 90)
        data = np.where(upper, data + 32, data)
        kind = _KIND[data]
        word = kind == 0
        edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
        starts, ends = edges[::2], edges[1::2]
        pieces = np.cumsum(kind == 2, dtype=np.int32)
        self.joined = pieces[starts[1:]] == pieces[ends[:-1] - 1]
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        column = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[word])])
        coded = column.dictionary_encode()
        self.words = coded.dictionary
        self.codes = coded.indices.to_numpy().astype(np.int64)

    def phrases(self, k: int, seed: int, table: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
        """Distinct k-word phrases whose (k-1)-word parts are in the table, and their counts."""
        ids = self.codes
        if k == 1:
            return self.words, np.bincount(ids, minlength=len(self.words))
        n = max(0, len(ids) - k + 1)
        if not n:
            return self.words.slice(0, 0), np.zeros(0, np.int64)
        own = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words.cast(pa.large_binary()).to_pylist()], U)[ids]
        hashed, whole = own, np.ones(len(ids), bool)
        for j in range(1, k - 1):
            hashed = (hashed[:-1] << U(13) | hashed[:-1] >> U(51)) ^ own[j:]
            whole = whole[:-1] & self.joined[j - 1 :][: len(hashed)]
        part = whole & in_table(table, hashed)
        good = part[:-1] & part[1:]
        # both parts lie within pieces; for single words nothing has looked at the break between them yet
        if k == 2:
            good &= self.joined
        at = np.flatnonzero(good)
        key = ids[at]
        for j in range(1, k):
            key = np.unique(key, return_inverse=True)[1] * np.int64(len(self.words)) + ids[at + j]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        columns = [self.words.take(pa.array(ids[at[first] + j])) for j in range(k)]
        return pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())), counts


def in_table(table: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether the bits of 64-bit hashes are set; a table has a power of two of bits."""
    bit = hashed & U(len(table) * 8 - 1)
    return (table[(bit >> U(3)).astype(np.int64)] >> (bit & U(7)).astype(np.uint8)) & 1 == 1


def _counter(k: int, table):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else np.frombuffer(table.value, np.uint8)
        waiting: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            block = Block(waiting.pop(lang))
            sizes.pop(lang)
            found, counts = block.phrases(k, xxhash.xxh64_intdigest(lang.encode(), 42), bits)
            found, counts = found.cast(pa.string()), pa.array(counts, pa.int64())
            for lo in range(0, len(found), 20_000):
                some = found.slice(lo, 20_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), some, counts.slice(lo, 20_000)], ["lang", "phrase", "n"])
            if k == 1:
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([len(block.codes)], pa.int64())], ["lang", "phrase", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= BLOCK_BYTES:
                    yield from flush(lang)
            while len(waiting) > 1 and sum(sizes.values()) >= 2 * BLOCK_BYTES:  # texts of many languages
                yield from flush(max(sizes, key=sizes.get))
        for lang in list(waiting):
            yield from flush(lang)

    return run


def bit_table(level: DataFrame, rows: int) -> bytes:
    """Bits of the hashes of a level's phrases: a power of two of bits, at most BITS[1], whatever the number of rows."""
    bits = min(BITS[1], max(BITS[0], 1 << (rows * BITS_EACH).bit_length()))
    rotated = lambda a: F.shiftleft(a, 13).bitwiseOR(F.shiftrightunsigned(a, 51))
    hashed = F.aggregate(F.split("phrase", " "), F.lit(0).cast("long"), lambda a, w: rotated(a).bitwiseXOR(F.xxhash64("lang", w)))
    at = level.select((hashed.bitwiseAND(F.lit(bits - 1).cast("long")) + 1).alias("bit"))
    parts = at.groupBy(F.call_function("bitmap_bucket_number", "bit").alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", "bit")).alias("map"))
    out = bytearray(bits // 8)
    for row in parts.collect():  # at most bits / 32768 rows of 4 kB
        lo = (row["bucket"] - 1) * 4096
        out[lo : lo + 4096] = row["map"]
    return bytes(out)


def phrase_levels(texts: DataFrame, max_words: int, min_count: int) -> list[DataFrame]:
    """Tables (lang, phrase, n) of the phrases of 1 to max_words words with min_count occurrences; the first also has each language's number of words, by a null phrase."""
    levels = []
    sc = texts.sparkSession.sparkContext
    for k in range(1, max_words + 1):
        table = None
        if k > 1:
            below = levels[-1].where("phrase IS NOT NULL")
            table = sc.broadcast(bit_table(below, below.count()))
        made = texts.mapInArrow(_counter(k, table), "lang string, phrase string, n long")
        counted = made.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        levels.append(cut(counted.where((F.col("n") >= min_count) | F.col("phrase").isNull())))
    return levels


def _with_counts(rows: DataFrame, parts: DataFrame, total: int) -> DataFrame:
    """rows with the count ``f`` of their (lang, part)."""
    common = F.col("f") * COMMON >= total
    hot, rest = F.broadcast(parts.where(common)), parts.where(~common)
    return rows.join(hot, ["lang", "part"]).unionByName(rows.join(F.broadcast(parts.where(common).select("lang", "part")), ["lang", "part"], "left_anti").join(rest, ["lang", "part"]))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = 3, min_count: int = 10, inside_percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the phrases of 2 to max_words words with at least min_count occurrences.

    A-Z are lower-cased; texts are split at ``.,;:!?`` and line breaks into pieces,
    those at spaces and tabs into words. Counts are of all occurrences within pieces,
    by language (null: ``und``). A cut scores floor(10^6 a^2 / (l r)), exact in
    decimals up to a = 10^16; a phrase's score is that of its lowest cut, the first
    of equals. A phrase within a longer one that has inside_percent of its count
    goes, also if the longer one has gone itself. ``rank`` is by score, a (both
    falling) and phrase (bytes), the first ``top`` of each language.

    Null texts are empty; repeated rows count each time; ids are not read; an empty
    table, or one without frequent phrases, gives no rows. Long texts pass whole, in
    one block each. Other columns are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    levels = phrase_levels(texts, max_words, min_count)
    totals = levels[0].where("phrase IS NULL").select("lang", F.col("n").alias("words"))
    total = totals.agg(F.sum("words")).first()[0] or 0
    several = [level.withColumn("w", F.split("phrase", " ")) for level in levels[1:]]
    phrase = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts, inside = [], []
    for k, level in enumerate(several, 2):
        both = [F.struct(F.lit(j).alias("j"), F.lit(side).alias("side"), phrase(*at).alias("part")) for j in range(1, k) for side, at in (("l", (1, j)), ("r", (j + 1, k - j)))]
        cuts.append(level.select("lang", "phrase", F.explode(F.array(*both)).alias("x")).select("lang", "phrase", "x.*"))
        if subs := [phrase(i + 1, size) for size in range(2, k) for i in range(k - size + 1)]:
            inside.append(level.select("lang", F.explode(F.array_distinct(F.array(*subs))).alias("phrase"), F.col("n").alias("longer")))
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    parts = union([level.where("phrase IS NOT NULL").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")) for level in levels[:-1]])
    counted = _with_counts(union(cuts), parts, total)
    rows = union([level.select("lang", "phrase", F.col("n").alias("a")) for level in several])
    for more in [counted.select("lang", "phrase", "j", "side", "f"), *inside]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    if not inside:
        rows = rows.withColumn("longer", F.lit(None).cast("long"))
    of = lambda j, side: F.max(F.when((F.col("j") == j) & (F.col("side") == side), F.col("f")))
    judged = rows.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *[of(j, s).alias(f"{s}{j}") for j in range(1, max_words) for s in "lr"])
    judged = judged.where("a IS NOT NULL").where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("a")))
    exact = lambda name: f"CAST({name} AS DECIMAL(19, 0))"
    cut_of = lambda j: F.when(F.col(f"l{j}").isNotNull(), F.struct(F.expr(f"({exact('a')} * {exact('a')} * CAST(1000000 AS DECIMAL(7, 0))) div ({exact(f'l{j}')} * {exact(f'r{j}')})").alias("score"), F.lit(j).alias("j"), F.col(f"l{j}").alias("l"), F.col(f"r{j}").alias("r")))
    found = [cut_of(j) for j in range(1, max_words)]
    scored = judged.select("lang", "phrase", "a", (F.least(*found) if len(found) > 1 else found[0]).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within groups of a language, so that no task ranks a whole language
    group = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))).orderBy(*order)
    scored = scored.withColumn("place", F.row_number().over(group)).where(F.col("place") <= top).drop("place")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
