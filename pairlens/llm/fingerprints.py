"""One-permutation MinHash fingerprints, in DataFrame functions only.

The shingles of a text are hashed once. The top eight bits of a hash pick one of
256 bins and each bin keeps its smallest hash. An empty bin takes the value of
another: it asks bins in a fixed pseudo-random order of its own until one has a
value (optimal densification); the first PROBES bins of the order come from a
table, and should all be empty the rest are ranked by a hash of both bins. Of each
bin the lowest four bits are stored, sixteen bins to a long. Two values agree by
chance in one of 16 bins, so a share m of equal bins estimates the Jaccard
similarity as (m - 1/16) / (1 - 1/16).
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

BINS, BITS, PROBES = 256, 4, 24
SPACE = "[\\x20\\x09-\\x0D]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once."""
    return F.transform(F.array(value), then)[0]


def _order() -> Column:
    draw = random.Random(4)
    return F.array(*[F.array(*[F.lit(draw.randrange(BINS)) for _ in range(PROBES)]) for _ in range(BINS)])


def _bin(x: Column) -> Column:
    """0..255 in the order of signed longs."""
    return (F.shiftright(x, 64 - 8) + BINS // 2).cast("int")


def _densify(found: Column, dense: Column) -> Column:
    def later(i: Column) -> Column:
        ranked = F.transform(found, lambda x: F.struct(F.xxhash64(i, _bin(x)).alias("h"), x.bitwiseAND((1 << BITS) - 1).cast("int").alias("v")))
        return F.array_min(ranked)["v"]

    def fill(v: Column, i: Column) -> Column:
        probed = F.aggregate(F.get(_order(), i), F.lit(-1), lambda acc, b: F.when(acc >= 0, acc).otherwise(F.get(dense, b)))
        return F.when(v >= 0, v).otherwise(let(probed, lambda p: F.when(p >= 0, p).otherwise(later(i))))

    return F.when(F.size(found) == BINS, dense).otherwise(F.transform(dense, fill))


def _pack(dense: Column) -> Column:
    per = 64 // BITS
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), lambda k: F.aggregate(F.slice(dense, k * per + 1, per), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v.cast("long"))))


def fingerprint(text: Column, shingle_words: int = 5) -> Column:
    """Packed fingerprint, an array of longs; an empty array for texts without words and nulls."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")

    def shingles(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - shingle_words + 1), lambda i: F.xxhash64(F.slice(w, i, shingle_words)))
        return F.when(F.size(w) >= shingle_words, runs).otherwise(F.array(F.xxhash64(w)))

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def lay(found: Column) -> Column:
        gaps = F.transform(found, lambda x, i: F.concat(F.array_repeat(F.lit(-1), _bin(x) - F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get(found, i - 1))) - 1), F.array(x.bitwiseAND((1 << BITS) - 1).cast("int"))))
        return F.concat(F.flatten(gaps), F.array_repeat(F.lit(-1), BINS - 1 - _bin(F.element_at(found, -1))))

    full = lambda w: let(let(F.sort_array(shingles(w)), smallest), lambda found: let(let(lay(found), lambda d: _densify(found, d)), _pack))
    return let(words, lambda w: F.when(F.size(w) > 0, full(w)).otherwise(F.array().cast("array<bigint>")))


def likeness(a: Column, b: Column) -> Column:
    """Bias-corrected Jaccard estimate of two fingerprints; two empty ones are alike, an empty one is unlike others."""
    low = int("1" * (64 // BITS), 16)

    def equal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(low)
        return F.lit(64 // BITS) - F.bit_count(d)

    share = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda acc, n: acc + n.cast("int")) / F.lit(float(BINS))
    chance = 2.0**-BITS
    corrected = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(corrected)


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _buckets(docs: DataFrame, rows: int, bucket_rows: int) -> Column:
    """Rising bucket numbers by ``id``: 256 quantile ranges at most, each cut into equal widths."""
    wanted = max(1, -(-rows // bucket_rows))
    ranges = min(wanted, 256)
    inner = -(-wanted // ranges)
    edges = docs.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)] or [0.5], 10_000).alias("e"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    at = sorted({edges["lo"], *(edges["e"] if ranges > 1 else []), edges["hi"]})
    ladder = []
    for k in range(len(at) - 1):
        width = max(1, at[k + 1] - at[k])
        sub = F.least(F.lit(inner - 1), F.floor((F.col("id").cast("double") - at[k]) * inner / width).cast("int")) if inner > 1 else F.lit(0)
        ladder.append((at[k], k * inner + sub))

    def choose(steps: list) -> Column:
        if len(steps) == 1:
            return steps[0][1]
        half = len(steps) // 2
        return F.when(F.col("id") >= steps[half][0], choose(steps[half:])).otherwise(choose(steps[:half]))

    return choose(ladder).cast("int") if ladder else F.lit(0)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, bucket_rows: int = 1500) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The next document is the one with the next smaller id, after the smallest id
    the largest; rows with one id follow each other by a hash of their texts, and
    null ids come last, with the smallest long. The edited text has the last third of its characters
    (rounded down) replaced by as many first characters of the next document, or
    all if it has fewer. Returns (id, n_chars, edited_text, next_text, packed,
    edited_packed, next_packed, near_edited, near_next), one row for each input
    row. Null texts are empty. A lone row is its own next document. Other columns
    are ignored, whatever their names.
    """
    missing = -(2**63)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("own"), F.coalesce(F.col(id_col).cast("long"), F.lit(missing)).alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    n = docs.count()
    if not n:
        numbered = rows.withColumn("bucket", F.lit(0))
    else:
        numbered = rows.withColumn("bucket", _buckets(rows.select("id"), n, bucket_rows))
    heads = cut(numbered.groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("head")))
    order = Window.orderBy(F.desc("bucket"))
    first = heads.agg(F.max_by("head", "bucket").alias("first"))
    after = heads.withColumn("after", F.lead("head").over(order)).crossJoin(F.broadcast(first)).select("bucket", F.coalesce("after", "first").alias("after"))
    wanted = after.select(F.col("after.id").alias("id"), F.col("after.tie").alias("tie")).distinct()
    found = rows.join(wanted, ["id", "tie"]).dropDuplicates(["id", "tie"])
    after = cut(after.join(found, (F.col("after.id") == found["id"]) & (F.col("after.tie") == found["tie"])).select(F.col("bucket").alias("b"), F.col("text").alias("after_text"), fingerprint(F.col("text"), shingle_words).alias("after_packed")))

    by = Window.partitionBy("bucket").orderBy(F.desc("id"), F.desc("tie"))
    printed = numbered.withColumn("packed", fingerprint(F.col("text"), shingle_words))
    ahead = printed.select("id", "own", "bucket", "text", "packed", F.lead("text").over(by).alias("lead_text"), F.lead("packed").over(by).alias("lead_packed"))
    joined = ahead.join(after, (F.col("bucket") == F.col("b")) & F.col("lead_packed").isNull(), "left")
    whole = joined.select("own", "text", "packed", F.coalesce("lead_text", "after_text").alias("next_text"), F.coalesce("lead_packed", "after_packed").alias("next_packed"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))"))
    out = whole.select("*", edited.alias("edited_text")).withColumn("edited_packed", fingerprint(F.col("edited_text"), shingle_words))
    return out.select(F.col("own").alias(id_col), F.length("text").cast("long").alias("n_chars"), "edited_text", "next_text", "packed", "edited_packed", "next_packed", likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), likeness(F.col("packed"), F.col("next_packed")).alias("near_next"))
