"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters records by a seeded hash: rendezvous hashing picks the shard
(the shard whose hash with the id is largest), and a second hash picks one of the
shard's buckets, of which there are enough, by bytes, that each fits in memory. Pass two
Fisher-Yates-shuffles every bucket and lays buckets end to end. With one more
shard a record moves only if the new shard's hash is its largest, so growth
moves 1/(n+1) of the records, all into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The number below ``shards`` whose seeded hash with the key is largest."""
    draws = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*draws))["s"]


def _bytes(docs: DataFrame) -> Column:
    """About how many bytes a row has: its strings and binaries, and 16 for each other column."""
    plain = 16 * sum(1 for f in docs.schema if f.dataType.simpleString() not in ("string", "binary")) + 16
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)).cast("long") for f in docs.schema if f.dataType.simpleString() in ("string", "binary")]
    return sum(wide, F.lit(plain).cast("long"))


def _scatter(docs: DataFrame, key_col: str, shards: int, seed: int, bucket_bytes: int) -> DataFrame:
    """(record, shard, grown_shard, scatter, bucket): pass one."""
    key = F.col(f"`{key_col}`").cast("string")
    atomic = [F.col(f"`{f.name}`") for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    total = docs.agg(F.sum(_bytes(docs)).alias("b")).first()["b"] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), rendezvous(key, shards, seed).alias("shard"), rendezvous(key, shards + 1, seed).alias("grown_shard"), F.xxhash64(F.lit(seed + 1), key, *atomic).alias("scatter"))
    return placed.withColumn("bucket", F.pmod("scatter", F.lit(buckets)).cast("int")).repartition(max(4, min(shards * buckets, 20_000)), "shard", "bucket")


def shard_rows(docs: DataFrame, key_col: str, shards: int, seed: int = 17, bucket_bytes: int = 8 << 20) -> DataFrame:
    """All columns of ``docs`` as a struct ``record``, with shard, bucket, slot and grown_shard (the shard among ``shards`` + 1).

    Slots of a shard run from 0 without gaps in a random order that the seed and
    the rows fix; a bucket's slots stand together. Null keys are one key. Rows with
    one key share a shard but not a bucket, unless they are equal in all columns;
    equal texts under different keys are spread like any others. Buckets hold about
    ``bucket_bytes`` of rows, or one row that is larger. A shard without rows does
    not appear. An empty table gives no rows. Columns that are already called shard
    or slot stay inside ``record``.
    """
    placed = _scatter(docs, key_col, shards, seed, bucket_bytes)
    sizes = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("offset"))
    scattered = placed.sortWithinPartitions("shard", "bucket", "scatter", F.xxhash64(F.to_json("record")))
    shuffled = scattered.groupBy("shard", "bucket").agg(F.shuffle(F.collect_list(F.struct("record", "grown_shard")), seed).alias("rows"))
    out = shuffled.join(offsets, ["shard", "bucket"]).select("shard", "bucket", "offset", F.posexplode("rows").alias("pos", "row"))
    return out.select(F.col("row.record").alias("record"), "shard", "bucket", (F.col("offset") + F.col("pos")).alias("slot"), F.col("row.grown_shard").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, key_col: str, shards: int, seed: int = 17, bucket_bytes: int = 8 << 20) -> None:
    """Write the records as Parquet, one folder a shard and one file a bucket, rows of a file in slot order; a shard's slots run on from file to file."""
    placed = shard_rows(docs, key_col, shards, seed, bucket_bytes)
    dealt = placed.repartition(max(shards, placed.select("shard", "bucket").distinct().count()), "shard", "bucket").sortWithinPartitions("shard", "bucket", "slot")
    dealt.select("record.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.partitionBy("_shard").parquet(path)
