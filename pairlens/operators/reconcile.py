"""Joins that prove two sets of rows agree, and keyed upserts that never change a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def identity_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that only one side has."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    return a.join(b, key, "full_outer").where("_l is null or _r is null").select(key, F.when(F.col("_r").isNull(), "missing").otherwise("extra").alias("problem"))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises when it runs if a key is on one side only."""
    joined = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), key, "full_outer")
    bad = F.col("_l").isNull() | F.col("_r").isNull()
    return joined.where(F.when(bad, F.raise_error(F.concat(F.lit("row on one side only: "), F.col(key).cast("string")))).isNull()).drop("_l", "_r")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def pending(schedule: DataFrame, records: DataFrame, key: str = "request_id") -> DataFrame:
    """Scheduled units without a terminal record."""
    return schedule.join(records.select(key), key, "left_anti")


def differences(saved: DataFrame, recomputed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, saved, recomputed): one row for each value that differs, nulls included, and for each one-sided key."""
    a = saved.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("_a"))
    b = recomputed.select(*keys, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("_b"))
    both = a.join(b, keys, "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_a.{c}").alias("saved"), F.col(f"_b.{c}").alias("recomputed"), F.col("_a").isNull().alias("no_a"), F.col("_b").isNull().alias("no_b")) for c in columns])
    return both.select(*keys, F.inline(cells)).where("no_a or no_b or not (saved <=> recomputed)").drop("no_a", "no_b")


def immutable_upsert(existing: DataFrame, incoming: DataFrame, key: str, content: Column, strict: bool = True) -> DataFrame:
    """Rows of ``incoming`` that are new. A known key with other content raises, or with strict off is returned as a conflict."""
    old = existing.select(key, F.sha2(content.cast("string"), 256).alias("_old"))
    hashed = incoming.withColumn("_new", F.sha2(content.cast("string"), 256)).join(old, key, "left")
    clash = F.col("_old").isNotNull() & (F.col("_old") != F.col("_new"))
    if strict:
        # One condition: a second filter on _old would run first and hide the clash.
        changed = F.raise_error(F.concat(F.lit("changed content under "), F.col(key).cast("string"))).cast("boolean")
        return hashed.where(F.when(clash, changed).otherwise(F.col("_old").isNull())).drop("_old", "_new")
    return hashed.where(F.col("_old").isNull() | clash).withColumn("action", F.when(clash, "conflict").otherwise("insert")).drop("_old", "_new")


def merge_by_priority(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """Rows of both, one a key, those of ``primary`` first."""
    both = primary.withColumn("_p", F.lit(0)).unionByName(fallback.withColumn("_p", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_p"))).where("_n = 1").drop("_p", "_n")


def missing_pairs(left: DataFrame, right: DataFrame, observed: DataFrame) -> DataFrame:
    """Combinations of two small dimension frames that ``observed`` lacks."""
    return left.crossJoin(F.broadcast(right)).join(observed, [*left.columns, *right.columns], "left_anti")


def map_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of two (path, hash) frames: added, deleted or modified."""
    both = old.withColumnRenamed("hash", "_o").join(new.withColumnRenamed("hash", "_n"), "path", "full_outer")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted").when(F.col("_o") != F.col("_n"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")
