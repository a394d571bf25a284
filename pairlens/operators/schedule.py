"""Deterministic schedules: ids, selection, rotation, budgets and launch skew."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.functions.stats import short_id
from pairlens.operators.scans import running


#: Fixed value: a part of every id and seed.
SCHEDULE_VERSION = "micro-single-task-paired-round-robin-sha256-v1"


def round_index(item_index: Column, families: int, family_ord: Column) -> Column:
    return item_index * families + family_ord


def launch_index(provider_ord: Column, round_: Column, providers: int) -> Column:
    """Place of a provider in a round's launch order, which rotates by one a round."""
    return F.pmod(provider_ord - round_, F.lit(providers))


def with_ids(units: DataFrame, version: str = SCHEDULE_VERSION) -> DataFrame:
    """Adds round_id and request_id to units with round_index, family, item_id, provider and, unless there are no attempts, attempt."""
    text = lambda c: F.col(c).cast("string")
    attempt = F.coalesce(text("attempt"), F.lit("0")) if "attempt" in units.columns else F.lit("0")
    place = [text("round_index"), text("family"), text("item_id"), attempt]
    return units.withColumn("round_id", short_id("round-", F.lit(version), *place)).withColumn("request_id", short_id("req-", F.lit(version), text("provider"), *place))


def build_schedule(selection: DataFrame, families: list[str], providers: list[str], per_family: int, attempt: int | None = None) -> DataFrame:
    """The units of ``per_family`` rounds of each family, in turn by family, with providers rotated by one a round.

    ``selection`` has family, item_id and order_index. Raises when it runs if a
    family has fewer items.
    """
    order = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f), F.lit(i))])
    chosen = selection.where(F.col("order_index") < per_family).withColumn("round_index", round_index(F.col("order_index"), len(families), order[F.col("family")]).cast("long"))
    short = chosen.agg(F.when(F.count(F.lit(1)) != per_family * len(families), F.raise_error(F.lit("a family has too few items")).cast("boolean")).alias("bad"))
    names = F.explode(F.transform(F.array(*[F.lit(p) for p in providers]), lambda p, i: F.struct(p.alias("provider"), i.alias("ordinal"))))
    units = chosen.crossJoin(F.broadcast(short)).where(F.coalesce("bad", F.lit(True))).select("round_index", "family", "item_id", names.alias("p"))
    placed = units.select("round_index", "family", "item_id", F.col("p.provider").alias("provider"), launch_index(F.col("p.ordinal"), F.col("round_index"), len(providers)).cast("int").alias("launch_index"), F.lit(attempt).cast("int").alias("attempt"))
    return with_ids(placed)


def selection_seed(slug: str, release_hash: str, family: str, version: str = SCHEDULE_VERSION) -> int:
    return int.from_bytes(hashlib.sha256("\0".join((slug, release_hash, family, version)).encode()).digest(), "big")


def shuffled_order(items: DataFrame, slug: str, release_hash: str) -> DataFrame:
    """(family, item_id, order_index): each family's sorted ids in the order of a Mersenne-Twister shuffle under its 256-bit seed."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        family = str(pdf["family"].iloc[0])
        ids = sorted(pdf["item_id"])
        random.Random(selection_seed(slug, release_hash, family)).shuffle(ids)
        return pd.DataFrame({"family": family, "item_id": ids, "order_index": range(len(ids))})

    schema = f"family string, item_id {items.schema['item_id'].dataType.simpleString()}, order_index int"
    return items.select(F.col("family").cast("string").alias("family"), "item_id").groupBy("family").applyInPandas(one, schema)


def launch_skew(records: DataFrame) -> DataFrame:
    """Milliseconds between a round's first and last start."""
    return records.groupBy("round_id").agg(((F.max("start_ns") - F.min("start_ns")) / 1e6).alias("skew_ms"))


def running_budget(ledger: DataFrame, order: str, amount: str, by: str, ceiling: float) -> DataFrame:
    """Adds accepted and running: in order, an amount is reserved if the total stays within the ceiling; rejected ones do not add.

    A group's rows pass in order through one task, which keeps the total only. Equal orders go by amount; null amounts are neither accepted nor rejected.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, 0.0
        for batch in batches:
            totals, accepted = [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    key, total = k, 0.0
                fits = None if x is None else total + x <= ceiling
                total = total + x if fits else total
                totals.append(total)
                accepted.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(totals, pa.float64()), pa.array(accepted, pa.bool_())], [*batch.schema.names, "running", "accepted"])

    rows = ledger.select(by, F.col(order).cast("long").alias(order), F.col(amount).cast("double").alias(amount))
    return rows.repartition(by).sortWithinPartitions(by, order, amount).mapInArrow(fold, rows.selectExpr("*", "0D AS running", "true AS accepted").schema)


def running_total(ledger: DataFrame, order: str, amount: str, by: str) -> DataFrame:
    """Adds running: the sum of a group's amounts so far, by order, in blocks, so that a group may be of any size."""
    return running(ledger, [by], [order], {"running": ("sum", F.col(amount))})
