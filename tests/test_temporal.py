"""Running values in blocks and joins by time, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairlens.operators import scans, temporal


@pytest.fixture(scope="module")
def ledger(spark):
    """A hot group, small groups, a null group; times with ties and nulls; null amounts; row n of every third group repeated."""
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None]), rnd.choice([None, 3, rnd.randrange(60)]), i, rnd.choice([None, rnd.randrange(-9, 9)])) for i in range(900)]
    return spark.createDataFrame(rows, "g string, at int, tie int, x int").cache()


@pytest.mark.parametrize("blocks", [1, 2, 40])
def test_running_is_the_window(ledger, blocks):
    x = F.col("x")
    w = Window.partitionBy("g").orderBy("at", "tie").rowsBetween(Window.unboundedPreceding, 0)
    want = ledger.select("*", F.sum(x).over(w).alias("s"), F.min(x).over(w).alias("lo"), F.max(x).over(w).alias("hi"), F.last(x, ignorenulls=True).over(w).alias("now"))
    got = scans.running(ledger, ["g"], ["at", "tie"], {"s": ("sum", x), "lo": ("min", x), "hi": ("max", x), "now": ("last", x)}, blocks)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_blocks_split_a_hot_group_and_rise_with_the_order(ledger):
    rows = scans.in_blocks(ledger, ["at", "tie"], 20).select("at", "tie", "_block").collect()
    assert max(sum(r._block == b for r in rows) for b in {r._block for r in rows}) <= len(rows) / 20 * 1.5
    in_order = [r._block for r in sorted(rows, key=lambda r: (r.at is not None, r.at or 0, r.tie))]
    assert in_order == sorted(in_order)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "string", "double"])
def test_orders_of_every_kind(spark, kind):
    made = {"timestamp": "timestamp_micros(id * 3600000000)", "timestamp_ntz": "cast(timestamp_micros(id * 7) as timestamp_ntz)", "date": "date_add(DATE'2024-01-01', cast(id as int))", "string": "lpad(cast(id as string), 4, '0')", "double": "if(id = 299, double('NaN'), id / 7)"}[kind]
    rows = spark.range(300).selectExpr(f"{made} AS o", "id", "1 AS g")
    got = scans.running(rows, ["g"], ["o"], {"n": ("sum", F.lit(1))}, 16)
    assert got.where("n <> id + 1").count() == 0 and got.count() == 300


def test_nothing_runs(spark, ledger):
    none = ledger.where("false")
    assert scans.running(none, ["g"], ["at"], {"s": ("sum", F.col("x"))}).collect() == []
    assert temporal.as_of(none, none.select("g", "at", F.col("tie").alias("r"), F.col("x").alias("v")), ["g"], "at", ["v"], "r", "tie").collect() == []
    assert temporal.overlaps(none, none, ["g"], "tie", "tie", "at", "x").collect() == []


@pytest.mark.parametrize("blocks", [1, 30])
def test_as_of(spark, ledger, blocks):
    right = ledger.where("tie % 3 = 0").select("g", "at", F.col("tie").alias("r"), F.col("x").alias("v"))
    left = ledger.where("tie % 3 > 0")
    known = [r for r in right.collect() if r["at"] is not None]

    def price(row):
        past = [r for r in known if row["at"] is not None and r["g"] == row["g"] and r["at"] <= row["at"]]
        return max(past, key=lambda r: (r["at"], r["r"]))["v"] if past else None

    got = temporal.as_of(left, right, ["g"], "at", ["v"], "r", "tie", blocks)
    assert got.columns == ["g", "at", "tie", "x", "v"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((r["g"], r["at"], r["tie"], r["x"], price(r)) for r in left.collect()), key=str)


@pytest.fixture(scope="module")
def spans(spark):
    """Lengths from none to 5,000, one that covers all, nulls, and ends before starts."""
    rnd = random.Random(9)
    rows = [(i, rnd.choice("xxxy"), s := rnd.randrange(-4000, 4000), rnd.choice([s, s - 5, s + 1, s + rnd.randrange(40), s + rnd.randrange(5000), None])) for i in range(300)]
    return spark.createDataFrame([*rows, (300, "x", -10_000, 10_000), (301, "x", None, 5), (302, None, 1, 9)], "id int, g string, s long, e long").cache()


def test_in_flight(spans):
    rows = [r for r in spans.collect() if r["s"] is not None]
    want = []
    for g, at in {(r["g"], r["s"]) for r in rows}:
        mine = [r for r in rows if r["g"] == g]
        want.append((g, at, sum(r["s"] == at for r in mine), sum(r["s"] <= at and (r["e"] is None or r["e"] > at) for r in mine)))
    got = [tuple(r) for r in temporal.in_flight(spans, ["g"], "s", "e", 20).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_overlaps(spans):
    a, b = spans.where("id % 2 = 0"), spans.where("id % 3 < 2")
    real = lambda df: [r for r in df.collect() if None not in tuple(r) and r["e"] > r["s"]]
    want = sorted((x["g"], x["id"], y["id"]) for x in real(a) for y in real(b) if x["g"] == y["g"] and x["s"] < y["e"] and y["s"] < x["e"])
    got = [tuple(r) for r in temporal.overlaps(a, b, ["g"], "id", "id", "s", "e").collect()]
    assert len(want) > 500 and sorted(got) == want


def test_overlaps_with_empty(spans):
    a, b = spans.where("id % 2 = 0"), spans.where("id % 3 < 2")
    known = lambda df: [r for r in df.collect() if None not in tuple(r)]
    want = sorted((x["g"], x["id"], y["id"]) for x in known(a) for y in known(b) if x["g"] == y["g"] and x["s"] < y["e"] and y["s"] < x["e"])
    got = [tuple(r) for r in temporal.overlaps(a, b, ["g"], "id", "id", "s", "e", empty=True).collect()]
    assert sorted(got) == want and len(want) > temporal.overlaps(a, b, ["g"], "id", "id", "s", "e").count()
