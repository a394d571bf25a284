"""Percentiles by selection against percentile_disc."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from pairlens.operators import selection

QUANTILES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "low": 1 - 0.99, "all": 1.0}


def rows(n=6000):
    rnd = random.Random(4)
    out = []
    for _ in range(n):
        k = rnd.choices(["a", "b", None, "rare"], [70, 20, 9, 0.2])[0]
        x = rnd.choice([rnd.lognormvariate(0, 9), -rnd.random(), 5.0, 5.0, 0.0, -0.0, None, 1e300])
        out.append((k, rnd.randrange(2), x, rnd.choice([None, rnd.randrange(-9, 9), 7])))
    return [*out, ("none", 0, None, None), ("one", 0, 3.5, 1), ("odd", 0, float("nan"), 2), ("odd", 0, 1.0, 2)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "g string, h int, x double, n long").repartition(5).cache()


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def by_merging(data):
    at = [F.expr(f"percentile_disc({q!r}D) WITHIN GROUP (ORDER BY {m})").alias(f"{m}_{k}") for m in ("x", "n") for k, q in QUANTILES.items()]
    found = data.groupBy("g", "h").agg(F.count("x").alias("x_population"), F.count("n").alias("n_population"), *at)
    return sorted((tuple(plain(v) for v in r) for r in found.collect()), key=str)


@pytest.mark.parametrize(("accuracy", "margin", "small"), [(5000, 0.0005, 50_000), (3, 0.0, 50_000), (3, 0.01, 2)])
def test_as_percentile_disc(data, monkeypatch, accuracy, margin, small):
    """Also where sketches are so rough that brackets miss and widen, and where there are too many to broadcast."""
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    monkeypatch.setattr(selection, "MARGIN", margin)
    monkeypatch.setattr(selection, "SMALL", small)
    got = selection.exact_percentiles(data, ["g", "h"], {"x": QUANTILES, "n": QUANTILES})
    assert dict(got.dtypes)["n_p50"] == "bigint" and got.columns[:4] == ["g", "h", "x_population", "n_population"]
    assert sorted((tuple(plain(v) for v in r) for r in got.collect()), key=str) == by_merging(data)


def test_of_nothing_and_of_large_numbers(spark, data):
    assert selection.exact_percentiles(data.limit(0), ["g"], {"x": QUANTILES}).collect() == []
    with pytest.raises(Exception, match="past 2"):
        selection.exact_percentiles(spark.createDataFrame([("a", 2**53 + 1)], "g string, n long"), ["g"], {"n": QUANTILES}).collect()
