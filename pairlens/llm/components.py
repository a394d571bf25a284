"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in ``edges`` (a long, b long); component is the smallest id reachable.

    Each round points every node to its smallest neighbour, shortens the
    pointers twice, and goes on with the edges that still join two trees. A star
    of any size takes one round, a path of n nodes about log n. Nothing comes to
    the driver but whether edges are left.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        to = cut(both.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.col("a")).alias("p")))
        for _ in range(2):
            up = to.select(F.col("x").alias("p"), F.col("p").alias("q"))
            to = to.join(up, "p", "left").select("x", F.coalesce("q", "p").alias("p"))
        to = cut(to)
        if labels is None:
            labels = to.select(F.col("x").alias("id"), F.col("p").alias("component"))
        else:
            step = to.select(F.col("x").alias("component"), F.col("p").alias("q"))
            labels = cut(labels.join(step, "component", "left").select("id", F.coalesce("q", "component").alias("component")))
        left = edges.join(to.select(F.col("x").alias("a"), F.col("p").alias("pa")), "a", "left").join(to.select(F.col("x").alias("b"), F.col("p").alias("pb")), "b", "left")
        left = left.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b")
        edges = cut(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
