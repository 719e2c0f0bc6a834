"""Connected components by alternating large-star and small-star steps.

Every step is a partial aggregate (minimum neighbour) and an equi-join on long
ids; its edges are written to the shared folder.  The number of rounds grows
with the logarithm of a component's diameter, and a node with very many
neighbours is an ordinary skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0])


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs -> (node, comp): each node with its component's
    smallest node."""
    e = scratch(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = scratch(small, "edges")
        before, mark = mark, _mark(e)
        if mark == before:
            break
    # stars now: every node points at its component's smallest
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
