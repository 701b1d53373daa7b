"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): component is the smallest node that can be reached; nodes of edges only.

    Each step joins edges with the smallest neighbour of a node, an aggregate with partial sums; the
    rounds needed grow with the logarithm of a component's size. Every round's edges are written to
    shared storage, and only a count and a checksum come to the driver.
    """
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    at = materialize(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    state = None
    while True:
        now = at.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialize(large, "large-star")
        discard(at)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(large)
    return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
