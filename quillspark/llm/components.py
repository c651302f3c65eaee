"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of each node that has an edge; component is the smallest node reachable.

    edges: (u, v) of one orderable type, in any direction, with repeats or loops. Each round
    moves edges to smaller nodes and leaves the components as they are; it ends when every edge
    points from a node to its component's smallest. Minima are combined before the shuffle, and
    nothing but two sums comes to the driver. Edges with a null end are left out; no edges give
    an empty result.
    """
    clean = edges.select("u", "v").where(F.col("u") != F.col("v"))
    e = settle(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    seen = None
    for _ in range(most_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        e = settle(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
