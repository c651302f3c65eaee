"""Components, reachability and tree checks over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Alternating large and small
    stars; each round is checkpointed, so a lost executor costs one round."""
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        seen = state
    raise RuntimeError("the components did not settle")


def vetoed(members: DataFrame, source: str, component: str = "component") -> DataFrame:
    """(component, n, ok): not ok where two members come from one source."""
    d = members.groupBy(component).agg(F.count("*").alias("n"), F.countDistinct(source).alias("__s"))
    return d.select(component, "n", (F.col("n") == F.col("__s")).alias("ok"))


def trace(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth) of what edges (parent, child) reach from seeds (node), the nearest depth of each; without a
    depth everything that can be reached. Each level is checkpointed and meets only new nodes, so cycles end."""
    found = seeds.select("node", F.lit(0).alias("depth")).distinct()
    level, k = found, 0
    while depth is None or k < depth:
        k += 1
        level = level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node"), F.lit(k).alias("depth")).distinct().join(found.select("node"), "node", "left_anti")
        if depth is None:
            level = level.checkpoint()
            if level.isEmpty():
                break
        found = found.union(level)
    return found


def tree_problems(nodes: DataFrame) -> DataFrame:
    """(problem, n) over nodes (id, parent): roots beside the first, several parents, parents that
    are not there."""
    roots = nodes.where("parent is null").agg(F.greatest(F.abs(F.count("*") - 1), F.lit(0)).alias("n")).select(F.lit("roots").alias("problem"), "n")
    several = nodes.groupBy("id").agg(F.countDistinct("parent").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n")).select(F.lit("several_parents").alias("problem"), "n")
    ids = nodes.select(F.col("id").alias("parent")).distinct()
    dangling = nodes.where("parent is not null").join(ids, "parent", "left_anti").agg(F.count("*").alias("n")).select(F.lit("dangling").alias("problem"), "n")
    return roots.union(several).union(dangling)
