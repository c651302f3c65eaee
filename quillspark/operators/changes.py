"""Snapshots, diffs, incremental plans and change events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): upsert where new or different, delete where gone; what is equal gives nothing."""
    o, n = old.select(key, F.col(digest).alias("__o"), F.lit(True).alias("__ho")), new.select(key, F.col(digest).alias("__n"), F.lit(True).alias("__hn"))
    d = o.join(n, key, "full_outer")
    kind = F.when(F.col("__hn").isNull(), "delete").when(F.col("__ho").isNull() | ~F.col("__o").eqNullSafe(F.col("__n")), "upsert")
    return d.select(key, kind.alias("change")).where("change is not null")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str, metadata: str) -> DataFrame:
    """(key, change): added, removed, content or metadata."""
    o = old.select(key, F.col(content).alias("__oc"), F.col(metadata).alias("__om"), F.lit(1).alias("__ho"))
    n = new.select(key, F.col(content).alias("__nc"), F.col(metadata).alias("__nm"), F.lit(1).alias("__hn"))
    d = o.join(n, key, "full_outer")
    kind = (
        F.when(F.col("__ho").isNull(), "added").when(F.col("__hn").isNull(), "removed")
        .when(~F.col("__oc").eqNullSafe(F.col("__nc")), "content").when(~F.col("__om").eqNullSafe(F.col("__nm")), "metadata")
    )
    return d.select(key, kind.alias("change")).where("change is not null")


def chunk_plan(old: DataFrame, new: DataFrame, key: str, content: str, metadata: str) -> DataFrame:
    """(key, action): embed what is new or has other content, reuse what is equal, metadata_refresh
    where only the metadata differs, delete what is gone."""
    o = old.select(key, F.col(content).alias("__oc"), F.col(metadata).alias("__om"), F.lit(1).alias("__ho"))
    n = new.select(key, F.col(content).alias("__nc"), F.col(metadata).alias("__nm"), F.lit(1).alias("__hn"))
    d = o.join(n, key, "full_outer")
    action = (
        F.when(F.col("__hn").isNull(), "delete").when(F.col("__ho").isNull() | ~F.col("__oc").eqNullSafe(F.col("__nc")), "embed")
        .when(~F.col("__om").eqNullSafe(F.col("__nm")), "metadata_refresh").otherwise("reuse")
    )
    return d.select(key, action.alias("action"))


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")


def multiset_stability(before: DataFrame, after: DataFrame, anchor: str, record: str) -> DataFrame:
    """(anchor, n_before, n_after, identical): how many equal records, repeats counted, both hold."""
    b = before.groupBy(anchor, record).agg(F.count("*").alias("b"))
    a = after.groupBy(anchor, record).agg(F.count("*").alias("a"))
    d = b.join(a, [anchor, record], "full_outer").select(anchor, F.coalesce("b", F.lit(0)).alias("b"), F.coalesce("a", F.lit(0)).alias("a"))
    return d.groupBy(anchor).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"), F.sum(F.least("a", "b")).alias("identical"))


def unacknowledged(events: DataFrame, acks: DataFrame, event: str, key: str, generation: str, payload: str) -> DataFrame:
    """The newest unacknowledged event of each key."""
    open_ = events.join(acks.select(event).distinct(), event, "left_anti")
    newest = F.struct(generation, event, payload)
    return open_.groupBy(key).agg(F.max(newest).alias("__e"), F.count("*").alias("n_open")).select(key, F.col("__e")[event].alias(event), F.col("__e")[payload].alias(payload), "n_open")


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first, copies): the first row of each key and how many share it, combined before the shuffle."""
    return rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("copies"))
