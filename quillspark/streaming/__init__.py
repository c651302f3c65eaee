"""Structured Streaming forms of the change operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and event_type; what is later than the watermark is left out."""
    d = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    return d.groupBy(F.window("__ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each event once; state of keys beyond the watermark goes."""
    return events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late).dropDuplicatesWithinWatermark([key]).drop("__ts")


def reconcile(events: DataFrame, path: str, checkpoint: str, key: str = "user_id", order: str = "event_id"):
    """A sink that keeps the newest event of each key under path, one folder a batch: the batch id
    is the generation, so a replayed batch overwrites its own folder and changes nothing. State is
    read with newest()."""

    def apply(batch: DataFrame, generation: int) -> None:
        fields = [c for c in batch.columns if c not in (key, order)]
        best = batch.groupBy(key).agg(F.max(F.struct(order, *fields)).alias("e")).select(key, "e.*")
        best.withColumn("generation", F.lit(generation)).write.mode("overwrite").parquet(f"{path}/generation={generation}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)


def newest(spark, path: str, key: str = "user_id", order: str = "event_id") -> DataFrame:
    """The newest event of each key over all generations."""
    d = spark.read.option("recursiveFileLookup", "true").parquet(path)
    fields = [c for c in d.columns if c not in (key, order)]
    return d.groupBy(key).agg(F.max(F.struct(order, *fields)).alias("e")).select(key, "e.*")
