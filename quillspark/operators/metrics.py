"""Ranking metrics, rates and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def ranking_metrics(retrieved: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, mrr, ndcg) at k of retrieved (query_id, doc_id, rank) by the grades of
    relevant (query_id, doc_id, grade). A document counts once, at its best rank. Queries without
    a positive grade get nulls."""
    first = retrieved.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "doc_id"))).where(F.col("rank") <= k)
    good = relevant.where("grade > 0")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    ideal = good.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.count("*").alias("total"), F.sum(F.when(F.col("r") <= k, gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("best"))
    hits = first.join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("top"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    asked = retrieved.select("query_id").union(relevant.select("query_id")).distinct()
    d = asked.join(ideal, "query_id", "left").join(hits, "query_id", "left")
    known = F.col("total").isNotNull()
    return d.select(
        "query_id",
        F.when(known, F.coalesce("found", F.lit(0)) / F.col("total")).alias("recall"),
        F.when(known, F.coalesce(1.0 / F.col("top"), F.lit(0.0))).alias("mrr"),
        F.when(known, F.coalesce(F.col("dcg") / F.col("best"), F.lit(0.0))).alias("ndcg"),
    )


def rate(rows: DataFrame, *by: str, correct: str = "correct") -> DataFrame:
    """Count, correct ones and their share, null without rows."""
    grouped = rows.groupBy(*by)
    return grouped.agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("n_correct"), F.try_divide(F.count_if(F.col(correct)).cast("double"), F.count("*")).alias("accuracy"))


def group_rates(rows: DataFrame, groups: str, correct: str = "correct") -> DataFrame:
    """Rates by the groups of an array column; a row counts in each of its groups."""
    return rate(rows.withColumn("grp", F.explode(groups)), "grp", correct=correct)


def percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """p50 and p95 with linear interpolation."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"))


def word_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, recall): the share of the truth's words, repeats counted, that the found words hold.
    Both are (doc_id, word)."""
    t = truth.groupBy("doc_id", "word").agg(F.count("*").alias("t"))
    f = found.groupBy("doc_id", "word").agg(F.count("*").alias("f"))
    d = t.join(f, ["doc_id", "word"], "left")
    return d.groupBy("doc_id").agg((F.sum(F.least("t", F.coalesce("f", F.lit(0)))) / F.sum("t")).alias("recall"))
