"""Field-level merging with visible conflicts, and the published views of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F


def candidates(facts: DataFrame) -> DataFrame:
    """facts (record, field, lang, value, source) merged by value: (record, field, lang, value,
    n_sources, needs_review); needs_review where a language has several values."""
    merged = facts.groupBy("record", "field", "lang", "value").agg(F.countDistinct("source").alias("n_sources"))
    return merged.withColumn("needs_review", F.count("*").over(W.partitionBy("record", "field", "lang")) > 1)


def conflicts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("record", "field", "lang").agg(F.count("*").alias("n_values")).where("n_values > 1")


def remap(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """facts with records renamed by aliases (alias, record)."""
    a = aliases.select(F.col("alias").alias("record"), F.col("record").alias("__to"))
    return facts.join(a, "record", "left").withColumn("record", F.coalesce("__to", "record")).drop("__to")


def language_rank(lang, wanted: str):
    """The wanted language, then en, then its variants, then the rest by name."""
    return F.when(lang == wanted, 0).when(lang == "en", 1).when(lang.startswith("en-"), 2).otherwise(3)


def project(merged: DataFrame, mode: str, wanted: str = "en") -> DataFrame:
    """(record, field, value, lang, conflict): one value a field, in the best language. The approved
    view leaves out what needs review; the preview shows its first value and marks it."""
    d = merged if mode == "preview" else merged.where(~F.col("needs_review"))
    order = W.partitionBy("record", "field").orderBy(language_rank(F.col("lang"), wanted), "lang", F.desc("n_sources"), "value")
    d = d.withColumn("__r", F.row_number().over(order)).where("__r = 1")
    return d.select("record", "field", "value", "lang", F.col("needs_review").alias("conflict"))


def revision_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(record, field, change) between two merged revisions: added, removed or changed values."""
    s = lambda d, n: d.groupBy("record", "field").agg(F.sort_array(F.collect_set(F.concat_ws("=", "lang", "value"))).alias(n))
    d = s(old, "o").join(s(new, "n"), ["record", "field"], "full_outer")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return d.select("record", "field", kind.alias("change")).where("change is not null")
