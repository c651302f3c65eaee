"""Quality rules: repetition counts and a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import native_words, settle, text_or_empty

BUCKETS = 1 << 14
#: Ranges of the ratio whose labelled documents are summed apart for the threshold.
RANGES = 4096
#: n-grams that are added to a text's count as if they said nothing.
CALM = 20.0
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def base_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and grams: the bucket
    of each word and of each pair of neighbours. All of it row by row, without a shuffle."""
    t = text_or_empty()
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(*keep, t.alias("__t"), F.transform(native_words(t), lambda w: F.xxhash64(w)).alias("__h"), lines.alias("__lines"))
    h, n = F.col("__h"), F.size("__h")
    d = d.select(
        *keep, "__h", n.cast("long").alias("n_words"),
        (F.length("__t") - _without(F.col("__t"), BLANKS)).cast("long").alias("word_chars"),
        _without(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>")).alias("__w"),
        F.concat(
            F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")),
            F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.pmod(F.xxhash64(F.get(h, i), F.get(h, i + 1)), F.lit(BUCKETS)).cast("int"))).otherwise(F.array().cast("array<int>")),
        ).alias("grams"),
    )
    some = F.size(F.array_distinct("__w")) < F.size("__w")
    d = d.withColumn("__s", F.when(some, F.sort_array(F.transform("__w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("__s")
    again = F.filter(F.transform(s, lambda y, k: F.when(F.coalesce(y.x == F.get(s, k - 1).x, F.lit(False)) | F.coalesce(y.x == F.get(s, k + 1).x, F.lit(False)), y.i)), lambda i: i.isNotNull())
    d = d.withColumn("__at", F.when(s.isNotNull(), F.sort_array(again)))
    at = F.col("__at")
    covered = F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - i, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return d.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.when(at.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"), "grams")


def _ratio(weights: list[float]) -> Column:
    """Mean log-likelihood ratio of a text's n-grams; the weights are one literal."""
    w = F.split(F.lit(",".join(f"{x:.6f}" for x in weights)), ",").cast("array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.element_at(w, b + 1))
    return total / (F.size("grams") + CALM)


def _threshold(scored: DataFrame, dear: float = 5.0) -> float:
    """The cut of scored (llr, quality) with the least of dear * (share of good ones below) + (share of
    bad ones above), the lowest of equals. Running sums go by range of llr, with the ranges' totals added."""
    # equal ratios first: a cut lies between two different ones
    per = scored.groupBy("llr").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    low, high, good, bad = per.agg(F.min("llr"), F.max("llr"), F.sum("good"), F.sum("bad")).first()
    if not good or not bad:
        return -math.inf
    x, width = F.col("llr"), (high - low) / RANGES
    per = per.withColumn("range", F.floor((x - low) / width).cast("int") if width else F.lit(0))
    totals = sorted(per.groupBy("range").agg(F.min("llr"), F.sum("good"), F.sum("bad")).collect())  # RANGES + 1 rows
    ahead, g, b = [], 0, 0
    for k, (r, _, more_good, more_bad) in enumerate(totals):
        ahead.append((r, g, b, totals[k + 1][1] if k + 1 < len(totals) else None))
        g, b = g + more_good, b + more_bad
    told = per.sparkSession.createDataFrame(ahead, "range int, good0 long, bad0 long, beyond double")
    w = W.partitionBy("range").orderBy("llr")
    d = per.join(F.broadcast(told), "range")  # RANGES + 1 rows
    lost, caught = F.col("good0") + F.sum("good").over(w), F.col("bad0") + F.sum("bad").over(w)
    d = d.select((F.lit(dear) * lost / F.lit(good) + 1 - caught / F.lit(bad)).alias("cost"), "llr", F.coalesce(F.lead("llr").over(w), "beyond").alias("next"))
    cost, at, following = d.agg(F.min(F.struct("cost", "llr", "next")).alias("x")).select("x.*").first()
    if not cost < 1.0:
        return -math.inf
    return at if following is None else (at + following) / 2


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr).

    llr compares two multinomials over hashed words and word pairs: the trusted target, labelled
    documents of quality 1, and the raw corpus, all documents, divided by the text's n-grams. One
    threshold, where the fewest labelled documents are misjudged and a lost good one counts five
    times, decides for every document. The target is of the half of the labelled documents that a hash picks, the
    threshold of the other half. All labels and all texts count. Without labels of both kinds the ratio
    rejects nothing.

    Null or empty text: all counts 0, base_failed. Rows that repeat are rated each; a doc_id with
    several labels takes the least quality. An empty table gives an empty result.
    """
    known = labels.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).withColumn("half", half)
    texts, target = docs.select("doc_id", "text"), F.col("doc_id").isNotNull() & (half == 0)
    # texts of the other half and those without an id are in no target and stay where they are; one plan at
    # any size of the labels, so that what is shuffled grows as the texts
    asked = texts.where(target).join(known.where("quality = 1 and half = 0").select("doc_id", F.lit(1).alias("g")).hint("merge"), "doc_id", "left")
    some = asked.select("text", "g").unionByName(texts.where(~target).select("text", F.lit(None).cast("int").alias("g")))
    # an outer explode: no filter on the arrays is then pushed into the expressions that make them
    grams = base_counts(some, ["g"]).select(F.explode_outer("grams").alias("b"), "g")
    counts = grams.groupBy("b").agg(F.count("*").alias("raw"), F.count("g").alias("good")).collect()  # BUCKETS rows
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for b, r, g in counts:
        if b is not None:
            raw[b], good[b] = r, g
    all_raw, all_good = sum(raw) + BUCKETS, sum(good) + BUCKETS
    # a bucket that the target hardly saw leans on the corpus
    weights = [math.log((good[b] + 2.0 * (raw[b] + 1) / all_raw * BUCKETS) / (all_good + BUCKETS)) - math.log((raw[b] + 1) / all_raw) for b in range(BUCKETS)]
    llr = _ratio(weights)
    # texts are rated once, the threshold then takes the ratios of those with labels
    d = settle(base_counts(docs.select("doc_id", "text"), ["doc_id"]).withColumn("llr", llr).drop("grams"), "quality-rated")
    cut = _threshold(d.select("doc_id", "llr").join(known.where("half = 1"), "doc_id"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("llr") >= F.lit(cut))).alias("kept"), "llr",
    )
