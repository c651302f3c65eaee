"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import WORD, settle, text_or_empty


def source_targets(sized: DataFrame, weights=(5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source_key, source, source_size, target) of each source.

    Sources in code point order, null last, take the weights in turn and share the sum of all
    sizes. A target stops at max_epochs times its source's size; what is above goes to the
    others by weight. With sources by their filling level cap/weight, a source is full exactly
    when the level reached without it is no lower than its own, so two running sums give the
    fixed point of the resharing. The windows run over one row for each source.
    """
    per = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place + 1))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("level", F.col("cap") / F.col("w"))
    by_level = W.orderBy("level", F.col("source").asc_nulls_last())
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("cap_below", F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_from", F.sum("w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("full", (F.col("total") - F.col("cap_below")) >= F.col("level") * F.col("w_from"))
    )
    rest = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything)
    share = F.when(F.col("full"), F.col("cap")).otherwise((F.col("total") - rest) * F.col("w") / F.nullif(open_w, F.lit(0.0)))
    return per.select("source_key", "source", "source_size", F.coalesce(share, F.lit(0.0)).alias("target"), F.col("total").cast("long").alias("budget"))


#: Columns that a row is told and measured by.
_SIZED = ("__uid", "__id", "__source", "source_key", "size")


def _sized(docs: DataFrame, *more) -> DataFrame:
    """One row for each document with a number of its own, written once: what hangs on that number
    then hangs on no plan."""
    return settle(
        docs.select(
            F.monotonically_increasing_id().alias("__uid"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"),
            F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), *more,
        ),
        "mix-sizes",
    )


def schedule(docs: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 17, lanes: int = 1024) -> DataFrame:
    """Every copy of a document that the mix begins: (uid, doc_id, size, source_size, target,
    epoch, finish, taken, position), besides one row of epoch 0 for each other document.

    A source's documents are shuffled by a hash of doc_id. A copy's virtual finish time is the
    words of its source up to its end, earlier epochs included, over the source's target. Copies
    are range-sorted by it over the whole corpus, and words are served until the budget, the sum
    of all sizes, is used up, which is at virtual time 1: a copy being served then keeps the
    words that were served. Running sums go by (source, lane) and by range of virtual time, each
    with the sums of the earlier ones added, so a hot source is spread over all lanes.

    Null text: size 0, taken 0. Null source: a source of its own, the last. Rows that repeat are
    documents of their own. An empty table gives an empty result. Other columns are not read.
    """
    return _schedule(_sized(docs), weights, max_epochs, seed, lanes).drop("source_key", "lane", "u")


def _schedule(sized: DataFrame, weights=(5, 2, 1), max_epochs: int = 3, seed: int = 17, lanes: int = 1024) -> DataFrame:
    d = sized.select(F.col("__uid").alias("uid"), F.col("__id").alias("doc_id"), F.col("__source").alias("source"), "source_key", "size")
    d = d.withColumn("u", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))).withColumn("lane", F.pmod(F.shiftright("u", 20), F.lit(lanes)).cast("int"))
    targets = source_targets(d, weights, max_epochs).drop("source")
    in_lane = d.groupBy("source_key", "lane").agg(F.sum("size").alias("lane_size"))
    before = in_lane.withColumn("lane_start", F.sum("lane_size").over(W.partitionBy("source_key").orderBy("lane")) - F.col("lane_size")).drop("lane_size")
    before = before.join(targets, "source_key")
    order = W.partitionBy("source_key", "lane").orderBy("u", "doc_id", "uid")
    d = d.withColumn("end", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    d = d.join(before, ["source_key", "lane"]).withColumn("end", F.col("end") + F.col("lane_start"))
    quota = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size"))).otherwise(1)
    d = d.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(epochs.cast("int"), F.lit(1)) - 1)))
    d = d.withColumn("served_before", F.col("epoch") * F.col("source_size") + F.col("end") - F.col("size"))
    d = d.where((F.col("epoch") == 0) | (F.col("served_before") < quota))
    d = d.withColumn("finish", F.coalesce((F.col("served_before") + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0)))
    d = d.withColumn("words", F.least("size", F.greatest(F.lit(0), quota - F.col("served_before"))))
    # what gets no words has no place in the order: it is dealt over all spans
    idle = F.pmod(F.xxhash64("uid"), F.lit(lanes)).cast("int")
    d = d.withColumn("span", F.when(F.col("words") > 0, F.least(F.floor(F.col("finish") * lanes), F.lit(lanes)).cast("int")).otherwise(idle))
    d = d.select("uid", "doc_id", "source_key", "lane", "u", "size", "source_size", "target", "budget", "epoch", "finish", "words", "span")
    spans = d.groupBy("span").agg(F.sum("words").alias("span_words"))
    spans = spans.withColumn("span_start", F.sum("span_words").over(W.orderBy("span")) - F.col("span_words")).drop("span_words")
    served = W.partitionBy("span").orderBy("finish", "doc_id", "uid", "epoch").rowsBetween(W.unboundedPreceding, 0)
    # spans has at most lanes + 1 rows
    d = d.withColumn("run", F.sum("words").over(served)).join(F.broadcast(spans), "span")
    position = F.col("run") + F.col("span_start") - F.col("words")
    taken = F.least(F.col("words"), F.greatest(F.lit(0), F.col("budget") - position))
    return d.select("uid", "doc_id", "source_key", "lane", "u", "size", "source_size", "target", "epoch", "finish", taken.alias("taken"), position.alias("position"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: (doc_id, size, source_size, target, taken)."""
    return (
        schedule(docs, **options).groupBy("uid")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")], F.sum("taken").cast("long").alias("taken"))
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def mixed_documents(docs: DataFrame, seed: int = 17, lanes: int = 1024, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it: a copy that is being served when
    the budget ends stays if at least half of its words were served. Documents without words have
    no share of any budget and stay once.

    docs may be any plan: its rows are written once with a number each, and that table is read for
    the schedule and for the result. A source's documents are served in one order, epoch by epoch,
    so how far the last epoch came, one place for each source, tells each row's copies where it is:
    rows are not shuffled. Null text and source, repeated rows and empty tables as in schedule;
    other columns are kept, whatever their names.
    """
    rows = _sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    place = F.struct("lane", "u", "doc_id", "uid")
    served = _schedule(rows.select(*_SIZED), seed=seed, lanes=lanes, **options).where((F.col("taken") > 0) & (2 * F.col("taken") >= F.col("size")))
    reached = served.groupBy("source_key", "epoch").agg(F.max(place).alias("last")).groupBy("source_key").agg(F.max(F.struct("epoch", "last")).alias("x"))
    # one row for each source, written so that the planner knows its size before it picks the join
    reached = settle(reached.select("source_key", F.col("x.epoch").alias("epoch"), F.col("x.last").alias("last")), "mix-reached")
    u = F.xxhash64(F.lit(seed), F.col("__id"), F.col("size"))
    own = F.struct(F.pmod(F.shiftright(u, 20), F.lit(lanes)).cast("int").alias("lane"), u.alias("u"), F.col("__id").alias("doc_id"), F.col("__uid").alias("uid"))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.coalesce("epoch", F.lit(0)) + F.when(own <= F.col("last"), 1).otherwise(0))
    out = rows.join(reached, "source_key", "left").withColumn("__copies", copies).where("__copies > 0")
    out = out.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return out.select(*[F.col("__row")[c].alias(c) for c in docs.columns])
