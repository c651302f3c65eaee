"""Sharding by sampled splitters. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import settle, text_or_empty

#: The low bits of a key order the documents of one text.
ID_BITS = 31


def _splitters(sample: list[tuple[int, int]], total: int, ranges: int, group_limit: float) -> list[int]:
    """Weighted quantiles of sampled (key, weight); a boundary inside a small group of equal texts
    moves to the group's start."""
    sample.sort()
    weight_of: dict[int, int] = {}
    for key, weight in sample:
        weight_of[key >> ID_BITS] = weight_of.get(key >> ID_BITS, 0) + weight
    all_weight, run, cuts = sum(w for _, w in sample), 0, []
    for key, weight in sample:
        run += weight
        while len(cuts) < ranges - 1 and run * ranges >= (len(cuts) + 1) * all_weight:
            small = weight_of[key >> ID_BITS] * total < group_limit * all_weight
            cuts.append((key >> ID_BITS) << ID_BITS if small else key)
    return sorted(set(cuts))


def shard(docs: DataFrame, shards: int = 40, ranges_per_shard: int = 32, samples_per_range: int = 16, group_share: float = 0.02, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of nearly equal bytes.

    Records are ordered by a key of the text's crc32 and a hash of doc_id, so equal texts are
    neighbours and a large group of them can still be cut. A sample drawn in proportion to size
    gives the splitters, shards * ranges_per_shard of them; about shards * ranges_per_shard *
    samples_per_range keys come to the driver whatever the input. Exact sums of the ranges then
    tell where each shard ends, and a range that holds such an end is subdivided at the record.
    Equal texts stay in one shard unless they fill more than group_share of it.

    Null text: no bytes, crc32 of the empty text. Rows that repeat get slots of their own. An
    empty table gives an empty result. Other columns are not read.
    """
    base = settle(
        docs.select(
            "doc_id", (F.octet_length(text_or_empty()).cast("long") + overhead).alias("size"),
            F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        ).withColumn("key", F.shiftleft("text_crc32", ID_BITS) + F.xxhash64("doc_id").bitwiseAND(F.lit((1 << ID_BITS) - 1))),
        "shard-base",
    )
    total = base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ranges = shards * ranges_per_shard
    step = max(1.0, total / (ranges * samples_per_range))
    chance = F.xxhash64(F.lit(29), "key", "doc_id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    drawn = base.where(chance < F.col("size") / step).select("key", F.greatest(F.col("size"), F.lit(int(step)))).collect()
    cuts = _splitters([tuple(r) for r in drawn], total, ranges, group_share * total / shards)
    # two lookups of about sqrt(ranges) comparisons each
    wide = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + wide] for i in range(0, len(cuts), wide)] or [[]]
    heads = F.array(*[F.lit(b[0]) for b in blocks[1:]]).cast("array<bigint>")
    nested = F.array(*[F.array(*[F.lit(x) for x in b]).cast("array<bigint>") for b in blocks])
    at_most = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("key")))
    spread = base.withColumn("block", at_most(heads)).withColumn("range", (F.col("block") * wide + at_most(F.element_at(nested, F.col("block") + 1))).cast("int"))
    sums = spread.groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    # one row for each range: at most shards * ranges_per_shard
    sums = sums.select("range", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    order = W.partitionBy("range").orderBy("key", "doc_id", "size")
    group = W.partitionBy("range", "text_crc32")
    d = spread.join(F.broadcast(sums), "range")
    d = d.withColumn("end", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("b0")).withColumn("row", F.row_number().over(order) - 1 + F.col("n0"))
    d = d.withColumn("group_size", F.sum("size").over(group)).withColumn("group_start", F.min(F.col("end") - F.col("size")).over(group))
    whole = F.col("group_size") <= group_share * total / shards
    middle = F.when(whole, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("end") - F.col("size") / 2)
    d = d.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / float(max(1, total)))).cast("int"))
    first = d.groupBy("shard").agg(F.min("row").alias("first_row"))
    return d.join(F.broadcast(first), "shard").select(  # first has one row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

