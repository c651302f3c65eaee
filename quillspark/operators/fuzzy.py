"""String similarity that has no column expression: matching-block ratios, and what rests on them."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all characters, by matching blocks; null for nulls."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def reaches(x: str, y: str, threshold: float) -> bool:
    """Whether the ratio of x and y by matching blocks is threshold at least.

    The longest block is no shorter than what both begin or end with, and no range matches more than
    the shorter of its two sides: blocks are sought only until that tells."""
    total = len(x) + len(y)
    least = min(len(x), len(y))
    told = lambda m: total == 0 or 2.0 * m / total >= threshold
    need = next((m for m in range(max(0, int(threshold * total / 2) - 1), least + 1) if told(m)), None)
    if need is None:
        return False
    if x[:need] == y[:need] or x[len(x) - need :] == y[len(y) - need :]:
        return True
    blocks = SequenceMatcher(None, x, y, autojunk=False)
    if blocks.quick_ratio() < threshold:
        return False
    left, matched, hoped = [(0, len(x), 0, len(y))], 0, least
    while matched < need <= matched + hoped:
        alo, ahi, blo, bhi = left.pop()
        hoped -= min(ahi - alo, bhi - blo)
        i, j, k = blocks.find_longest_match(alo, ahi, blo, bhi)
        matched += k
        for part in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if k else ():
            if part[0] < part[1] and part[2] < part[3]:
                left.append(part)
                hoped += min(part[1] - part[0], part[3] - part[2])
    return matched >= need


def alike(x: Column, y: Column, threshold: float) -> Column:
    """Whether two texts reach the threshold, false for nulls. Where one begins with the other the
    shorter is all that matches, and too different lengths never reach it: neither goes to Python."""

    @F.pandas_udf(T.BooleanType())
    def sought(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or w is None else reaches(v, w, threshold) for v, w in zip(a, b, strict=True)], dtype="object")

    m, n = F.length(x), F.length(y)
    most = F.when(m + n == 0, 1.0).otherwise(2.0 * F.least(m, n) / (m + n)) >= threshold
    open_ = most & ~F.startswith(x, y) & ~F.startswith(y, x)
    return F.coalesce(F.when(open_, sought(F.when(open_, x), F.when(open_, y))).otherwise(most), F.lit(False))


def similar_names(records: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(a, b, ratio) of records (id, kind, name) of one kind whose names are alike by the threshold.

    Names that reach it differ in length by bounded shares and share a part of the name: a ratio t
    leaves at most (1 - t)(m + n) characters unmatched, so of that many plus one equal slices of
    the shorter name one is in the longer name unbroken. Pairs meet on such parts, not on the kind."""
    n = F.length("name")
    spare = F.floor((1 - threshold) * 2 * n / threshold).cast("int") + 1
    width = F.greatest(F.lit(1), F.floor(n / (spare + 1)).cast("int"))
    own = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(n / width).cast("int") - 1)), lambda k: F.substr("name", k * width + 1, width))
    d = records.select("id", "kind", "name").where(n > 0)
    seeds = d.select("id", "kind", "name", F.explode(F.array_distinct(own)).alias("part"))
    seeds = seeds.withColumn("w", F.length("part"))
    widths = [r[0] for r in seeds.select("w").distinct().orderBy("w").collect()]  # no more than name lengths
    if not widths:
        return d.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("ratio")).limit(0)
    sliding = d.select("id", "kind", "name", F.explode(F.array(*[F.lit(w) for w in widths])).alias("w"))
    sliding = sliding.where(F.col("w") <= n).select("id", "kind", "name", "w", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), n - F.col("w") + 1), lambda k: F.substr("name", k, F.col("w"))))).alias("part"))
    met = seeds.select(F.col("id").alias("x"), F.col("name").alias("nx"), "kind", "w", "part").join(sliding.select(F.col("id").alias("y"), F.col("name").alias("ny"), "kind", "w", "part"), ["kind", "w", "part"])
    met = met.where("x <> y and length(nx) <= length(ny)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(F.col("x") < F.col("y"), F.col("ny")).otherwise(F.col("nx")).alias("nb")).distinct()
    ratio = sequence_ratio("na", "nb")
    return met.where(2 * F.least(F.length("na"), F.length("nb")) >= threshold * (F.length("na") + F.length("nb"))).select("a", "b", ratio.alias("ratio")).where(F.col("ratio") >= threshold)


def unit_diff(old: DataFrame, new: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(doc, change, old_address, new_address) of units (doc, address, body) between two versions.

    Equal bodies at one address are unchanged and give nothing; then equal bodies elsewhere have
    moved, each used once; then what is left at one address is edited if alike by the threshold;
    the rest is removed or added. Both versions are dealt by doc, once; every step works on the units
    of one address or of one body, nothing compares all with all.

    This is for units that have nothing but an address, such as numbered lines. Units with kinds,
    headings and tables are matched by versions.version_diff, in all passes."""
    of = lambda d, is_new: d.select("doc", F.col("address").alias("at"), "body", F.lit(is_new).alias("new"))
    u = of(old, False).union(of(new, True)).repartition("doc")
    whole = F.col("doc").isNotNull() & F.col("at").isNotNull()  # others meet nothing
    both = lambda w: F.bool_or("new").over(w) & ~F.bool_and("new").over(w)
    u = u.withColumn("same", both(W.partitionBy("doc", "at", "body"))).withColumn("same", F.bool_or("same").over(W.partitionBy("doc", "at")))
    u = u.where(~(whole & F.col("same"))).drop("same")
    u = u.withColumn("k", F.row_number().over(W.partitionBy("doc", "body", "new").orderBy("at")))
    nth = W.partitionBy("doc", "body", "k")
    u = u.withColumn("moved", whole & F.col("body").isNotNull() & both(nth)).withColumn("to", F.max(F.when(F.col("new"), F.col("at"))).over(nth))
    u = u.where("not (moved and new)")
    here = u.groupBy("doc", "at", F.when(~whole, F.col("new")).alias("lone")).agg(
        *[F.collect_list(F.when(c, F.struct(F.col(v).alias("v")))).alias(name) for name, c, v in (("moves", F.col("moved"), "to"), ("xs", ~F.col("moved") & ~F.col("new"), "body"), ("ys", F.col("new"), "body"))]
    )
    # all units of one address: those of one side alone, or each with each
    body, address = dict(old.dtypes)["body"], dict(old.dtypes)["address"]
    nobody, nowhere = F.lit(None).cast(f"struct<v:{body}>"), F.lit(None).cast(address)
    some = lambda c: F.when(F.size(c) == 0, F.array(nobody)).otherwise(F.col(c))
    item = lambda x, y, to: F.struct(x.alias("x"), y.alias("y"), to.alias("to"))
    pairs = F.filter(F.flatten(F.transform(some("xs"), lambda x: F.transform(some("ys"), lambda y: item(x, y, F.lit(None).cast(f"struct<v:{address}>"))))), lambda p: p.x.isNotNull() | p.y.isNotNull())
    d = here.select("doc", "at", F.explode(F.concat(F.transform("moves", lambda m: item(nobody, nobody, m)), pairs)).alias("p"))
    d = d.select("doc", "at", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("p.to").alias("to"))
    d = d.withColumn("alike", alike(F.col("x.v"), F.col("y.v"), threshold))
    told = lambda change, a, b: F.struct(F.lit(change).alias("change"), a.alias("old_address"), b.alias("new_address"))
    at = F.col("at")
    changes = (
        F.when(F.col("to").isNotNull(), F.array(told("moved", at, F.col("to.v")))).when(F.col("alike"), F.array(told("edited", at, at)))
        .otherwise(F.filter(F.array(F.when(F.col("x").isNotNull(), told("removed", at, nowhere)), F.when(F.col("y").isNotNull(), told("added", nowhere, at))), lambda c: c.isNotNull()))
    )
    return d.select("doc", F.explode(changes).alias("c")).select("doc", "c.change", "c.old_address", "c.new_address")
