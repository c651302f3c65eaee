"""Greedy packing of texts and of table rows into chunks, as folds over one document's pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pieces(text: Column, most: int) -> Column:
    """A text's parts of at most so many characters, cut behind the last blank that fits, else hard."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{most}}}\z|.{{0,{most - 1}}}\s|.{{1,{most}}}"), F.lit(0))


def pack_texts(nodes: DataFrame, key: str, most: int = 1600) -> DataFrame:
    """(key, chunk, n_nodes, text) of text nodes (key, pos, role, text) in order: pieces of one role are joined by an empty
    line while they fit; a node that was cut ends its chunk at each cut. Empty nodes are left out. A document
    is one row while it is packed."""
    parts = F.transform(pieces(F.col("text"), most), lambda p, k: F.struct("pos", k.alias("k"), "role", p.alias("t")))
    d = nodes.where(F.length("text") > 0).select(key, parts.alias("p"))
    d = d.select(key, F.transform("p", lambda x: F.struct(x.pos.alias("pos"), x.k.alias("k"), x.role.alias("role"), x.t.alias("t"), (x.k < F.size("p") - 1).alias("cut"))).alias("p"))
    d = d.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("p"))
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).alias("n"), F.lit("").alias("role"), F.lit(True).alias("shut"), F.array().cast("array<int>").alias("out"))

    def step(a, x):
        fresh = a.shut | ~a.role.eqNullSafe(x.role) | (a.n + 2 + F.length(x.t) > most)
        chunk = F.when(fresh, a.chunk + 1).otherwise(a.chunk)
        n = F.when(fresh, F.length(x.t)).otherwise(a.n + 2 + F.length(x.t))
        return F.struct(chunk.alias("chunk"), n.alias("n"), x.role.alias("role"), x.cut.alias("shut"), F.concat(a.out, F.array(chunk)).alias("out"))

    d = d.withColumn("at", F.aggregate("p", start, step, lambda a: a.out))
    d = d.select(key, F.explode(F.arrays_zip("p", "at")).alias("x")).select(key, F.col("x.at").alias("chunk"), "x.p.pos", "x.p.k", F.col("x.p.t").alias("t"))
    told = d.groupBy(key, "chunk").agg(F.count_distinct("pos").alias("n_nodes"), F.array_sort(F.collect_list(F.struct("pos", "k", "t"))).alias("x"))
    return told.select(key, "chunk", "n_nodes", F.array_join("x.t", "\n\n").alias("text"))


def pack_rows(rows: DataFrame, key: str, headers: int = 1, most_rows: int = 20, most: int = 1600) -> DataFrame:
    """(key, chunk, first, rows, chars) of table rows (key, pos, size): windows of at most so many rows and, with the header rows
    repeated in each, so many characters; a row that is longer alone stays whole. A table of headers
    alone is one window without rows."""
    d = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("size").cast("long").alias("size")))).alias("r"))
    d = d.withColumn("head", F.aggregate(F.slice("r", 1, headers), F.lit(0).cast("long"), lambda a, x: a + x.size))
    d = d.withColumn("body", F.slice("r", F.lit(headers + 1), F.greatest(F.size("r") - headers, F.lit(0))))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("c"), F.array().cast("array<int>").alias("out"))

    def step(head):
        def run(a, x):
            fresh = (a.n > 0) & ((a.n >= most_rows) | (head + a.c + x.size > most))
            chunk = F.when(fresh, a.chunk + 1).otherwise(a.chunk)
            return F.struct(chunk.alias("chunk"), F.when(fresh, 1).otherwise(a.n + 1).alias("n"), F.when(fresh, x.size).otherwise(a.c + x.size).alias("c"), F.concat(a.out, F.array(chunk)).alias("out"))

        return run

    d = d.withColumn("at", F.aggregate("body", start, step(F.col("head")), lambda a: a.out))
    told = d.select(key, "head", F.explode_outer(F.arrays_zip("body", "at")).alias("x"))
    g = told.groupBy(key, F.coalesce("x.at", F.lit(0)).alias("chunk")).agg(F.min("x.body.pos").alias("first"), F.count("x.body.pos").alias("rows"), (F.max("head") + F.coalesce(F.sum("x.body.size"), F.lit(0))).alias("chars"))
    return g.select(key, "chunk", "first", "rows", "chars")
