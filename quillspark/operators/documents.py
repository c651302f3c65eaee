"""Documents as lines, paragraphs, blocks, chunks and sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line), row by row."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_paragraphs, longest): runs of lines that are not blank, from the text alone."""
    p = F.filter(F.split(F.col(text), r"\n[ \t]*\n\s*"), lambda x: F.trim(x) != "")
    return docs.select(key, F.size(p).alias("n_paragraphs"), F.coalesce(F.array_max(F.transform(p, lambda x: F.length(x))), F.lit(0)).alias("longest"))


def context_blocks(contexts: DataFrame, key: str = "doc_id", text: str = "context") -> DataFrame:
    """(key, block, page, body) of compact contexts with marks [§N p.X]."""
    marks = F.regexp_extract_all(F.col(text), F.lit(r"\[§([0-9]+) p\.([^\]]*)\]"), 0)
    parts = F.split(F.col(text), r"\[§[0-9]+ p\.[^\]]*\]")
    bodies = F.slice(parts, F.lit(2), F.size(parts) - 1)
    d = contexts.select(key, F.explode(F.arrays_zip(marks.alias("m"), bodies.alias("b"))).alias("x"))
    return d.select(key, F.regexp_extract("x.m", "§([0-9]+)", 1).cast("int").alias("block"), F.regexp_extract("x.m", r"p\.([^\]]*)", 1).alias("page"), F.trim("x.b").alias("body"))


def _pieces(text: str, most: int) -> Iterator[str]:
    """A text cut at white space into parts of at most so many characters."""
    while len(text) > most:
        cut = max(text.rfind(" ", 1, most + 1), text.rfind("\n", 1, most + 1))
        cut = cut if cut > 0 else most
        yield text[:cut]
        text = text[cut:]
    if text:
        yield text


def chunks(docs: DataFrame, most: int = 1600, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ordinal, start, chunk): lines packed greedily up to most characters; a longer line is cut
    at white space. The chunks one after another are the text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[text], strict=True):
                held, start, n = "", 0, 0
                for line in (t or "").splitlines(keepends=True):
                    for part in _pieces(line, most):
                        if held and len(held) + len(part) > most:
                            out.append((k, n, start, held))
                            start, n, held = start + len(held), n + 1, ""
                        held += part
                if held:
                    out.append((k, n, start, held))
            yield pd.DataFrame(out, columns=[key, "ordinal", "start", "chunk"])

    return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, ordinal int, start int, chunk string")


def quotes(docs: DataFrame, wanted: DataFrame, block: int = 500) -> DataFrame:
    """(item_id, doc_id, start) wherever a document's text holds a quote; start is the first place.

    docs: (doc_id, text), wanted: (item_id, text). The words of a quote but its first and last stand whole
    wherever the quote does: up to five of them are the key by which quotes and documents meet, and
    then the text decides. Quotes without such a word are held against all texts, block after block.
    """
    ws = F.split("text", r"[ \n]+")
    width = F.least(F.lit(5), F.size(ws) - 2)
    b = wanted.where(F.col("text") != "").select("item_id", F.col("text").alias("quote"), ws.alias("w"), width.alias("width"))
    b = b.withColumn("k", F.when(F.col("width") > 0, F.xxhash64("width", F.slice("w", F.lit(2), F.greatest("width", F.lit(1)))))).drop("w")
    d = docs.select("doc_id", "text")
    widths = sorted(r[0] for r in b.where("width > 0").select("width").distinct().collect())  # five at most

    def keys(n: int):
        at = F.sequence(F.lit(1), F.size("w") - (n - 1))
        return F.when(F.size("w") >= n, F.transform(at, lambda i: F.xxhash64(F.lit(n), F.slice("w", i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))

    out = []
    if widths:
        keyed = d.select("doc_id", F.split("text", r"[ \n]+").alias("w")).select("doc_id", F.concat(*[keys(n) for n in widths]).alias("ks"))
        # an outer explode keeps filters out of the expressions that make the array
        met = keyed.select("doc_id", F.explode_outer(F.array_distinct("ks")).alias("k")).join(b.where("width > 0"), "k").select("doc_id", "item_id", "quote").distinct()
        out.append(met.join(d, "doc_id"))
    rest = b.where("width <= 0").select("item_id", "quote")
    blocks = -(-rest.count() // block)
    for k in range(blocks):
        mine = rest.where(F.pmod(F.xxhash64("item_id", "quote"), F.lit(blocks)) == k)
        out.append(d.join(F.broadcast(mine), F.contains("text", "quote")))  # about block quotes
    if not out:
        return wanted.select("item_id").limit(0).join(d.select("doc_id").limit(0)).select("item_id", "doc_id", F.lit(0).cast("long").alias("start"))
    both = out[0].select("item_id", "doc_id", "text", "quote")
    for more in out[1:]:
        both = both.union(more.select("item_id", "doc_id", "text", "quote"))
    return both.where(F.contains("text", "quote")).select("item_id", "doc_id", (F.instr("text", F.col("quote")) - 1).cast("long").alias("start"))
