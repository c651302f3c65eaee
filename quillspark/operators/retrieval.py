"""Lexical, vector and hybrid retrieval, reranking and record search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import fold, tokens

K1, B, RRF_K = 1.2, 0.75, 60


def bm25(corpus: DataFrame, query: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of the documents that hold a query term. Document frequencies and the average
    length are those of the corpus given, so a filter before the call changes them.

    Term frequencies come from each row's token array, so only one row a document and matched term
    is made, and corpus statistics are one row; nothing but that row is broadcast."""
    terms = sorted(set(query))
    d = corpus.select(key, tokens(F.col(text)).alias("t"))
    d = d.select(key, F.size("t").alias("dl"), *[F.size(F.filter("t", _is(term))).alias(f"tf{k}") for k, term in enumerate(terms)])
    stats = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    d = d.where(" or ".join(f"tf{k} > 0" for k in range(len(terms)))).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(terms)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        idf = F.log1p((F.col("n") - df + 0.5) / (df + 0.5))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return d.select(key, score.alias("score"))


def _is(term: str):
    return lambda x: x == term


def cosine(a, b):
    """Cosine in [-1, 1], null for a zero vector. Squares that leave the range of doubles are rare: then
    the parts are scaled by the largest, which is sought for those rows alone."""
    def doubles(v):
        return F.transform(v, lambda x: x.cast("double"))

    def of(x, y):
        dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, p: s + p * p)
        return dot, square(x), square(y)

    def scaled(v):  # the largest part is bound once
        top = F.array(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))))
        return F.flatten(F.transform(top, lambda t: F.transform(v, lambda x: x.cast("double") / F.nullif(t, F.lit(0.0)))))

    dot, n, m = of(doubles(a), doubles(b))
    fine = n.between(1e-150, 1e150) & m.between(1e-150, 1e150)
    far, fn, fm = of(scaled(a), scaled(b))
    c = F.when(fine, dot / (F.sqrt(n) * F.sqrt(m))).otherwise(far / F.nullif(F.sqrt(fn) * F.sqrt(fm), F.lit(0.0)))
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def top(scored: DataFrame, k: int | None, key: str = "doc_id") -> DataFrame:
    """The k best with their rank: score falling, then key. A bounded heap in each task first. Without k
    all, for results that something else bounds."""
    best = scored if k is None else scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def vector_search(vectors: DataFrame, query: DataFrame, k: int, key: str = "vec_id", exclude_self: bool = False) -> DataFrame:
    """The k nearest of one query vector (a frame of one row: key, embedding)."""
    q = F.broadcast(query.select(F.col(key).alias("__q"), F.col("embedding").alias("__e")).limit(1))
    d = vectors.join(q)  # one row
    if exclude_self:
        d = d.where(F.col(key) != F.col("__q"))
    return top(d.select(key, cosine(F.col("embedding"), F.col("__e")).alias("score")).where("score is not null"), k, key)


def rrf(ranked: list[DataFrame], key: str) -> DataFrame:
    """Sum of 1 / (60 + rank) over the rankings that hold a document."""
    parts = [r.select(key, (1.0 / (RRF_K + F.col("rank"))).alias("part")) for r in ranked]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.sum("part").alias("score"))


def rerank_phrase(candidates: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Share of query terms that a text holds, and 1 more if it holds the query as a phrase; ties
    keep their order by rank. candidates: (doc_id, rank, text)."""
    q = tokens(F.lit(query))
    t = tokens(F.col(text))
    ratio = F.size(F.array_intersect(F.array_distinct(q), t)) / F.greatest(F.size(F.array_distinct(q)), F.lit(1))
    phrase = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.array_join(q, " "), F.lit(" ")))
    d = candidates.withColumn("score", ratio + F.when(phrase, 1.0).otherwise(0.0))
    return d.withColumn("new_rank", F.row_number().over(W.orderBy(F.desc("score"), "rank")))


def boundaries(vectors: DataFrame, threshold: float = 0.55, key: str = "vec_id", bucket_rows: int = 50_000) -> DataFrame:
    """Neighbours in key order whose cosine is below the threshold; keys may have gaps. Rows go to buckets
    of neighbouring keys; in a bucket each row meets the one before it, and a bucket's first row
    the last one of the bucket before that holds rows."""
    low, high, n = vectors.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return vectors.select(key, F.lit(None).cast("double").alias("similarity")).limit(0)
    buckets = -(-n // bucket_rows)
    b = F.floor((F.col(key) - F.lit(low)).cast("double") * F.lit(buckets / (high - low + 1))).cast("long")
    d = vectors.select(key, "embedding", b.alias("__b")).where(F.col(key).isNotNull())
    d = d.withColumn("__e", F.lag("embedding").over(W.partitionBy("__b").orderBy(key)))
    lasts = d.groupBy("__b").agg(F.max_by("embedding", key).alias("__last"))  # one row a bucket
    before = lasts.select("__b", F.lag("__last").over(W.orderBy("__b")).alias("__last"))
    d = d.join(before, "__b").select(key, cosine(F.col("embedding"), F.coalesce("__e", "__last")).alias("similarity"))
    return d.where(F.col("similarity") < threshold)


def record_search(records: DataFrame, query: str, name: str, values: list[str], key: str) -> DataFrame:
    """Records that hold every query term in some value: a point for each term and value that holds
    it, three for each term in the name, five if the name holds the whole query."""
    terms = [t for t in query.split() if t]
    folded = F.array(*[fold(F.col(v).cast("string")) for v in [name, *values]])
    hits, named, all_ = F.lit(0), F.lit(0), F.lit(True)
    for t in terms:
        t_ = fold(F.lit(t))
        hits = hits + F.size(F.filter(folded, _holds(t_)))
        named = named + F.when(fold(F.col(name)).contains(t_), 3).otherwise(0)
        all_ = all_ & F.exists(folded, _holds(t_))
    phrase = F.when(fold(F.col(name)).contains(fold(F.lit(query))), 5).otherwise(0)
    return records.where(all_).select(key, name, (hits + named + phrase).cast("long").alias("score"))


def _holds(term):
    return lambda v: v.contains(term)


def retrieve(corpus: DataFrame, mode: str, query: str = "", vectors: DataFrame | None = None, query_vector: DataFrame | None = None, limit: int | None = 20, candidates: int = 100, budget: int = 1_000_000) -> DataFrame:
    """The five modes over (doc_id, text) and (doc_id, embedding): structured and direct (all, with
    score 1), lexical, vector, hybrid. A direct request over the budget of characters fails; within
    it all documents come back, whatever the limit."""
    if mode in ("structured", "direct"):
        d = corpus.select("doc_id", F.lit(1.0).alias("score"), F.length("text").alias("__n"))
        if mode == "direct":
            used = corpus.agg(F.sum(F.length("text"))).first()[0] or 0
            if used > budget:
                raise ValueError(f"{used} characters are more than the budget of {budget}")
        return top(d.drop("__n"), None if mode == "direct" else limit)
    words = query.split()
    lexical = lambda k: top(bm25(corpus, [w.lower() for w in words]), k)
    near = lambda k: top(vector_search(vectors.withColumnRenamed("doc_id", "vec_id"), query_vector, k).select(F.col("vec_id").alias("doc_id"), "score"), k)
    if mode == "lexical":
        return lexical(limit)
    if vectors is None or query_vector is None:
        raise ValueError(f"mode {mode} needs vectors and a query vector")
    if mode == "vector":
        return near(limit)
    if mode == "hybrid":
        return top(rrf([lexical(candidates), near(candidates)], "doc_id"), limit)
    raise ValueError(f"no mode {mode}")

