"""Retrieval, reranking and ranking metrics on the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import metrics, retrieval
from .registry import query, table

TERMS = ["the", "tion", "hag"]
#: DuckDB's tokens of a text, as the column expression has them.
SQL_TOKENS = r"regexp_extract_all(replace(lower({0}),'ß','ss'), '[\p{{L}}\p{{N}}_]+')"


def _sql_bm25(where: str = "true", terms=TERMS) -> str:
    words = ", ".join(f"'{t}'" for t in terms)
    return f"""
    c as (select doc_id, {SQL_TOKENS.format('text')} as t from documents where {where}),
    s as (select count(*) n, avg(len(t)) avgdl from c),
    x as (select doc_id, len(t) dl, q, len(list_filter(t, lambda w: w = q)) tf from c, (select unnest([{words}]) q) where list_contains(t, q)),
    df as (select q, count(*) df from x group by q),
    bm as (select doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) score from x join df using (q), s group by doc_id)"""


@query(f"""select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct from (select doc_id, {SQL_TOKENS.format('text')} as t from documents)""")
def ret_tokenize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def _rounded(d, *keep):
    return d.select(*keep, F.round("score", 6).alias("score"))


@query(f"with {_sql_bm25()} select doc_id, round(score, 6) as score from bm")
def ret_bm25(spark, sf_dir):
    return _rounded(retrieval.bm25(table(spark, sf_dir, "documents"), TERMS), "doc_id")


@query(f"with {_sql_bm25()}, r as (select doc_id, round(score, 6) as score, row_number() over (order by round(score, 6) desc, doc_id) as rank from bm) select doc_id, score, rank from r where rank <= 20")
def ret_topk(spark, sf_dir):
    d = retrieval.top(_rounded(retrieval.bm25(table(spark, sf_dir, "documents"), TERMS), "doc_id"), 20)
    return d.select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {_sql_bm25('lang = ' + chr(39) + 'en' + chr(39) + ' and doc_id in (select doc_id from labels where quality = 1)')} select doc_id, round(score, 6) as score from bm")
def ret_bm25_filtered(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    corpus = table(spark, sf_dir, "documents").where("lang = 'en'").join(good, "doc_id", "left_semi")
    return _rounded(retrieval.bm25(corpus, TERMS), "doc_id")


_SQL_COS = "v as (select vec_id, embedding::double[] e from embeddings), q as (select e as qe from v where vec_id = 0), cs as (select vec_id, round(list_cosine_similarity(e, qe), 6) as score from v, q)"


@query(f"with {_SQL_COS}, r as (select *, row_number() over (order by score desc, vec_id) as rank from cs) select vec_id, score, rank from r where rank <= 10")
def ret_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("e")))  # one row
    d = v.join(q).select("vec_id", F.round(retrieval.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))
    return retrieval.top(d, 10, "vec_id").withColumn("rank", F.col("rank").cast("long"))


@query(f"with {_SQL_COS}, r as (select *, row_number() over (order by score desc, vec_id) as rank from cs where vec_id <> 0) select vec_id, rank from r where rank <= 5")
def ret_neighbors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    found = retrieval.vector_search(v, v.where("vec_id = 0"), 5, exclude_self=True)
    return found.select("vec_id", F.col("rank").cast("long").alias("rank"))


_SQL_HYBRID = f"""with {_sql_bm25()}, {_SQL_COS},
    l as (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as rank from bm qualify rank <= 100),
    n as (select vec_id as doc_id, row_number() over (order by score desc, vec_id) as rank from cs where vec_id in (select doc_id from documents) qualify rank <= 100),
    h as (select doc_id, sum(1.0::double / (60 + rank)) as score from (select * from l union all select * from n) group by doc_id)
    select doc_id, round(score, 6) as score, row_number() over (order by round(score, 6) desc, doc_id) as rank from h qualify rank <= 20"""


@query(_SQL_HYBRID)
def ret_rrf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    v = table(spark, sf_dir, "embeddings")
    lexical = retrieval.top(_rounded(retrieval.bm25(docs, TERMS), "doc_id"), 100)
    mine = v.join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    q = F.broadcast(v.where("vec_id = 0").select(F.col("embedding").alias("e")))  # one row
    near = mine.join(q).select(F.col("vec_id").alias("doc_id"), F.round(retrieval.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))
    d = retrieval.top(_rounded(retrieval.rrf([lexical, retrieval.top(near, 100)], "doc_id"), "doc_id"), 20)
    return d.withColumn("rank", F.col("rank").cast("long"))


@query(rf"""with {_sql_bm25()}, l as (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as rank from bm qualify rank <= 100),
    t as (select l.doc_id, rank, {SQL_TOKENS.format('text')} as t from l join documents using (doc_id)),
    rr as (select doc_id, rank, len(list_intersect(['of', 'the', 'tion'], t)) / 3.0::double + case when contains(' ' || array_to_string(t, ' ') || ' ', ' of the tion ') then 1.0 else 0.0 end as score from t)
    select doc_id, round(score, 6) as score, row_number() over (order by score desc, rank) as new_rank from rr""")
def ret_rerank_phrase(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    best = retrieval.top(_rounded(retrieval.bm25(docs, TERMS), "doc_id"), 100).drop("score")
    d = retrieval.rerank_phrase(docs.select("doc_id", "text").join(F.broadcast(best), "doc_id"), "of the tion")  # best has 100 rows
    return d.select("doc_id", F.round("score", 6).alias("score"), F.col("new_rank").cast("long").alias("new_rank"))


@query("""select vec_id, round(c, 6) as similarity from (select vec_id, list_cosine_similarity(embedding::double[], lag(embedding::double[]) over (order by vec_id)) as c from embeddings) where c < 0.55""")
def ret_boundaries(spark, sf_dir):
    d = retrieval.boundaries(table(spark, sf_dir, "embeddings"))
    return d.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""with v as (select p_partkey, p_name, lower(p_name) a, lower(p_brand) b, lower(p_type) c from part),
    h as (select p_partkey, p_name, a, (contains(a,'red')::int + contains(b,'red')::int + contains(c,'red')::int) r, (contains(a,'ring')::int + contains(b,'ring')::int + contains(c,'ring')::int) s from v)
    select p_partkey, p_name, (r + s + 3 * contains(a,'red')::int + 3 * contains(a,'ring')::int + case when contains(a,'red ring') then 5 else 0 end)::bigint as score from h where r > 0 and s > 0""")
def ret_record_search(spark, sf_dir):
    return retrieval.record_search(table(spark, sf_dir, "part"), "red ring", "p_name", ["p_brand", "p_type"], "p_partkey")


@query("select lang as collection, count(*) as n_records, count(distinct source) as n_sources from documents group by lang")
def ret_list_collections(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("collection")).agg(F.count("*").alias("n_records"), F.countDistinct("source").alias("n_sources"))


@query("select doc_id, lang, source, n_chars from documents where doc_id = 7")
def ret_get_record(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 7").select("doc_id", "lang", "source", "n_chars")


_QRELS = "qr as (select 'q' || (doc_id % 5) as query_id, doc_id, greatest(quality - toxic, 0) as grade from labels)"
_RUN = "rt as (select 'q' || (doc_id % 5) as query_id, doc_id, row_number() over (partition by doc_id % 5 order by n_chars desc, doc_id) as rank from documents)"


@query(f"""with {_QRELS}, {_RUN}, g as (select * from qr where grade > 0), f as (select * from rt where rank <= 10),
    i as (select query_id, count(*) total, sum(case when r <= 10 then (pow(2, grade) - 1) / log2(r + 1) else 0 end) best from (select *, row_number() over (partition by query_id order by grade desc, doc_id) r from g) group by query_id),
    h as (select query_id, count(*) found, min(rank) top, sum((pow(2, grade) - 1) / log2(rank + 1)) dcg from f join g using (query_id, doc_id) group by query_id)
    select query_id, round(coalesce(found, 0) / total, 6) as recall, round(coalesce(1.0::double / top, 0), 6) as mrr, round(coalesce(dcg / best, 0), 6) as ndcg from i left join h using (query_id)""")
def irm_ranking(spark, sf_dir):
    qrels = table(spark, sf_dir, "labels").select(F.concat(F.lit("q"), F.col("doc_id") % 5).alias("query_id"), "doc_id", F.greatest(F.col("quality") - F.col("toxic"), F.lit(0)).alias("grade"))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("q"), F.col("doc_id") % 5).alias("query_id"), "doc_id", "n_chars")
    run = docs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")))
    d = metrics.ranking_metrics(run, qrels, 10)
    return d.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])
