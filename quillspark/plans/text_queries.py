"""Document structure, evidence, scoring and scalar functions on the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents, metrics, retrieval
from .registry import query, table
from .retrieval_queries import SQL_TOKENS


@query(r"""with p as (select doc_id, list_filter(regexp_split_to_array(text, '\n[ \t]*\n\s*'), lambda x: trim(x) <> '') p from documents) select doc_id, len(p) as n_paragraphs, coalesce(list_max(list_transform(p, lambda x: length(x))), 0) as longest from p""")
def src_txt_paragraphs(spark, sf_dir):
    return documents.paragraphs(table(spark, sf_dir, "documents"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents) select doc_id, pos, length(line) as n, last_value(case when length(line) <= 40 then line end ignore nulls) over (partition by doc_id order by pos) as title from l""")
def win_title_carry(spark, sf_dir):
    d = documents.lines(table(spark, sf_dir, "documents"))
    w = W.partitionBy("doc_id").orderBy("pos")
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").cast("long").alias("n"), F.last(F.when(F.length("line") <= 40, F.col("line")), ignorenulls=True).over(w).alias("title"))


@query("select doc_id, case when lang <> '' and source <> '' then source || ' > ' || lang || chr(10) || text else text end as body from documents")
def win_contextualize(spark, sf_dir):
    head = F.when((F.col("lang") != "") & (F.col("source") != ""), F.concat(F.col("source"), F.lit(" > "), F.col("lang"), F.lit("\n"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.col("text")).alias("body"))


@query("""with c as (select doc_id, '[§1 p.1] ' || text || ' [§2 p.' || (doc_id % 9) || '] ' || lang as ctx from documents), m as (select doc_id, unnest([1, 2]) block, ctx from c) select doc_id, block, case when block = 1 then '1' else cast(doc_id % 9 as varchar) end as page from m""")
def src_context_read(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[§1 p.1] "), F.col("text"), F.lit(" [§2 p."), (F.col("doc_id") % 9).cast("string"), F.lit("] "), F.col("lang")).alias("context"))
    return documents.context_blocks(d).select("doc_id", "block", "page")


@query("select item_id, doc_id, strpos(d.text, b.text) - 1 as start from (select item_id, text from benchmark union all select 1000000 + item_id, case item_id % 4 when 0 then substr(text, 1, 3) when 1 then array_to_string(string_split(text, ' ')[1:2], ' ') when 2 then array_to_string(string_split(text, ' ')[1:3], ' ') else array_to_string(string_split(text, ' ')[2:5], ' ') end from benchmark) b join documents d on contains(d.text, b.text)")
def ver_evidence(spark, sf_dir):
    """Whole passages and quotes of a few words or part of one."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    ws = F.split("text", " ")
    part = lambda start, n: F.array_join(F.slice(ws, start, n), " ")
    k = F.col("item_id") % 4
    short = F.when(k == 0, F.substring("text", 1, 3)).when(k == 1, part(1, 2)).when(k == 2, part(1, 3)).otherwise(part(2, 4))
    return documents.quotes(table(spark, sf_dir, "documents"), b.union(b.select(F.lit(1_000_000) + F.col("item_id"), short)))


@query("with q as (select doc_id, text as quote, 'tion' as v from documents) select doc_id, contains(' ' || lower(quote) || ' ', v) as mentions, (length(quote) - length(replace(quote, v, ''))) // length(v) as spans from q")
def ver_quote_mentions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("q"))
    return d.select("doc_id", F.lower("q").contains("tion").alias("mentions"), F.floor((F.length("q") - F.length(F.replace("q", F.lit("tion"), F.lit("")))) / 4).alias("spans"))


@query(r"select doc_id, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?')) as spans from documents")
def ver_value_spans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[0-9]+(?:[.,][0-9]+)?"), 0)).cast("long").alias("spans"))


@query("select doc_id, case when l.doc_id is null then 'no label' when quality = 0 then 'low quality' when toxic = 1 then 'toxic' else 'ok' end as reason from documents d left join labels l using (doc_id)")
def ver_support(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("quality").isNull(), "no label").when(F.col("quality") == 0, "low quality").when(F.col("toxic") == 1, "toxic").otherwise("ok").alias("reason"))


def _answers(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(l, "doc_id").withColumn("correct", (F.col("quality") == 1) & (F.col("toxic") == 0))


_ANS = "a as (select doc_id, lang, source, n_chars, quality = 1 and toxic = 0 as correct from documents join labels using (doc_id))"


@query(f"with {_ANS} select lang, count(*) as n, count(*) filter (correct) as n_correct, count(*) filter (correct)::double / count(*) as accuracy from a group by lang")
def agg_rate(spark, sf_dir):
    return metrics.rate(_answers(spark, sf_dir), "lang")


@query(f"with {_ANS} select grp, count(*) as n, count(*) filter (correct) as n_correct, count(*) filter (correct)::double / count(*) as accuracy from (select unnest([lang, source, 'all']) grp, correct from a) group by grp")
def agg_groups(spark, sf_dir):
    return metrics.group_rates(_answers(spark, sf_dir).withColumn("g", F.array("lang", "source", F.lit("all"))), "g")


@query("select event_type, count(value) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type")
def agg_percentile(spark, sf_dir):
    d = metrics.percentiles(table(spark, sf_dir, "events"), "value", "event_type")
    return d.select("event_type", "n", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(f"with {_ANS} select coalesce(lang, '*') as lang, coalesce(source, '*') as source, count(*) as n, round(avg(correct::int), 6) as accuracy, sum(n_chars)::bigint as chars from a group by grouping sets ((lang), (source), ())")
def agg_summarize(spark, sf_dir):
    d = _answers(spark, sf_dir).groupingSets([["lang"], ["source"], []], "lang", "source")
    return d.agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.sum("n_chars").alias("chars")).select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "accuracy", "chars")


@query("select role, count(*) as calls, count(*) filter (text is null) as missing, sum(length(text))::bigint as used from conversations group by role")
def agg_usage(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("calls"), F.count_if(F.col("text").isNull()).alias("missing"), F.sum(F.length("text")).alias("used"))


@query("select source as collection, count(*) as records, count(*) - count(distinct text) as duplicates, count(distinct lang) as languages from documents group by source")
def agg_company_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return d.groupBy(F.col("source").alias("collection")).agg(F.count("*").alias("records"), (F.count("*") - F.countDistinct("h")).alias("duplicates"), F.countDistinct("lang").alias("languages"))


@query("select lang, round(sum(case when quality = 1 then n_chars else 0 end)::double / sum(n_chars), 6) as coverage from documents left join labels using (doc_id) group by lang")
def agg_schema_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.round(F.sum(F.when(F.col("quality") == 1, F.col("n_chars")).otherwise(0)) / F.sum("n_chars"), 6).alias("coverage"))


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) line from documents), s as (select doc_id, case when contains(line, '|') then 'table' when regexp_matches(line, '^[-*•] ') then 'list' when regexp_matches(line, '^[^:]{1,30}: ') then 'label_value' when length(line) between 1 and 40 then 'heading' end kind from l) select kind, count(*) as n, count(distinct doc_id) as docs from s where kind is not null group by kind having count(*) >= 2""")
def agg_signals(spark, sf_dir):
    line = F.col("line")
    kind = F.when(line.contains("|"), "table").when(line.rlike(r"^[-*•] "), "list").when(line.rlike(r"^[^:]{1,30}: "), "label_value").when(F.length(line).between(1, 40), "heading")
    d = documents.lines(table(spark, sf_dir, "documents")).select("doc_id", kind.alias("kind")).where("kind is not null")
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).where("n >= 2")


@query(f"""with t as (select doc_id, unnest({SQL_TOKENS.format('text')}) word from documents), f as (select doc_id, unnest({SQL_TOKENS.format('left(text, length(text) // 2)')}) word from documents), tc as (select doc_id, word, count(*) t from t group by all), fc as (select doc_id, word, count(*) f from f group by all) select doc_id, round(sum(least(t, coalesce(f, 0)))::double / sum(t), 6) as recall from tc left join fc using (doc_id, word) group by doc_id""")
def fn_word_recall(spark, sf_dir):
    """The reading of the first half of a text against the whole."""
    d = table(spark, sf_dir, "documents")
    words = lambda c: d.select("doc_id", F.explode(T.tokens(c)).alias("word"))
    found = metrics.word_recall(words(F.col("text")), words(F.left("text", F.floor(F.length("text") / 2).cast("int"))))
    return found.select("doc_id", F.round("recall", 6).alias("recall"))


@query("select event_id, cast(json_extract_string(props, '$.k') as int) as k from events where cast(json_extract_string(props, '$.k') as int) >= 50 and cast(json_extract_string(props, '$.k') as int) <> 60 and event_type in ('click', 'view') and json_exists(props, '$.k')")
def prd_field_predicates(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").select("event_id", "event_type", k.alias("k")).where("k >= 50 and k <> 60 and event_type in ('click', 'view') and k is not null").select("event_id", "k")


@query("select doc_id, 1.0::double as score from documents where lang = 'en' and source in ('src1', 'src2')")
def prd_scope(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("lang = 'en' and source in ('src1', 'src2')").select("doc_id", F.lit(1.0).alias("score"))


@query("select doc_id, 1.0::double as score, row_number() over (order by doc_id) as rank from documents where lang = 'fr' qualify rank <= 50")
def prj_retrieve_structured(spark, sf_dir):
    d = retrieval.retrieve(table(spark, sf_dir, "documents").where("lang = 'fr'"), "structured", limit=50)
    return d.withColumn("rank", F.col("rank").cast("long"))


@query("select doc_id, 1.0::double as score, row_number() over (order by doc_id) as rank from documents where source = 'src3'")
def prj_retrieve_direct(spark, sf_dir):
    d = retrieval.retrieve(table(spark, sf_dir, "documents").where("source = 'src3'"), "direct", budget=10**9)
    return d.withColumn("rank", F.col("rank").cast("long"))


@query("select doc_id, 'src_' || substr(sha256(source), 1, 16) as source_id, 'doc_' || substr(sha256(cast(doc_id as varchar) || chr(0) || lang), 1, 24) as id from documents")
def fn_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("src_"), F.substring(F.sha2(F.col("source").cast("binary"), 256), 1, 16)).alias("source_id"), T.scoped_id("doc", F.col("doc_id"), F.col("lang")).alias("id"))


@query("select doc_id, sha256(source || chr(0) || lang || chr(0) || text) as etag from documents")
def snk_etag(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.etag(F.col("source"), F.col("lang"), F.col("text")).alias("etag"))


@query(r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as quote from documents")
def fn_normalize_quote(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_quote(F.col("text")).alias("quote"))


@query(f"select doc_id, trim(translate(replace(lower(text), 'ß', 'ss'), '{T.MARKED}', '{T.PLAIN}')) as folded from documents")
def fn_fold_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query(r"select c_custkey, trim(regexp_replace(lower(c_name || ' & ' || c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_') as key from customer")
def str_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.slug(F.concat_ws(" & ", "c_name", "c_mktsegment")).alias("key"))


@query(r"select p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9_]+'), lambda w: w not in ('small', 'large')))), ' ') as name from part")
def fn_normalized_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.sorted_name(F.concat_ws(" ", "p_name", "p_type"), ("small", "large")).alias("name"))


@query("select o_orderkey, cast(o_orderdate as date) as iso, cast(o_orderdate as date) as dotted from orders")
def fn_parse_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.parse_date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso"), T.parse_date(F.date_format("o_orderdate", "d.M.yyyy")).alias("dotted"))


@query("select p_partkey, p_retailprice as dotted, round(p_retailprice, 2) as comma from part")
def fn_number(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    plain = F.format_string("%.2f", "p_retailprice")
    return p.select("p_partkey", T.number(F.concat(F.lit("price "), plain, F.lit(" eur"))).alias("dotted"), T.number(F.replace(plain, F.lit("."), F.lit(","))).alias("comma"))


@query("select p_partkey, case p_partkey % 5 when 0 then 'm2' when 1 then 'eur' when 2 then 'person' when 3 then 'm' end as unit from part")
def fn_unit(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, F.concat(n, F.lit(" m²"))).when(k == 1, F.concat(n, F.lit(" €"))).when(k == 2, F.concat(n, F.lit(" persons"))).when(k == 3, F.concat(n, F.lit(" m"))).otherwise(n)
    return p.select("p_partkey", T.unit(said).alias("unit"))


@query("select p_partkey, lpad(cast(p_size % 12 as varchar), 2, '0') || ':30-' || lpad(cast(p_size % 12 + 8 as varchar), 2, '0') || ':00' as hours from part")
def fn_time_range(spark, sf_dir):
    said = F.concat(F.lit("open "), (F.col("p_size") % 12).cast("string"), F.lit(".30 - "), (F.col("p_size") % 12 + 8).cast("string"), F.lit(":00 daily"))
    return table(spark, sf_dir, "part").select("p_partkey", T.time_range(said).alias("hours"))


@query("select p_partkey, list_sort(list_distinct([lower(p_brand), lower(p_type), 'spare'])) as items from part")
def fn_list_items(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.list_items(F.concat(F.col("p_brand"), F.lit(", "), F.col("p_type"), F.lit("; spare / "), F.col("p_brand"))).alias("items"))


@query("select n_nationkey, n_nationkey + 1 as number from nation")
def fn_a1_range(spark, sf_dir):
    letter = F.char(F.col("n_nationkey") % 26 + 65)
    return table(spark, sf_dir, "nation").select("n_nationkey", T.column_number(letter).cast("long").alias("number"))


@query("select vec_id, len(embedding) = 64 as valid from embeddings")
def fn_embedding_validate(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", T.valid_vector(F.col("embedding"), 64).alias("valid"))


@query("select conv_id, turn, lead(role) over (partition by conv_id order by turn) as answered_by, coalesce(lead(role) over (partition by conv_id order by turn) = 'assistant', false) as paired from conversations where role in ('user', 'assistant') qualify role = 'user'")
def ask_list_check(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    d = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").withColumn("answered_by", F.lead("role").over(w)).where("role = 'user'")
    return d.select("conv_id", "turn", "answered_by", F.coalesce(F.col("answered_by") == "assistant", F.lit(False)).alias("paired"))


@query(r"select page_id, len(regexp_extract_all(html, '<li[ >]')) as n_items, len(regexp_extract_all(html, '<p[ >]')) as n_paragraphs, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages")
def str_units(spark, sf_dir):
    h = F.col("html")
    n = lambda tag: F.regexp_count(h, F.lit(f"<{tag}[ >]")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", n("li").alias("n_items"), n("p").alias("n_paragraphs"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"))
