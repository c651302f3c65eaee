"""Matching, merging, review and publication on the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import matching, merging
from .registry import query, table

_REC = "rec as (select p_partkey id, p_brand doc, p_type kind, p_name name, p_size size, list_distinct(string_split(p_name, ' ')) w from part)"
_PAIR = f"{_REC}, k as (select id, doc, kind, name, size, w, unnest([kind || '|' || name || '|' || size]) key from rec), pr as (select distinct a.id a, b.id b, a.doc da, b.doc db, a.kind kind, a.name na, b.name nb, a.size sa, b.size sb, a.w wa, b.w wb from k a join k b on a.key = b.key and a.id < b.id and a.doc <> b.doc)"


def _records(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array(F.concat_ws("|", "p_type", "p_name", F.col("p_size").cast("string"))).alias("keys"))


def _pairs(spark, sf_dir):
    r = _records(spark, sf_dir)
    pairs = matching.blocked_pairs(r)
    one = lambda s: r.select(F.col("id").alias(s), F.col("doc").alias("d" + s), F.col("name").alias("n" + s), F.col("size").alias("s" + s), "kind")
    return pairs.join(one("a"), "a").join(one("b").drop("kind"), "b")


@query(f"with {_PAIR} select a, b from pr")
def jn_blocking(spark, sf_dir):
    return matching.blocked_pairs(_records(spark, sf_dir))


@query(f"with {_PAIR}, c as (select kind, doc, count(*) c from rec group by all), p as (select kind, ((sum(c) * sum(c) - sum(c * c)) / 2)::bigint possible from c group by kind), s as (select kind, count(*) scored from pr group by kind) select kind, possible, coalesce(scored, 0) as scored, possible - coalesce(scored, 0) as pruned from p left join s using (kind)")
def jn_block_stats(spark, sf_dir):
    r = _records(spark, sf_dir)
    return matching.block_stats(r, matching.blocked_pairs(r))


_SCORED = f"{_PAIR}, sc as (select a, b, da, db, na, nb, sa, sb, round(greatest(0, least(1, (case when na = nb then 0.85 else 0.45 * len(list_intersect(wa, wb)) / greatest(len(wa), len(wb)) end) + (case when sa = sb then 0.25 else -0.7 end) - 0.001 * (abs(a - b) % 97))), 4) score from pr)"


def _scored(spark, sf_dir):
    d = _pairs(spark, sf_dir)
    wa, wb = F.array_distinct(tokens(F.col("na"))), F.array_distinct(tokens(F.col("nb")))
    far = 0.001 * (F.abs(F.col("a") - F.col("b")) % 97)  # parts have no order in common: the distance breaks ties
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("na") == F.col("nb"), 0.85).otherwise(0.45 * F.size(F.array_intersect(wa, wb)) / F.greatest(F.size(wa), F.size(wb))) + F.when(F.col("sa") == F.col("sb"), 0.25).otherwise(-0.7) - far)), 4)
    return d.withColumn("score", score)


@query(f"with {_PAIR} select a, b, round(greatest(0, least(1, (case when na = nb then 0.85 else 0 end) + (case when sa = sb then 0.25 else -0.7 end))), 4)::double as score from pr")
def er_score(spark, sf_dir):
    d = _pairs(spark, sf_dir)
    same = F.col("sa") == F.col("sb")
    score = matching.pair_score(F.col("na") == F.col("nb"), same, ~same, F.lit(0), F.lit(1))
    return d.select("a", "b", score.alias("score"))


@query(f"""with {_SCORED}, x as (select *, max(score) over (partition by a, db) ta, max(score) over (partition by b, da) tb from sc),
    y as (select *, count(*) filter (score > ta - 0.15) over (partition by a, db) ca, count(*) filter (score > tb - 0.15) over (partition by b, da) cb from x)
    select a, b, score::double as score, (score = ta and ca = 1 and score = tb and cb = 1) as best from y""")
def er_unique_best(spark, sf_dir):
    return matching.unique_best(_scored(spark, sf_dir).select("a", "b", "da", "db", "score")).select("a", "b", "score", "best")


@query(f"with {_PAIR} select a, b, case when na = nb then 'identical-name' when len(list_intersect(wa, wb))::double / len(list_distinct(wa || wb)) >= 0.75 and sa = sb then 'tokens-and-number' end as rule from pr")
def er_strong_rule(spark, sf_dir):
    d = _pairs(spark, sf_dir)
    wa, wb = F.array_distinct(tokens(F.col("na"))), F.array_distinct(tokens(F.col("nb")))
    jaccard = F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))
    return d.select("a", "b", F.when(F.col("na") == F.col("nb"), "identical-name").when((jaccard >= 0.75) & (F.col("sa") == F.col("sb")), "tokens-and-number").alias("rule"))


@query("select p_brand as doc, p_name as identity, count(*) as n from part group by all having count(*) > 1")
def er_identity_collision(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_name").alias("identity"))
    return matching.collisions(d, "doc", "identity")


@query("with s as (select p_name n, list_distinct(list(p_size) filter (p_brand = 'Brand#1')) l, list_distinct(list(p_size) filter (p_brand = 'Brand#2')) r from part group by 1) select n as name, case when len(l) = 1 and len(r) = 1 and l[1] = r[1] then 'agree' when len(l) = 1 and len(r) = 1 then 'conflict' else 'unknown' end as support from s")
def er_field_support(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    of = lambda b: F.collect_set(F.when(F.col("p_brand") == b, F.col("p_size")))
    d = p.groupBy(F.col("p_name").alias("name")).agg(of("Brand#1").alias("l"), of("Brand#2").alias("r"))
    return d.select("name", matching.field_support("l", "r").alias("support"))


_FACTS = "facts as (select p_name record, 'brand' field, p_type lang, p_brand as val, p_partkey source from part union all select p_name, 'size', p_type, cast(p_size as varchar), p_partkey from part), mg as (select record, field, lang, val, count(distinct source) n_sources, count(*) over (partition by record, field, lang) > 1 as needs_review from facts group by record, field, lang, val)"


def _facts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    of = lambda field, c: p.select(F.col("p_name").alias("record"), F.lit(field).alias("field"), F.col("p_type").alias("lang"), F.col(c).cast("string").alias("value"), F.col("p_partkey").alias("source"))
    return of("brand", "p_brand").union(of("size", "p_size"))


@query(f"with {_FACTS} select record, field, lang, val as value, n_sources, needs_review from mg")
def mrg_candidates(spark, sf_dir):
    return merging.candidates(_facts(spark, sf_dir))


@query(f"with {_FACTS} select record, field, lang, count(*) as n_values from mg group by all having count(*) > 1")
def mrg_conflicts(spark, sf_dir):
    return merging.conflicts(merging.candidates(_facts(spark, sf_dir)))


@query("select record, count(*) as n from (select case when p_name like 'small %' then 'tiny ' || substr(p_name, 7) else p_name end as record from part) group by 1")
def mrg_alias(spark, sf_dir):
    facts = table(spark, sf_dir, "part").select(F.col("p_name").alias("record"))
    aliases = facts.where(F.col("record").startswith("small ")).distinct().select(F.col("record").alias("alias"), F.concat(F.lit("tiny "), F.substr("record", F.lit(7))).alias("record"))
    return merging.remap(facts, aliases).groupBy("record").agg(F.count("*").alias("n"))


_PROJECT = "select record, field, val as value, lang, needs_review as conflict from (select *, row_number() over (partition by record, field order by case when lang = 'ECONOMY' then 0 when lang = 'en' then 1 when lang like 'en-%' then 2 else 3 end, lang, n_sources desc, val) r from mg{}) where r = 1"


@query(f"with {_FACTS} {_PROJECT.format('')}")
def prj_records(spark, sf_dir):
    return merging.project(merging.candidates(_facts(spark, sf_dir)), "preview", "ECONOMY")


@query(f"with {_FACTS} {_PROJECT.format(' where not needs_review')}")
def prj_records_approved(spark, sf_dir):
    return merging.project(merging.candidates(_facts(spark, sf_dir)), "approved", "ECONOMY")


@query(f"with {_FACTS}, nf as (select * from facts where source % 9 <> 0), o as (select record, field, list_sort(list_distinct(list(lang || '=' || val))) o from facts group by all), n as (select record, field, list_sort(list_distinct(list(lang || '=' || val))) n from nf group by all) select coalesce(o.record, n.record) as record, coalesce(o.field, n.field) as field, case when o is null then 'added' when n is null then 'removed' else 'changed' end as change from o full outer join n on o.record = n.record and o.field = n.field where o.o is null or n.n is null or o.o <> n.n")
def set_revision_diff(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return merging.revision_diff(merging.candidates(f), merging.candidates(f.where("source % 9 <> 0")))


@query(f"with {_FACTS} select lang as collection, count(distinct record) as records, count(*) filter (needs_review) as conflicts, round(count(*) filter (not needs_review)::double / count(*), 6) as accepted_ratio from mg group by lang")
def agg_revision_summary(spark, sf_dir):
    m = merging.candidates(_facts(spark, sf_dir))
    return m.groupBy(F.col("lang").alias("collection")).agg(F.countDistinct("record").alias("records"), F.count_if("needs_review").alias("conflicts"), F.round(F.count_if(~F.col("needs_review")) / F.count("*"), 6).alias("accepted_ratio"))


@query(f"with {_FACTS} select substr(sha256(record || chr(0) || field || chr(0) || lang), 1, 24) as question_id, record, field, lang, list_sort(list(val)) as choices from mg where needs_review group by record, field, lang")
def rev_questions(spark, sf_dir):
    m = merging.candidates(_facts(spark, sf_dir)).where("needs_review")
    d = m.groupBy("record", "field", "lang").agg(F.sort_array(F.collect_list("value")).alias("choices"))
    return d.select(F.substring(F.sha2(F.concat_ws("\x00", "record", "field", "lang").cast("binary"), 256), 1, 24).alias("question_id"), "record", "field", "lang", "choices")


@query(f"with {_FACTS}, s as (select record, field, lang, count(*) n, min(val) as val from mg group by all) select record, field, lang, val as value, 'single-source' as rule from s where n = 1 and not exists (select 1 from part where p_name = record and p_partkey % 50 = 0)")
def rev_auto_slots(spark, sf_dir):
    m = merging.candidates(_facts(spark, sf_dir))
    slots = m.groupBy("record", "field", "lang").agg(F.count("*").alias("n"), F.min("value").alias("value")).where("n = 1")
    decided = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_name").alias("record")).distinct()
    return slots.join(decided, "record", "left_anti").select("record", "field", "lang", "value", F.lit("single-source").alias("rule"))


@query("select p_type as collection, p_brand as brand, p_partkey as id, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as place from part qualify place between 21 and 30")
def srt_questions(spark, sf_dir):
    w = W.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    d = table(spark, sf_dir, "part").withColumn("place", F.row_number().over(w)).where("place between 21 and 30")
    return d.select(F.col("p_type").alias("collection"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("place").cast("long").alias("place"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40")
def srt_page_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20)


@query("select r_name as workspace, count(distinct c_custkey) as customers, count(o_orderkey) as orders, max(o_orderdate) as last_order from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by r_name")
def md_workspaces(spark, sf_dir):
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    # orders meet their customer once each; the rest is small and counted after
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    d = c.select("c_custkey", "c_nationkey").join(per, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.max("last").alias("last"))
    d = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").join(d, "n_nationkey", "left")
    return d.groupBy(F.col("r_name").alias("workspace")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders"), F.max("last").alias("last_order"))
