"""Versions, diffs, change events and graphs on the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import changes, graph
from .registry import query, table

_OLD = "o as (select doc_id, sha256(text) sha, lang from documents)"
_NEW = "n as (select doc_id, sha256(case when doc_id % 7 = 0 then text || ' edited' else text end) sha, case when doc_id % 11 = 0 then 'xx' else lang end lang from documents where doc_id % 10 <> 0 union all select doc_id + 1000000, sha256(text), lang from documents where doc_id % 25 = 1)"


def _versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    sha = F.sha2(F.col("text").cast("binary"), 256)
    old = docs.select("doc_id", sha.alias("sha"), "lang")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 10 <> 0").select("doc_id", F.sha2(edited.cast("binary"), 256).alias("sha"), F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang")).alias("lang"))
    return old, new.union(docs.where("doc_id % 25 = 1").select(F.col("doc_id") + 1000000, sha, "lang"))


_JOINED = f"with {_OLD}, {_NEW}, j as (select coalesce(o.doc_id, n.doc_id) doc_id, o.doc_id oi, n.doc_id ni, o.sha os, n.sha ns, o.lang ol, n.lang nl from o full outer join n on o.doc_id = n.doc_id)"


@query(f"{_JOINED} select doc_id, case when oi is null then 'added' when ni is null then 'removed' when os <> ns then 'content' else 'metadata' end as change from j where oi is null or ni is null or os <> ns or ol <> nl")
def set_canonical_diff(spark, sf_dir):
    return changes.snapshot_diff(*_versions(spark, sf_dir), "doc_id", "sha", "lang")


@query(f"{_JOINED} select doc_id, case when ni is null then 'delete' when oi is null or os <> ns then 'embed' when ol <> nl then 'metadata_refresh' else 'reuse' end as action from j")
def set_chunk_plan(spark, sf_dir):
    return changes.chunk_plan(*_versions(spark, sf_dir), "doc_id", "sha", "lang")


@query(f"{_JOINED} select doc_id, case when ni is null then 'delete' else 'upsert' end as change from j where oi is null or ni is null or os <> ns")
def jn_snapshot_fullouter(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return changes.changes(old, new, "doc_id", "sha")


@query(f"with {_OLD}, {_NEW} select doc_id, sha from n where not exists (select 1 from o where o.doc_id = n.doc_id and o.sha = n.sha)")
def set_index_refresh(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return changes.cache_misses(new.select("doc_id", "sha"), old, ["doc_id", "sha"])


@query(f"{_JOINED}, a as (select case when ni is null then 'delete' when oi is null or os <> ns then 'embed' when ol <> nl then 'metadata_refresh' else 'reuse' end as action from j) select (select count(*) from n) as chunks, count(*) filter (action = 'embed') as embedded, count(*) filter (action in ('reuse', 'metadata_refresh')) as reused, count(*) filter (action = 'delete') as removed, (count(*) filter (action <> 'delete')) = (select count(*) from n) as verified from a")
def set_generation_verify(spark, sf_dir):
    plan = changes.chunk_plan(*_versions(spark, sf_dir), "doc_id", "sha", "lang")
    live = F.count_if(F.col("action") != "delete")
    return plan.agg(live.alias("chunks"), F.count_if(F.col("action") == "embed").alias("embedded"), F.count_if(F.col("action").isin("reuse", "metadata_refresh")).alias("reused"), F.count_if(F.col("action") == "delete").alias("removed"), (live == F.count_if(F.col("action").isin("embed", "reuse", "metadata_refresh"))).alias("verified"))


@query(f"with {_OLD}, {_NEW}, b as (select lang, sha, count(*) b from o group by all), a as (select lang, sha, count(*) a from n group by all), j as (select coalesce(b.lang, a.lang) lang, coalesce(b, 0) b, coalesce(a, 0) a from b full outer join a on b.lang = a.lang and b.sha = a.sha) select lang, sum(b)::bigint as n_before, sum(a)::bigint as n_after, sum(least(a, b))::bigint as identical from j group by lang")
def set_multiset_stability(spark, sf_dir):
    return changes.multiset_stability(*_versions(spark, sf_dir), "lang", "sha")


@query("select sha256(text) as sha, min(doc_id) as first, count(*) as copies from documents group by 1")
def src_register_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return changes.first_of_each(d, "sha", "doc_id")


@query("select count(*) = 0 as equal, count(*) as n_changed from (select source, count(*) c from documents group by 1 except select source, count(*) from documents where doc_id % 10 <> 0 group by 1)")
def set_pins_equal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pins = lambda d: d.groupBy("source").count()
    return pins(docs).exceptAll(pins(docs.where("doc_id % 10 <> 0"))).agg((F.count("*") == 0).alias("equal"), F.count("*").alias("n_changed"))


_DAYS = """e as (select user_id, event_id, event_type, value, row_number() over (partition by user_id, event_id % 2 order by ts desc, event_id desc) r from events),
    a as (select user_id, event_type || '|' || cast(event_id as varchar) as d from e where event_id % 2 = 0 and r = 1), b as (select user_id, event_type || '|' || cast(event_id as varchar) as d from e where event_id % 2 = 1 and r = 1)"""


@query(f"with {_DAYS} select coalesce(a.user_id, b.user_id) as user_id, case when b.user_id is null then 'delete' else 'upsert' end as change from a full outer join b on a.user_id = b.user_id where a.user_id is null or b.user_id is null or a.d <> b.d")
def st_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    newest = lambda k: e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", F.concat_ws("|", "m.event_type", F.col("m.event_id").cast("string")).alias("d"))
    return changes.changes(newest(0), newest(1), "user_id", "d")


@query("select user_id, arg_max(event_id, event_id) as event_id, arg_max(event_type, event_id) as event_type, count(*) as n_open from events where event_id % 3 <> 0 group by user_id")
def jn_outbox_anti(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("generation", F.col("event_id"))
    acks = e.where("event_id % 3 = 0").select("event_id")
    return changes.unacknowledged(e, acks, "event_id", "user_id", "generation", "event_type")


@query("select doc_id from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def src_source_visibility(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(gone, "doc_id", "left_anti")


@query("select o_orderkey, c_name, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def src_pinned_views(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    d = o.select("o_orderkey", "o_custkey").join(c.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return d.join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("select user_id, event_id, event_type as status, coalesce(event_type <> prev, true) as allowed from (select user_id, event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) prev from events)")
def win_state_machine(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    d = table(spark, sf_dir, "events").withColumn("prev", F.lag("event_type").over(w))
    return d.select("user_id", "event_id", F.col("event_type").alias("status"), F.coalesce(F.col("event_type") != F.col("prev"), F.lit(True)).alias("allowed"))


@query("select user_id, max(event_id) as version from events where value is not null and event_type <> 'error' group by user_id")
def win_latest_version(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null and event_type <> 'error'").groupBy("user_id").agg(F.max("event_id").alias("version"))


@query("select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as ordinal from orders")
def win_ordinals(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("ordinal"))


@query("with s as (select sha256(text) h, min(doc_id) component from documents group by 1) select doc_id as node, component from documents join s on sha256(text) = h where component in (select component from documents join s on sha256(text) = h group by 1 having count(*) > 1)")
def gr_components(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    low = d.groupBy("h").agg(F.min("doc_id").alias("low"))
    edges = d.join(low, "h").where("doc_id <> low").select(F.col("doc_id").alias("u"), F.col("low").alias("v"))
    _checkpoints(spark)
    return graph.components(edges)


def _checkpoints(spark):
    """A folder for checkpoints where the session names none, on a local master alone."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.startswith("local"):
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspark-"))


@query("with s as (select sha256(text) h, min(doc_id) component, count(*) n, count(distinct source) k from documents group by 1) select component, n, n = k as ok from s where n > 1")
def gr_veto_components(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    low = d.groupBy("h").agg(F.min("doc_id").alias("component"), F.count("*").alias("m")).where("m > 1").drop("m")
    return graph.vetoed(d.join(low, "h"), "source")


_EDGES = "ed as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders)"


def _edges(spark, sf_dir):
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    e = lambda d, p, a, q, b: d.select(F.concat(F.lit(p), F.col(a)).alias("parent"), F.concat(F.lit(q), F.col(b)).alias("child"))
    return e(n, "r", "n_regionkey", "n", "n_nationkey").union(e(c, "n", "c_nationkey", "c", "c_custkey")).union(e(o, "c", "o_custkey", "o", "o_orderkey"))


@query(f"with recursive {_EDGES}, t(node, depth) as (select 'r1', 0 union select child, depth + 1 from t join ed on node = parent where depth < 3) select node, depth from t")
def gr_lineage_trace(spark, sf_dir):
    return graph.trace(_edges(spark, sf_dir), spark.createDataFrame([("r1",)], "node string"), 3)


@query(f"with recursive {_EDGES}, t(node) as (select 'c' || c_custkey from customer where c_custkey % 50 = 0 union select child from t join ed on node = parent) select node from t where node not in (select 'c' || c_custkey from customer where c_custkey % 50 = 0)")
def gr_invalidated(spark, sf_dir):
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("node"))
    _checkpoints(spark)
    return graph.trace(_edges(spark, sf_dir), seeds).where("depth > 0").select("node")


@query(f"with {_EDGES}, nd as (select child id, parent from ed union all select 'r' || r_regionkey, null from region) select 'roots' as problem, greatest(abs(count(*) - 1), 0) as n from nd where parent is null union all select 'several_parents', (select count(*) from (select id from nd group by id having count(distinct parent) > 1)) union all select 'dangling', (select count(*) from nd where parent is not null and parent not in (select id from nd))")
def gr_tree_validate(spark, sf_dir):
    nodes = _edges(spark, sf_dir).select(F.col("child").alias("id"), "parent")
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"))
    return graph.tree_problems(nodes.union(roots))


@query("select time_bucket(interval 1 day, ts) as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def st_events_window(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select user_id, max(event_id) as applied, count(*) - 1 as superseded from events group by user_id")
def st_dispatch(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("applied"), (F.count("*") - 1).alias("superseded"))
