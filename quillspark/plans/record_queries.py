"""Chunks, document trees, reviews, matches, JSON pointers, jobs and pins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking, documents, graph, records
from .change_queries import _checkpoints
from .fixtures import Fixture
from .registry import query, table
from .rule_queries import plain

_TURNS = r"""p as (select conv_id, turn, case when role = 'system' then 'system' else 'dialog' end as role, unnest(ps) as t, generate_subscripts(ps, 1) as k, len(ps) as m from (select *, regexp_extract_all(text, '(?s).{1,300}\z|.{0,299}\s|.{1,300}') as ps from conversations where length(text) > 0)),
    o as (select *, k < m as cut, row_number() over (partition by conv_id order by turn, k) as i from p),"""


@query(f"""with recursive {_TURNS}
    f(conv_id, i, chunk, n, role, shut) as (select conv_id, 0::bigint, -1, 0::bigint, '', true from (select distinct conv_id from o) union all
        select o.conv_id, o.i, f.chunk + (f.shut or f.role <> o.role or f.n + 2 + length(o.t) > 300)::int, case when f.shut or f.role <> o.role or f.n + 2 + length(o.t) > 300 then length(o.t) else f.n + 2 + length(o.t) end, o.role, o.cut from f join o on o.conv_id = f.conv_id and o.i = f.i + 1)
    select conv_id, chunk, count(distinct turn) as n_nodes, string_agg(t, chr(10) || chr(10) order by i) as text from f join o using (conv_id, i) group by all""")
def win_chunk_pack(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.when(F.col("role") == "system", "system").otherwise("dialog").alias("role"), "text")
    return chunking.pack_texts(d, "conv_id", 300)


@query("""with recursive l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents), h as (select doc_id, length(line) as head from l where pos = 0),
    f(doc_id, pos, chunk, n, c) as (select doc_id, 0::bigint, 0, 0, 0::bigint from h union all
        select l.doc_id, l.pos, f.chunk + (f.n > 0 and (f.n >= 20 or head + f.c + length(line) > 1600))::int, case when f.n > 0 and (f.n >= 20 or head + f.c + length(line) > 1600) then 1 else f.n + 1 end, case when f.n > 0 and (f.n >= 20 or head + f.c + length(line) > 1600) then length(line) else f.c + length(line) end from f join l on l.doc_id = f.doc_id and l.pos = f.pos + 1 join h on h.doc_id = f.doc_id)
    select f.doc_id, chunk, min(case when f.pos > 0 then f.pos end) as first, count(*) filter (f.pos > 0) as rows, (max(head) + coalesce(sum(case when f.pos > 0 then length(line) end), 0))::bigint as chars from f join l on l.doc_id = f.doc_id and l.pos = f.pos join h on h.doc_id = f.doc_id group by f.doc_id, chunk""")
def win_chunk_table(spark, sf_dir):
    d = documents.lines(table(spark, sf_dir, "documents"))
    return chunking.pack_rows(d.select("doc_id", F.col("pos").cast("long").alias("pos"), F.length("line").alias("size")), "doc_id")


NODES = Fixture(
    "document string, id int, kind string, text string, formula string",
    [("d1", 1, "section", "Rooms", None), ("d1", 2, "text", "Two beds.", None), ("d1", 3, "table", None, None), ("d1", 4, "cell", "4", "=2+2"), ("d1", 5, "cell", None, "=A1*2"), ("d1", 6, "chart", "", None), ("d2", 7, "asset", None, None), ("d3", 8, "text", "All is told.", None), ("d3", 9, "asset", "A pool", None), ("d5", 10, "section", "Title", None)],
)
DOCS = Fixture("document string, status string", [("d1", "complete"), ("d2", "partial"), ("d3", "complete"), ("d4", "unknown"), ("d5", "complete")])
_GAPS = f"""nd as (select * from {NODES.sql}), dc as (select d.*, coalesce((select sum(length(text)) from nd where nd.document = d.document and kind = 'text'), 0) as chars, (select count(*) from nd where nd.document = d.document and kind = 'cell') as cells from {DOCS.sql} d),
    gp as (select document, 'missing_visual_description' as code, id as object, 'not described' as detail from nd where kind in ('asset', 'chart') and coalesce(text, '') = '' union all select document, 'formula_result_unavailable', id, formula from nd where kind = 'cell' and formula is not null and text is null
        union all select document, 'no_text_or_table_content', null, 'no facts' from dc where chars = 0 and cells = 0 union all select document, 'structural_coverage_incomplete', null, status from dc where status <> 'complete')"""


@query(f"with {_GAPS} select * from gp")
def prj_gaps(spark, sf_dir):
    return records.leaf_gaps(NODES.frame(spark), DOCS.frame(spark))


@query(f"with {_GAPS} select document, (select count(*) from nd where nd.document = dc.document and kind <> 'cell') as nodes, chars::bigint as characters, cells, (select count(*) from nd where nd.document = dc.document and kind = 'table') as tables, (select count(*) from nd where nd.document = dc.document and kind in ('asset', 'chart')) as visuals, (select count(*) from gp where gp.document = dc.document) as gaps, (select count(*) from gp where gp.document = dc.document) = 0 as complete from dc")
def prj_ai_document(spark, sf_dir):
    return records.document_summary(NODES.frame(spark), DOCS.frame(spark))


NAMES = Fixture("id int, name string", [(1, "Щука и Жук"), (2, "МОСТ Хлеб Цирк"), (3, "Café Ñandú"), (4, "Straße ışık"), (5, "объём чай юла ящик"), (6, None)])
_LATIN = "replace(translate(lower(name), 'ı', 'i'), 'ß', 'ss')"
for _letter, _writing in records.CYRILLIC.items():
    _LATIN = f"replace({_LATIN}, '{_letter}', '{_writing}')"


@query(f"select id, strip_accents({_LATIN}) as latin from {NAMES.sql}")
def fn_transliterate(spark, sf_dir):
    return NAMES.frame(spark).select("id", records.transliterate(F.col("name")).alias("latin"))


_DOC = '{"a/b": {"m~n": [10, {"x": "y"}, []]}, "list": ["p", "q"], "e": {}, "n": 5, "deep": {"er": {"est": true}}}'
POINTERS = Fixture("id int, pointer string", [(1, "/a~1b/m~0n/0"), (2, "/a~1b/m~0n/1/x"), (3, "/list/1"), (4, "/list/2"), (5, "/n"), (6, "/deep/er/est"), (7, "/missing"), (8, "/a~1b/m~0n/1/z"), (9, "/list/01")])


@query(f"select id, json_extract_string('{_DOC}'::json, pointer) as value from {POINTERS.sql}")
def prd_json_pointer(spark, sf_dir):
    return POINTERS.frame(spark).select("id", records.resolve_pointer(F.lit(_DOC), F.col("pointer")).alias("value"))


SLOTS = Fixture(
    "slot string, candidate string, value string, document string, verified boolean, state string",
    [("s1", "c1", "10:00 - 18:00", "d1", True, "proposed"), ("s2", "c2", "Free!", "d1", True, "proposed"), ("s2", "c3", "free", "d2", True, "proposed"), ("s2", "c3", "free", "d3", True, "proposed"), ("s3", "c4", "7.5 m", "d1", True, "proposed"), ("s3", "c5", "75 m", "d2", True, "proposed"), ("s4", "c6", "x", "d1", False, "proposed"), ("s5", "c7", "y", "d1", True, "accepted"), ("s5", "c8", "Y", "d2", True, "proposed"), ("s6", "c9", "z", "d1", True, "needs_review"), ("s6", "c0", "z.", "d2", True, "proposed")],
)


@query(rf"""with e as (select slot, candidate, any_value(value) as value, list_distinct(list(document)) as ds, bool_and(verified) as ok, bool_and(state in ('proposed', 'needs_review')) as open, max(state) as state from {SLOTS.sql} group by all),
    k as (select *, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace({plain('value')}, '([0-9])(\p{{P}})([0-9])', '\1§\3', 'g'), '[^\P{{P}}§]', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda w: w <> ''), ' ') as key from e),
    s as (select slot, bool_and(ok) and bool_and(open) and count(distinct key) = 1 as ruled, count(*) as n, len(list_distinct(flatten(list(ds)))) as nd from k group by slot), b as (select slot, candidate as best from k qualify row_number() over (partition by slot order by len(ds) desc, candidate) = 1)
    select slot, candidate, case when ruled then case when candidate = best then 'accepted' else 'rejected' end when state = 'proposed' then 'needs_review' else state end as state,
        case when ruled and candidate = best then case when n = 1 and nd = 1 then 'single_source' else 'agreeing' end when ruled then 'format_variant' when state = 'proposed' then 'human' end as rule from k join s using (slot) join b using (slot)""")
def rev_auto_accept(spark, sf_dir):
    return records.auto_review(SLOTS.frame(spark))


ENTRIES = Fixture("entry string, document string, kind string", [("a1", "d1", "room"), ("a2", "d2", "room"), ("a3", "d3", "room"), ("b1", "d1", "bar"), ("b2", "d1", "bar"), ("c1", "d1", "pool"), ("c2", "d2", "pool"), ("c3", "d3", "pool"), ("e1", "d1", "room")])
PROPOSALS = Fixture('left string, right string, decision string, review string', [("a1", "a2", "same", "accepted"), ("a2", "a3", "same", "accepted"), ("a1", "e1", "unsure", "proposed"), ("b1", "b2", "same", "accepted"), ("c1", "c2", "same", "accepted"), ("c2", "c3", "same", "accepted"), ("c1", "c3", "different", "rejected"), ("a1", "zz", "same", "proposed")])
_GROUPS = f"""pr as (select * from {PROPOSALS.sql}), ye as (select "left" as u, "right" as v from pr where review = 'accepted' and decision = 'same'), ed as (select u, v from ye union select v, u from ye),
    wk(node, r) as (select u, u from ed union select v, r from wk join ed on u = node), cp as (select node as entry, min(r) as alias from wk group by node)"""


@query(f"""with recursive {_GROUPS}, en as (select * from {ENTRIES.sql}), tw as (select alias, count(*) > count(distinct document) as twice from en join cp using (entry) group by alias),
    bp as (select distinct x.alias from pr join cp x on x.entry = pr."left" join cp y on y.entry = pr."right" where x.alias = y.alias and (decision = 'different' or review = 'rejected')),
    ap as (select entry, list_sort(list(distinct other)) as exclusions from (select "left" as entry, "right" as other from pr where review <> 'accepted' union all select "right", "left" from pr where review <> 'accepted') group by entry),
    d as (select entry, cp.alias, case when twice then 'one document twice' when bp.alias is not null then 'conflicting pair' end as error from en left join cp using (entry) left join tw on tw.alias = cp.alias left join bp on bp.alias = cp.alias
        union all select distinct e, null, 'stale' from (select unnest(["left", "right"]) as e from pr) where e not in (select entry from en))
    select entry, alias, coalesce(exclusions, []) as exclusions, error from d left join ap using (entry)""")
def jn_apply_matches(spark, sf_dir):
    _checkpoints(spark)
    return records.apply_matches(ENTRIES.frame(spark), PROPOSALS.frame(spark), graph.components)


@query(f"with recursive {_GROUPS} select kind, count(*) as input_records, count(distinct alias) as proposed_groups, count(*) - count(alias) + count(distinct alias) as projected_records, count(*) filter (alias is null) as unmatched_records from {ENTRIES.sql} left join cp using (entry) group by kind")
def agg_match_summary(spark, sf_dir):
    _checkpoints(spark)
    yes = PROPOSALS.frame(spark).where("review = 'accepted' and decision = 'same'").select(F.col("left").alias("u"), F.col("right").alias("v"))
    return records.match_summary(ENTRIES.frame(spark), graph.components(yes))


SPOKEN = Fixture("type string, name string, field string, lang string, value string", [("bar", "Sky  Bar", "hours", "tr", "10-18"), ("bar", "sky bar", "hours", "tr", "10-18"), ("bar", "SKY BAR", "hours", "tr", "11-18"), ("bar", "Sky bar", "hours", "en-GB", "10 to 18"), ("bar", "Sky bar", "fee", "de", "frei"), ("bar", "Sky bar", "fee", "tr", "ücretsiz"), ("pool", "Sky bar", "fee", "ru", "нет"), ("bar", "Sky bar", "kind", "en", "lounge"), ("bar", "Sky bar", "kind", "en-US", "lounge bar")])


@query(f"""with n as (select type, {plain('name')} as name, field, lang, value from {SPOKEN.sql} group by all), r as (select *, case when lang = 'en' then 0 when split_part(lang, '-', 1) = 'en' then 1 when lang = 'tr' then 2 else 3 end as rk from n)
    select type, name, field, lang, value, dense_rank() over (partition by type, name, field order by rk, lang) = 1 and row_number() over (partition by type, name, field, lang order by value) = 1 as primary, row_number() over (partition by type, name, field, lang order by value) > 1 as conflict from r""")
def er_coalesce(spark, sf_dir):
    return records.coalesced(SPOKEN.frame(spark), "tr")


JOBS = Fixture("queue string, job string, status string, lease_until int, attempts int, created int", [("q1", "j1", "running", 90, 1, 1), ("q1", "j2", "queued", None, 0, 2), ("q2", "j3", "running", 120, 1, 1), ("q2", "j4", "queued", None, 3, 2), ("q2", "j5", "queued", None, 0, 9), ("q3", "j6", "done", None, 1, 1), ("q4", "j8", "queued", None, 0, 5), ("q4", "j7", "queued", None, 0, 5)])


@query(f"select queue, job, attempts + 1 as attempt from {JOBS.sql} where (status = 'queued' or (status = 'running' and lease_until <= 100)) and attempts < 3 qualify row_number() over (partition by queue order by created, job) = 1")
def st_lease(spark, sf_dir):
    return records.claims(JOBS.frame(spark), 100)


VERSIONS = Fixture("workspace string, document string, version int, status string, sha256 string", [("w1", "d1", 1, "completed", "a"), ("w1", "d1", 2, "partial", "b"), ("w1", "d2", 1, "failed", "c"), ("w2", "d3", 1, "completed", "d"), ("w2", "d4", 3, "running", "e"), ("w3", "d5", 1, "failed", "f"), ("w4", "d6", 1, "queued", "g"), ("w4", "d6", 2, "completed", "h")])


@query(f"""with l as (select * from {VERSIONS.sql} qualify row_number() over (partition by workspace, document order by version desc) = 1),
    g as (select workspace, bool_or(status in ('queued', 'running')) as busy, coalesce(list(document || ':' || sha256 order by document || ':' || sha256) filter (status in ('completed', 'partial')), []) as pinned from l group by workspace)
    select workspace, case when busy or len(pinned) = 0 then 'conflict' else 'pinned' end as outcome, case when busy or len(pinned) = 0 then [] else pinned end as pinned from g""")
def md_pins(spark, sf_dir):
    return records.pins(VERSIONS.frame(spark))
