"""Projections and gaps of a document tree, review rules, matches, JSON pointers, jobs and pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .rules import plain

#: Cyrillic letters in Latin writing (fixed values).
CYRILLIC = dict(
    zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", ("a", "b", "v", "g", "d", "e", "e", "zh", "z", "i", "i", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "kh", "ts", "ch", "sh", "shch", "", "y", "", "e", "yu", "ya"), strict=True)
)


def transliterate(c: Column) -> Column:
    """Lower case in Latin letters without accents."""
    t = F.translate(F.lower(c), "ı", "i")
    for letter, latin in {"ß": "ss", **{k: v for k, v in CYRILLIC.items() if len(v) != 1}}.items():
        t = F.replace(t, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in CYRILLIC.items() if len(v) == 1}
    t = F.translate(t, "".join(single), "".join(single.values()))
    return F.regexp_replace(F.translate(t, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿşğ", "aaaaaaceeeeiiiinooooouuuuyysg"), r"\p{M}", "")


def resolve_pointer(document: Column, pointer: Column) -> Column:
    """What a JSON pointer names, as text; null if it names nothing. A token of digits is a place in a list, or else
    a key."""
    def path(tokens, numbers: bool):
        def one(t):
            key = F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
            named = F.concat(F.lit("['"), key, F.lit("']"))
            return F.when(t.rlike("^(0|[1-9][0-9]*)$"), F.concat(F.lit("["), t, F.lit("]"))).otherwise(named) if numbers else named

        return F.concat(F.lit("$"), F.array_join(F.transform(tokens, one), ""))

    tokens = F.split(F.substr(pointer, F.lit(2)), "/")
    found = F.coalesce(*[F.call_function("get_json_object", document, path(tokens, numbers)) for numbers in (True, False)])
    return F.when(pointer == "", document).when(pointer.startswith("/") & ~pointer.rlike("~([^01]|$)"), found)


def leaf_gaps(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, code, object, detail) of what a document tree does not tell: visuals without description, formulas
    without value, documents without text and cells, incomplete coverage."""
    gap = lambda d, code, detail, obj=F.col("id"): d.select("document", F.lit(code).alias("code"), obj.alias("object"), detail.alias("detail"))
    none = F.lit(None).cast("int")
    visual = gap(nodes.where("kind in ('asset', 'chart') and coalesce(text, '') = ''"), "missing_visual_description", F.lit("not described"))
    formula = gap(nodes.where("kind = 'cell' and formula is not null and text is null"), "formula_result_unavailable", F.col("formula"))
    told = nodes.groupBy("document").agg(F.sum(F.when(F.col("kind") == "text", F.length("text")).otherwise(0)).alias("chars"), F.count_if(F.col("kind") == "cell").alias("cells"))
    d = documents.join(told, "document", "left")
    empty = gap(d.where("coalesce(chars, 0) = 0 and coalesce(cells, 0) = 0"), "no_text_or_table_content", F.lit("no facts"), none)
    open_ = gap(d.where("status <> 'complete'"), "structural_coverage_incomplete", F.col("status"), none)
    return visual.union(formula).union(empty).union(open_)


def document_summary(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(document, nodes, characters, cells, tables, visuals, gaps, complete)."""
    n = nodes.groupBy("document").agg(
        F.count_if(F.col("kind") != "cell").alias("nodes"), F.coalesce(F.sum(F.when(F.col("kind") == "text", F.length("text"))), F.lit(0)).cast("long").alias("characters"),
        F.count_if(F.col("kind") == "cell").alias("cells"), F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind").isin("asset", "chart")).alias("visuals"),
    )
    g = leaf_gaps(nodes, documents).groupBy("document").agg(F.count("*").alias("gaps"))
    d = documents.select("document").join(n, "document", "left").join(g, "document", "left").na.fill(0)
    return d.withColumn("complete", F.col("gaps") == 0)


def auto_review(candidates: DataFrame) -> DataFrame:
    """(slot, candidate, state, rule) of open slots whose candidates (slot, candidate, value, document, verified, state) are all verified and
    differ in writing alone: the one of most documents, then the first, is accepted, its other spellings are kept as
    variants. Every other proposal asks a person."""
    key = F.trim(F.regexp_replace(F.regexp_replace(plain(F.col("value")), r"(?<![0-9])\p{P}|\p{P}(?![0-9])", " "), r"\s+", " "))
    each = candidates.groupBy("slot", "candidate").agg(F.first("value").alias("value"), F.collect_set("document").alias("documents"), F.min("verified").alias("ok"), F.min(F.col("state").isin("proposed", "needs_review")).alias("open"), F.max("state").alias("state"))
    each = each.withColumn("key", key)
    slot = each.groupBy("slot").agg(F.min("ok").alias("all_ok"), F.min("open").alias("all_open"), F.count_distinct("key").alias("keys"), F.count("*").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("documents")))).alias("n_documents"), F.min_by("candidate", F.struct(-F.size("documents"), "candidate")).alias("best"))
    d = each.join(slot, "slot")
    ruled = F.col("all_ok") & F.col("all_open") & (F.col("keys") == 1)
    mine = F.col("candidate") == F.col("best")
    state = F.when(ruled, F.when(mine, "accepted").otherwise("rejected")).when(F.col("state") == "proposed", "needs_review").otherwise(F.col("state"))
    rule = F.when(ruled & mine, F.when((F.col("n") == 1) & (F.col("n_documents") == 1), "single_source").otherwise("agreeing")).when(ruled, "format_variant").when(F.col("state") == "proposed", "human")
    return d.select("slot", "candidate", state.alias("state"), rule.alias("rule"))


def apply_matches(entries: DataFrame, proposals: DataFrame, grouped) -> DataFrame:
    """(entry, alias, exclusions, error): accepted proposals (left, right, decision, review) give their group's alias, the least entry; all
    others exclude their two entries from each other. error names stale proposals, groups with two entries of one document
    and groups that a rejected pair would be bypassed in. grouped: components of edges (u, v)."""
    known = entries.select(F.col("entry").alias("e"))
    ends = proposals.select(F.explode(F.array("left", "right")).alias("e"))
    stale = ends.join(known, "e", "left_anti").distinct().select(F.col("e").alias("entry"), F.lit(None).cast("string").alias("alias"), F.lit("stale").alias("error"))
    yes = proposals.where("review = 'accepted' and decision = 'same'")
    comp = grouped(yes.select(F.col("left").alias("u"), F.col("right").alias("v"))).withColumnsRenamed({"node": "entry", "component": "alias"})
    of_doc = entries.join(comp, "entry").groupBy("alias").agg((F.count("*") > F.count_distinct("document")).alias("twice"))
    no = proposals.where("decision = 'different' or review = 'rejected'")
    inside = no.join(comp.select(F.col("entry").alias("left"), F.col("alias").alias("x")), "left").join(comp.select(F.col("entry").alias("right"), F.col("alias").alias("y")), "right").where("x = y").select(F.col("x").alias("alias"), F.lit(True).alias("bypassed")).distinct()
    open_ = proposals.where("review <> 'accepted'")
    apart = open_.select(F.col("left").alias("entry"), F.col("right").alias("other")).union(open_.select("right", "left"))
    apart = apart.groupBy("entry").agg(F.array_sort(F.collect_set("other")).alias("exclusions"))
    d = entries.select("entry").join(comp, "entry", "left").join(of_doc, "alias", "left").join(inside, "alias", "left")
    d = d.select("entry", "alias", F.when(F.col("twice"), "one document twice").when(F.col("bypassed"), "conflicting pair").alias("error"))
    return d.unionByName(stale).join(apart, "entry", "left").select("entry", "alias", F.coalesce("exclusions", F.array().cast("array<string>")).alias("exclusions"), "error")


def match_summary(entries: DataFrame, comp: DataFrame) -> DataFrame:
    """(kind, input_records, proposed_groups, projected_records, unmatched_records)."""
    d = entries.join(comp.withColumnsRenamed({"node": "entry"}), "entry", "left")
    return d.groupBy("kind").agg(
        F.count("*").alias("input_records"), F.count_distinct("component").alias("proposed_groups"),
        (F.count("*") - F.count("component") + F.count_distinct("component")).alias("projected_records"), F.count_if(F.col("component").isNull()).alias("unmatched_records"),
    )


def coalesced(facts: DataFrame, document_lang: str) -> DataFrame:
    """(type, name, field, lang, value, primary, conflict) of one document's facts, one record for each type and name: of a language's
    values the first is kept and the others are conflicts; English leads, then the document's language, then the others."""
    named = facts.withColumn("name", plain(F.col("name"))).groupBy("type", "name", "field", "lang", "value").agg(F.count("*").alias("n"))
    base = F.split("lang", "-")[0]
    rank = F.when(F.col("lang") == "en", 0).when(base == "en", 1).when(F.col("lang") == document_lang, 2).otherwise(3)
    in_lang = W.partitionBy("type", "name", "field", "lang").orderBy("value")
    d = named.withColumn("nth", F.row_number().over(in_lang)).withColumn("lead", F.dense_rank().over(W.partitionBy("type", "name", "field").orderBy(rank, "lang")))
    return d.select("type", "name", "field", "lang", "value", ((F.col("lead") == 1) & (F.col("nth") == 1)).alias("primary"), (F.col("nth") > 1).alias("conflict"))


def claims(jobs: DataFrame, now: int, most_attempts: int = 3) -> DataFrame:
    """(queue, job, attempt) of the job that a worker of each queue takes next: the oldest that waits, or runs under a lease that
    is over, and has attempts left."""
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lease_until") <= now))
    ready = jobs.where(free & (F.col("attempts") < most_attempts))
    best = ready.groupBy("queue").agg(F.min_by(F.struct("job", "attempts"), F.struct("created", "job")).alias("x"))
    return best.select("queue", "x.job", (F.col("x.attempts") + 1).alias("attempt"))


def pins(versions: DataFrame) -> DataFrame:
    """(workspace, outcome, pinned): the latest version of each document (workspace, document, version, status, sha256) is pinned if it is usable and skipped
    if it failed; one that is still prepared, or nothing to pin, blocks the workspace."""
    latest = versions.groupBy("workspace", "document").agg(F.max_by(F.struct("status", "sha256"), "version").alias("x"))
    status = F.col("x.status")
    d = latest.groupBy("workspace").agg(F.max(status.isin("queued", "running")).alias("busy"), F.array_sort(F.collect_list(F.when(status.isin("completed", "partial"), F.concat_ws(":", "document", "x.sha256")))).alias("pinned"))
    blocked = F.col("busy") | (F.size("pinned") == 0)
    return d.select("workspace", F.when(blocked, "conflict").otherwise("pinned").alias("outcome"), F.when(blocked, F.array().cast("array<string>")).otherwise(F.col("pinned")).alias("pinned"))
