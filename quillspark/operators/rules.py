"""Rules over cells, locators, answers, evidence, names and reviews, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import column_number

NUMERIC = r"^[\d\s.,:/%+\-–]*$"
#: How much of fields and of items two units must share to be strong candidates (fixed values).
FIELD_JACCARD, ITEM_OVERLAP = 0.6, 0.5
#: Marks between the language segments of a heading (fixed value).
SEGMENTS = r"\s*[/|·•–—]\s*|\s+-\s+|\s*[()]\s*"
LOW_GRADES = ("poor", "fair")
#: Words that say nothing of a place, and words of one cuisine in four languages (fixed values).
GENERIC = ("restoran", "restorani", "restaurant", "restaurants", "restaurante", "restaurantes", "ресторан", "ресторана", "бар", "bar", "bari", "bars", "snack", "snackbar", "imbiss", "закусочная", "the")
CUISINES = {
    "fish": ("fish", "balik", "fisch", "рыба", "рыбныи"),
    "chinese": ("chinese", "cin", "cinli", "chinesisch", "chinesisches", "китаискии"),
    "italian": ("italian", "italyan", "italienisch", "italienisches", "итальянскии"),
    "steakhouse": ("steak", "steakhouse", "steakhaus", "стеик", "стеикхаус"),
    "bistro": ("bistro", "бистро"),
}


def plain(c: Column) -> Column:
    """Lower case, one blank between words."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def cell_shape(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(c.rlike(NUMERIC), "num").otherwise("text")


def strip_number(c: Column) -> Column:
    """A title without its section number; what is all numbers stays."""
    rest = F.regexp_extract(c, r"^\d{1,2}(?:\.\d{1,2})*[.)]?\s+(\S.*)$", 1)
    return F.when((rest != "") & ~rest.rlike(NUMERIC), F.rtrim(rest)).otherwise(c)


def heading_like(c: Column) -> Column:
    """Short, of a few words, no sentence, no label with a value, not a number."""
    return F.coalesce((c != "") & (F.length(c) <= 60) & (F.size(F.split(F.trim(c), r"\s+")) <= 8) & ~c.rlike(r"[.!?:;,]$") & ~c.contains(":") & ~c.rlike(NUMERIC), F.lit(False))


def structural_label(c: Column) -> Column:
    """The label in lower case, empty if it holds no letter and no digit; a number sign is a symbol."""
    return F.when(F.replace(F.coalesce(c, F.lit("")), F.lit("№"), F.lit("")).rlike(r"[\p{L}\p{N}]"), plain(c)).otherwise("")


def heading_cites(title: Column, quote: Column) -> Column:
    """Whether a quote is the whole title or one of its segments."""
    parts = F.transform(F.split(title, SEGMENTS), plain)
    return F.coalesce((plain(quote) != "") & ((plain(title) == plain(quote)) | F.array_contains(parts, plain(quote))), F.lit(False))


def place_words(c: Column) -> Column:
    """Words in lower case without accents; dotless i and sharp s as usual letters."""
    t = F.replace(F.replace(F.lower(c), F.lit("ı"), F.lit("i")), F.lit("ß"), F.lit("ss"))
    t = F.regexp_replace(F.translate(t, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿşğй", "aaaaaaceeeeiiiinooooouuuuyysgи"), r"\bsteak\s+house\b", "steakhouse")
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def place_name(c: Column) -> Column:
    """A place's telling words, cuisines under one name, in order."""
    def known(w):
        out = w
        for name, spelt in CUISINES.items():
            out = F.when(w.isin(*spelt), name).otherwise(out)
        return out

    return F.array_join(F.array_sort(F.transform(F.filter(place_words(c), lambda w: ~w.isin(*GENERIC)), known)), " ")


def display(value: Column, kind: Column) -> Column:
    """A value for an answer: truth in words, one blank between words, no brackets that cite."""
    shown = F.translate(F.trim(F.regexp_replace(value, r"\s+", " ")), "[]", "［］")
    return F.when(kind == "boolean", F.when(F.lower(value) == "true", "Evet").otherwise("Hayır")).otherwise(shown)


def slip(x: Column, y: Column) -> Column:
    """Two words of five letters or more, without digits, that one letter sets apart."""
    return (F.least(F.length(x), F.length(y)) >= 5) & ~F.concat(x, y).rlike(r"\d") & (F.levenshtein(x, y) == 1)


def near_identical(x: Column, y: Column, least: int = 40) -> Column:
    """Long texts alike but for slips in one word of ten: same numbers, same count of words. So few
    single letters keep the similarity of characters at .95, which needs no check of its own."""
    a, b = F.split(x, " "), F.split(y, " ")
    changed = F.filter(F.zip_with(a, b, lambda p, q: F.struct(p.alias("p"), q.alias("q"))), lambda z: z.p != z.q)
    digits = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)), " ")
    few = F.size(changed) <= F.greatest(F.lit(1), F.floor(F.size(a) / 10))
    return F.coalesce((x != y) & (F.least(F.length(x), F.length(y)) >= least) & (digits(x) == digits(y)) & (F.size(a) == F.size(b)) & (F.size(changed) > 0) & few & F.forall(changed, lambda z: slip(z.p, z.q)), F.lit(False))


def _corner(a1: Column, last: bool) -> tuple[Column, Column]:
    cell = F.element_at(F.split(a1, ":"), -1 if last else 1)
    return column_number(F.regexp_extract(cell, "^([A-Z]+)", 1)), F.regexp_extract(cell, "([0-9]+)$", 1).cast("int")


def locators_relate(left: str = "l_", right: str = "r_") -> Column:
    """overlap, disjoint or ambiguous, of locators in columns kind, start, end, sheet, a1, page, path."""
    a, b = (lambda n: F.col(left + n)), (lambda n: F.col(right + n))
    cells = [_corner(a("a1"), False), _corner(a("a1"), True), _corner(b("a1"), False), _corner(b("a1"), True)]
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = cells
    ranges = F.when(a("sheet") != b("sheet"), "disjoint").when((bx < cx) | (dx < ax) | (by < cy) | (dy < ay), "disjoint").otherwise("overlap")
    spans = F.when(F.greatest(a("start"), b("start")) < F.least(a("end"), b("end")), "overlap").otherwise("disjoint")
    below = lambda x, y: F.startswith(x, F.concat(F.rtrim(y, F.lit("/")), F.lit("/")))
    keys_differ = (a("page").isNull() != b("page").isNull()) | (a("path").isNull() != b("path").isNull())
    apart = F.coalesce(a("page") != b("page"), F.lit(False)) | F.coalesce((a("path") != b("path")) & ~below(a("path"), b("path")) & ~below(b("path"), a("path")), F.lit(False))
    boxes = F.when(keys_differ | (a("page").isNull() & a("path").isNull()), "ambiguous").when(apart, "disjoint").otherwise("overlap")
    return F.when(a("kind") != b("kind"), "ambiguous").when(a("kind") == "text_span", spans).when(a("kind") == "spreadsheet_range", ranges).otherwise(boxes)


def page_box(l: Column, t: Column, r: Column, b: Column, origin: Column, width: Column, height: Column, turn: Column, slack: Column) -> Column:  # noqa: E741
    """(x0, y0, x1, y1) from 0 to 1 on the page as it is seen, of a box from either corner on a page that is
    turned clockwise; null for boxes beyond the page by more than slack, or without extent."""
    top, bottom = (F.when(origin == "BOTTOMLEFT", height - y).when(origin == "TOPLEFT", y) for y in (t, b))
    inside = (-slack <= l) & (l < r) & (r <= width + slack) & (-slack <= top) & (top < bottom) & (bottom <= height + slack)
    x0, x1, y0, y1 = F.greatest(F.lit(0.0), l) / width, F.least(width, r) / width, F.greatest(F.lit(0.0), top) / height, F.least(height, bottom) / height
    box = lambda *xs: F.array(*[F.round(x, 6) for x in xs])
    seen = F.when(turn == 90, box(1 - y1, x0, 1 - y0, x1)).when(turn == 180, box(1 - x1, 1 - y1, 1 - x0, 1 - y0)).when(turn == 270, box(y0, 1 - x1, y1, 1 - x0)).otherwise(box(x0, y0, x1, y1))
    return F.when((width > 0) & (height > 0) & inside, seen)


def declared_format(files: DataFrame, formats: DataFrame) -> DataFrame:
    """files (name, mime) with the format of the longest extension that the name ends with, and an error if there
    is none or the MIME type is none of the format's. formats: (extension, format, mimes), one row an
    extension, a fixed table."""
    name = F.lower("name")
    parts = F.split(name, r"\.")
    ends = F.array_distinct(F.concat(F.array(F.element_at(parts, -1)), F.when(F.size(parts) > 2, F.array(F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1)))).otherwise(F.array().cast("array<string>"))))
    told = files.withColumn("extension", F.explode(ends)).where(F.length("name") > F.length("extension") + 1).join(F.broadcast(formats), "extension")  # a fixed table
    best = told.groupBy("name", "mime").agg(F.max_by(F.struct("format", "mimes"), F.length("extension")).alias("f"))
    d = files.join(best, ["name", "mime"], "left")
    mime = F.lower(F.trim(F.split(F.coalesce(F.nullif("mime", F.lit("")), F.lit("application/octet-stream")), ";")[0]))
    fits = F.array_contains("f.mimes", mime) | (mime == "application/octet-stream")
    return d.select("name", "mime", F.when(fits, F.col("f.format")).alias("format"), F.when(F.col("f").isNull(), "unsupported file extension").when(~fits, "MIME type and extension disagree").alias("error"))


def quality_issues(pages: DataFrame) -> DataFrame:
    """(page, code) of pages with a low grade: of reading by OCR if that score is the least there is."""
    least = F.array_min(F.array("ocr", "layout", "parse", "tables"))
    low = F.col("low_grade").isin(*LOW_GRADES) | F.col("mean_grade").isin(*LOW_GRADES)
    return pages.where(low).select("page", F.when(F.col("ocr") == least, "ocr_low_confidence").otherwise("low_text_page").alias("code"))


def cell_grid(cells: DataFrame) -> DataFrame:
    """(table_id, r, c, text, header) of every place that a cell with spans covers, the last cell where they meet."""
    d = cells.withColumn("r", F.explode(F.sequence("r0", F.col("r1") - 1))).withColumn("c", F.explode(F.sequence("c0", F.col("c1") - 1)))
    return d.groupBy("table_id", "r", "c").agg(F.max_by("text", "ordinal").alias("text"), F.max_by(F.col("header") & (F.col("r") == F.col("r0")), "ordinal").alias("header"))


def header_rows(grid: DataFrame) -> DataFrame:
    """(table_id, headers, checked): leading rows with a header cell, and how many of them are left when
    a flagged row that is shaped like the body and holds a number is data. If all rows are flagged the
    first alone may be a header, if its labels are distinct and none is a number."""
    shapes = F.array_sort(F.collect_list(F.struct("c", cell_shape(F.col("text")).alias("s"), "text")))
    rows = grid.groupBy("table_id", "r").agg(F.max("header").alias("flag"), shapes.alias("x"))
    rows = rows.select("table_id", "r", "flag", F.array_join("x.s", "|").alias("shape"), F.filter("x.text", lambda t: t != "").alias("labels"))
    in_order = W.partitionBy("table_id").orderBy("r")
    rows = rows.withColumn("led", F.min(F.col("flag").cast("int")).over(in_order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("headers", F.sum("led").over(W.partitionBy("table_id"))).withColumn("n", F.count("*").over(W.partitionBy("table_id")))
    body = rows.where("led = 0").groupBy("table_id", "shape").agg(F.count("*").alias("k"), F.min("r").alias("first"))
    body = body.groupBy("table_id").agg(F.max_by("shape", F.struct("k", -F.col("first"))).alias("pattern"))
    d = rows.where("led = 1").join(body, "table_id", "left")
    like_body = (F.col("shape") == F.col("pattern")) & F.col("shape").rlike(r"(^|\|)num(\||$)")
    labels = F.col("labels")
    sole = (F.col("n") > 1) & (F.size(labels) > 0) & (F.size(F.array_distinct(labels)) == F.size(labels)) & ~F.exists(labels, lambda t: t.rlike(NUMERIC))
    d = d.groupBy("table_id").agg(F.max("headers").alias("headers"), F.max("n").alias("n"), F.min(F.when(like_body, F.col("r"))).alias("data"), F.max(F.when(F.col("r") == 0, sole)).alias("sole"))
    checked = F.when(F.col("headers") >= F.col("n"), F.col("sole").cast("long")).otherwise(F.coalesce("data", "headers"))
    return grid.select("table_id").distinct().join(d, "table_id", "left").select("table_id", F.coalesce("headers", F.lit(0)).cast("long").alias("headers"), F.coalesce(checked, F.lit(0)).cast("long").alias("checked"))


def pair_signals(units: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard, overlap, shared, named, reasons) of pairs of units (id, fields, items, names), each a set."""
    left, right = (units.select(*[F.col(c).alias(f"{c}_{s}") for c in units.columns]) for s in ("a", "b"))
    d = pairs.join(left, F.col("a") == F.col("id_a")).join(right, F.col("b") == F.col("id_b"))
    both = lambda c: F.size(F.array_intersect(f"{c}_a", f"{c}_b"))
    least = lambda c: F.least(F.size(f"{c}_a"), F.size(f"{c}_b"))
    d = d.select(
        "a", "b", F.when(least("fields") >= 2, F.round(both("fields") / F.size(F.array_union("fields_a", "fields_b")), 4)).otherwise(0.0).alias("jaccard"),
        F.when(least("items") > 0, F.round(both("items") / F.greatest(least("items"), F.lit(1)), 4)).otherwise(0.0).alias("overlap"), both("items").cast("long").alias("shared"), (both("names") > 0).alias("named"),
    )
    reasons = F.array(F.when(F.col("jaccard") >= FIELD_JACCARD, "fields"), F.when(F.col("named"), "name"), F.when((F.col("shared") >= 1) & (F.col("overlap") >= ITEM_OVERLAP), "items"))
    return d.withColumn("reasons", F.array_join(reasons, ","))


def unit_signature(document: Column, kind: Column, name: Column, fields: Column) -> Column:
    """16 hex digits that stay over versions of a file: document, kind, name and labels, told as JSON."""
    labels = F.array_sort(F.array_distinct(F.filter(F.transform(fields, plain), lambda x: x != "")))
    quoted = F.concat(F.lit("["), F.array_join(F.transform(labels, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))
    payload = F.concat(F.lit('["'), document, F.lit('", "'), kind, F.lit('", "'), plain(name), F.lit('", '), quoted, F.lit("]"))
    return F.substring(F.sha2(payload.cast("binary"), 256), 1, 16)


def evidence_gain(hits: DataFrame, relevance: DataFrame, k: int = 5) -> DataFrame:
    """(query, recall, mrr, ndcg, false_positive) of ranked hits that carry labels (query, rank, labels) against
    (query, label, grade). A label counts where it is first seen; a hit gains its best fresh label. Without
    a relevant label the measures are null and any hit is a false positive."""
    queries = relevance.select("query").union(hits.select("query")).distinct()
    positive = relevance.where("grade > 0")
    first = hits.where(F.col("rank") <= k).select("query", "rank", F.explode("labels").alias("label")).groupBy("query", "label").agg(F.min("rank").alias("rank"))
    gains = first.join(positive, ["query", "label"]).groupBy("query", "rank").agg(F.max("grade").alias("grade"), F.count("*").alias("found"))
    worth = lambda g, at: (F.pow(F.lit(2.0), g) - 1) / F.log2(at + 1)
    got = gains.groupBy("query").agg(F.sum("found").alias("found"), F.min("rank").alias("first"), F.sum(worth(F.col("grade"), F.col("rank"))).alias("dcg"))
    best = positive.withColumn("at", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "label")))
    best = best.groupBy("query").agg(F.count("*").alias("n"), F.sum(F.when(F.col("at") <= k, worth(F.col("grade"), F.col("at")))).alias("ideal"))
    any_hit = hits.where(F.col("rank") <= k).select("query", F.lit(True).alias("hit")).distinct()
    d = queries.join(best, "query", "left").join(got, "query", "left").join(any_hit, "query", "left")
    has = F.col("n").isNotNull()
    return d.select(
        "query", F.when(has, F.round(F.coalesce("found", F.lit(0)) / F.col("n"), 6)).alias("recall"), F.when(has, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("mrr"),
        F.when(has, F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6)).alias("ndcg"), (~has & F.coalesce("hit", F.lit(False))).alias("false_positive"),
    )


def strategy_means(rows: DataFrame) -> DataFrame:
    """(strategy, recall, mrr, ndcg, no_answer_false_positives): means over the queries that have an answer."""
    return rows.groupBy("strategy").agg(*[F.round(F.avg(m), 6).alias(m) for m in ("recall", "mrr", "ndcg")], F.count_if("false_positive").alias("no_answer_false_positives"))


def answer_correct(kind: Column, expected: Column, accept: Column, conflict: Column, unit: Column, answer: Column, value: Column, value_unit: Column, abstained: Column) -> Column:
    """Whether an answer is right by the type of its question. A missing answer (all null) is wrong."""
    told = plain(F.coalesce(F.nullif(answer, F.lit("")), value, F.lit("")))
    every = F.forall(expected, lambda e: told.contains(plain(e)))
    some = F.exists(F.filter(F.concat(expected, accept), lambda e: e != ""), lambda e: told.contains(plain(e)))
    number = lambda c: F.regexp_extract(F.replace(c, F.lit(","), F.lit(".")), r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double")
    hours = lambda c: F.regexp_replace(F.regexp_extract(F.regexp_replace(c, r"\s", ""), r"[0-9]{1,2}[:.][0-9]{2}[-–][0-9]{1,2}[:.][0-9]{2}", 0), "[.]", ":")
    span = lambda c: F.regexp_replace(hours(c), "–", "-")
    given = F.coalesce(F.nullif(span(value), F.lit("")), F.nullif(span(answer), F.lit("")))
    same_unit = unit.isNull() | value_unit.isNull() | (unit == value_unit)
    right = (
        F.when(conflict, every).when(kind == "number", same_unit & (F.coalesce(number(value), number(answer)) == number(expected[0])))
        .when(kind == "time_range", given == span(expected[0])).when(kind == "list", every).otherwise(some)
    )
    gone = answer.isNull() & value.isNull() & abstained.isNull()
    out = F.coalesce(abstained, F.lit(False))
    return F.coalesce(F.when(gone, False).when(kind == "unanswerable", out).when(out, False).otherwise(right), F.lit(False))


def citation_hits(evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, document_hit, page_hit) for questions with evidence (id, document, page): whether some citation (id, document,
    locator) names one of its documents, and one of its pages; page_hit is null if no evidence has a page."""
    c = citations.select("id", "document", "locator")
    d = evidence.select("id", "document", "page").join(c, ["id", "document"], "left")
    on_page = F.when(F.col("page").isNotNull(), F.coalesce(F.contains("locator", F.col("page").cast("string")), F.lit(False)))
    return d.groupBy("id").agg(F.max(F.col("locator").isNotNull()).alias("document_hit"), F.max(on_page).alias("page_hit"))


def run_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) of questions in both runs whose outcome differs."""
    word = lambda c: F.when(c, "correct").otherwise("wrong")
    d = before.select("id", F.col("correct").alias("old")).join(after.select("id", F.col("correct").alias("new")), "id").where("old <> new")
    return d.select("id", F.concat(word(F.col("old")), F.lit(" -> "), word(F.col("new"))).alias("change"))


def table_facts(facts: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, status, actual): a fact (id, table_hint, row_label, column_label, expected) is looked up where the first
    cell of a row holds its row's label and the head of a column its column's, first table, row and column first.
    cells: (table_id, caption, r, c, text)."""
    g = cells.select("table_id", F.coalesce(plain(F.col("caption")), F.lit("")).alias("caption"), "r", "c", plain(F.col("text")).alias("text"))
    head = g.where("r = 0").select("table_id", "c", F.col("text").alias("column"))
    side = g.where("r > 0 and c = 0").select("table_id", "r", F.col("text").alias("row"))
    body = g.where("r > 0").join(head, ["table_id", "c"]).join(side, ["table_id", "r"])
    f = facts.select("id", *[F.coalesce(plain(F.col(c)), F.lit("")).alias(f"f_{c}") for c in ("table_hint", "row_label", "column_label", "expected")])
    # facts are the stated query set, held against all cells
    met = body.join(F.broadcast(f), F.contains("caption", "f_table_hint") & F.contains("row", "f_row_label") & F.contains("column", "f_column_label"))
    best = met.groupBy("id").agg(F.min_by("text", F.struct("table_id", "r", "c")).alias("actual"))
    d = f.join(best, "id", "left")
    return d.select("id", F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("f_expected"), "found").otherwise("wrong").alias("status"), "actual")


def golden_evidence(evidence: DataFrame, sections: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, in_source, in_holdout, failure): whether a quote stands in the frozen section that it names, whether that section
    is held out, and why it is not evidence at all: an unknown document, or in none of the document's texts."""
    s = sections.select("document", "locator", "split", plain(F.col("text")).alias("section"))
    d = evidence.select("id", "document", "locator", plain(F.col("quote")).alias("q")).join(s, ["document", "locator"], "left")
    t = evidence.select("id", "document", plain(F.col("quote")).alias("q")).join(texts.select("document", plain(F.col("text")).alias("whole")), "document", "left")
    t = t.groupBy("id").agg(F.max(F.col("whole").isNotNull()).alias("known"), F.max(F.coalesce(F.contains("whole", "q"), F.lit(False))).alias("held"))
    inside = F.coalesce((F.col("q") != "") & F.contains("section", "q"), F.lit(False))
    d = d.join(t, "id")
    return d.select("id", inside.alias("in_source"), (inside & (F.col("split") == "holdout")).alias("in_holdout"), F.when(~F.col("known"), "evidence_unknown_document").when(~F.col("held"), "evidence_quote_not_in_source").alias("failure"))


def fact_anchors(old: DataFrame, new: DataFrame) -> DataFrame:
    """(record, matches, by_identity, by_anchor, unchanged) of records of two revisions that share an identity value or an
    anchor, a document with a quote of its identity: where a decision can be carried forward."""
    o, n = (x.select(F.col("record").alias(s), F.concat_ws("\0", "lang", "value").alias("identity"), F.concat_ws("\0", "document", plain(F.col("quote"))).alias("anchor"), F.col("sha256").alias(f"{s}_sha"), F.col("revision").alias(f"{s}_rev")) for x, s in ((old, "o"), (new, "n")))
    both = [o.join(n, k).select("o", "n", F.lit(k).alias("how"), F.coalesce((F.col("o_sha") == F.col("n_sha")) & (F.col("o_rev") == F.col("n_rev")), F.lit(False)).alias("same")) for k in ("identity", "anchor")]
    d = both[0].union(both[1])
    return d.groupBy(F.col("o").alias("record"), F.col("n").alias("matches")).agg(F.max(F.col("how") == "identity").alias("by_identity"), F.max(F.col("how") == "anchor").alias("by_anchor"), F.max("same").alias("unchanged"))


def best_candidates(candidates: DataFrame, pins: DataFrame) -> DataFrame:
    """(slot, candidate) of slots whose every candidate is verified: each piece of evidence (slot, candidate, value, document, version,
    quote) is pinned and its quote states the value. The best has most documents, then most evidence, then the first id."""
    p = pins.select("document", "version", F.lit(True).alias("pinned")).distinct()
    states = F.concat(F.lit(" "), plain(F.col("quote")), F.lit(" ")).contains(F.concat(F.lit(" "), plain(F.col("value")), F.lit(" ")))
    d = candidates.join(p, ["document", "version"], "left").withColumn("ok", F.coalesce(F.col("pinned") & states, F.lit(False)))
    each = d.groupBy("slot", "candidate").agg(F.min("ok").alias("ok"), F.count_distinct("document").alias("documents"), F.count("*").alias("n"))
    return each.groupBy("slot").agg(F.min("ok").alias("ok"), F.min_by("candidate", F.struct(-F.col("documents"), -F.col("n"), "candidate")).alias("candidate")).where("ok").select("slot", "candidate")


def schedule_swaps(dates: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, start, end) of records whose programs (record, document, day) two documents tell the other way round: what the first document
    has beyond the second for one record is what the second has beyond the first for the other, and the reverse, at least
    so many days each; and in that period the programs are exchanged whole. Records meet by the days that only one document tells."""
    d = dates.groupBy("record", "document").agg(F.array_sort(F.collect_set("day")).alias("days"))
    two = d.groupBy("record").agg(F.array_sort(F.collect_list(F.struct("document", "days"))).alias("x")).where(F.size("x") == 2)
    two = two.select("record", F.col("x")[0].document.alias("d1"), F.col("x")[1].document.alias("d2"), F.col("x")[0].days.alias("p"), F.col("x")[1].days.alias("q"))
    two = two.withColumn("more", F.array_except("p", "q")).withColumn("less", F.array_except("q", "p")).where((F.size("more") >= least) & (F.size("less") >= least))
    left = two.select(F.col("record").alias("a"), "d1", "d2", F.col("p").alias("ap"), F.col("q").alias("aq"), F.col("more").alias("x"), F.col("less").alias("y"))
    right = two.select(F.col("record").alias("b"), "d1", "d2", F.col("p").alias("bp"), F.col("q").alias("bq"), F.col("less").alias("x"), F.col("more").alias("y"))
    m = left.join(right, ["d1", "d2", "x", "y"]).where("a < b")
    m = m.withColumn("start", F.array_min(F.concat("x", "y"))).withColumn("end", F.array_max(F.concat("x", "y")))
    during = lambda c: F.filter(c, lambda day: (day >= F.col("start")) & (day <= F.col("end")))
    return m.where((during("ap") == during("bq")) & (during("aq") == during("bp"))).select("a", "b", "start", "end")


def counts_of(kinds: list[str], rows: DataFrame, column: str) -> DataFrame:
    """(kind, n) for every kind that there is, 0 where no row has it."""
    every = rows.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(rows.groupBy(F.col(column).alias("kind")).agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))

