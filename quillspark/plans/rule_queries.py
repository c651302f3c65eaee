"""Rules of cells, locators, answers, evidence, names and reviews on small tables of their shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from .fixtures import Fixture
from .registry import query, table

#: The same words as in SQL: lower case, one blank between words.
PLAIN = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
NUM = r"regexp_full_match({0}, '[\d\s.,:/%+\-–]*')"


def plain(column: str) -> str:
    return PLAIN.format(column)


LABELS = Fixture("id int, t string", [(1, "3.2 Restoranlar"), (2, "10:00 – 18:30"), (3, ""), (4, None), (5, "№"), (6, "№ 7"), (7, "A Blok"), (8, "★ ★"), (9, "Opening hours: all day"), (10, "One two three four five six seven eight nine"), (11, "12. 34"), (12, "  Pool   BAR "), (13, "1.1) Spa & Wellness"), (14, "Closed on Monday."), (15, "25 %")])


@query(f"select id, case when coalesce(t, '') = '' then '' when {NUM.format('t')} then 'num' else 'text' end as shape from {LABELS.sql}")
def fn_shape(spark, sf_dir):
    return LABELS.frame(spark).select("id", rules.cell_shape(F.col("t")).alias("shape"))


@query(rf"""with x as (select id, t, regexp_extract(t, '^\d{{1,2}}(?:\.\d{{1,2}})*[.)]?\s+(\S.*)$', 1) as rest from {LABELS.sql})
    select id, case when rest <> '' and not {NUM.format('rest')} then rtrim(rest) else t end as stripped,
        coalesce(t <> '' and length(t) <= 60 and len(regexp_split_to_array(trim(t), '\s+')) <= 8 and right(t, 1) not in ('.', '!', '?', ':', ';', ',') and not contains(t, ':') and not {NUM.format('t')}, false) as heading_like from x""")
def fn_norm(spark, sf_dir):
    t = F.col("t")
    return LABELS.frame(spark).select("id", rules.strip_number(t).alias("stripped"), rules.heading_like(t).alias("heading_like"))


HEADINGS = Fixture("id int, title string, quote string", [(1, "Havuz / Pool", "pool"), (2, "Havuz / Pool", "Havuz / pool"), (3, "Havuz / Pool", "Poo"), (4, "Spa - Wellness (Hamam)", "HAMAM"), (5, "Check-in", "in"), (6, "Bar", ""), (7, None, "bar"), (8, "A · B · C", "b")])


@query(rf"""select 'label' as what, id, case when regexp_matches(replace(coalesce(t, ''), '№', ''), '[\p{{L}}\p{{N}}]') then {plain('t')} else '' end as label, null::boolean as cites from {LABELS.sql}
    union all select 'heading', id, null, coalesce({plain('quote')} <> '' and ({plain('title')} = {plain('quote')} or list_contains(list_transform(regexp_split_to_array(title, '\s*[/|·•–—]\s*|\s+-\s+|\s*[()]\s*'), lambda x: {plain('x')}), {plain('quote')})), false) from {HEADINGS.sql}""")
def fn_structural_label(spark, sf_dir):
    labels = LABELS.frame(spark).select(F.lit("label").alias("what"), "id", rules.structural_label(F.col("t")).alias("label"), F.lit(None).cast("boolean").alias("cites"))
    return labels.union(HEADINGS.frame(spark).select(F.lit("heading"), "id", F.lit(None).cast("string"), rules.heading_cites(F.col("title"), F.col("quote"))))


PLACES = Fixture("id int, name string", [(1, "The Fish Restaurant"), (2, "Balık Restoranı"), (3, "Снэк бар Рыба"), (4, "Steak House Alba"), (5, "Alba Steakhaus"), (6, "Bistro"), (7, "Бистро"), (8, ""), (9, None), (10, "China-Bar 2 Çin"), (11, "Straße Imbiss")])
_CUISINE = " ".join(f"when w in ({', '.join(repr(x) for x in spelt)}) then '{name}'" for name, spelt in rules.CUISINES.items())


@query(rf"""with t as (select id, regexp_replace(translate(replace(replace(lower(name), 'ı', 'i'), 'ß', 'ss'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿşğй', 'aaaaaaceeeeiiiinooooouuuuyysgи'), '\bsteak\s+house\b', 'steakhouse', 'g') as t from {PLACES.sql}),
    w as (select id, t, list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+'), lambda w: w not in ({', '.join(repr(x) for x in rules.GENERIC)})) as ws from t)
    select id, case when t is not null then array_to_string(list_sort(list_transform(ws, lambda w: case {_CUISINE} else w end)), ' ') end as key from w""")
def fn_place_name(spark, sf_dir):
    return PLACES.frame(spark).select("id", rules.place_name(F.col("name")).alias("key"))


VALUES = Fixture("id int, kind string, value string", [(1, "boolean", "true"), (2, "boolean", "False"), (3, "text", " see  [§1 p.2]\n now "), (4, "text", None), (5, "number", "12")])


@query(rf"select id, case when kind = 'boolean' then case when lower(value) = 'true' then 'Evet' else 'Hayır' end else translate(trim(regexp_replace(value, '\s+', ' ', 'g')), '[]', '［］') end as shown from {VALUES.sql}")
def fn_display(spark, sf_dir):
    return VALUES.frame(spark).select("id", rules.display(F.col("value"), F.col("kind")).alias("shown"))


_LONG = "the room has a wide terrace with a view of the old harbour and two large beds for guests"
TWINS = Fixture("id int, x string, y string", [(1, _LONG, _LONG.replace("terrace", "terrase")), (2, _LONG, _LONG), (3, _LONG, _LONG.replace("two", "too")), (4, _LONG, _LONG.replace("large", "lrge").replace("guests", "guest")), (5, "short text", "shirt text"), (6, _LONG + " 12", _LONG.replace("harbour", "harbor") + " 13"), (7, _LONG, _LONG.replace("wide", "widest")), (8, None, _LONG), (9, _LONG, _LONG.replace("terrace", "terrase").replace("harbour", "harbor").replace("large", "larje"))])


@query(rf"""with w as (select *, string_split(x, ' ') a, string_split(y, ' ') b, array_to_string(regexp_extract_all(x, '\d+'), ' ') dx, array_to_string(regexp_extract_all(y, '\d+'), ' ') dy from {TWINS.sql}),
    c as (select *, list_filter(list_zip(a, b), lambda z: z[1] is distinct from z[2]) ch from w)
    select id, coalesce(x <> y and least(length(x), length(y)) >= 40 and dx = dy and len(a) = len(b) and len(ch) > 0 and len(ch) <= greatest(1, len(a) // 10)
        and list_bool_and(list_transform(ch, lambda z: least(length(z[1]), length(z[2])) >= 5 and not regexp_matches(z[1] || z[2], '\d') and levenshtein(z[1], z[2]) = 1)), false) as near from c""")
def fn_near_identical(spark, sf_dir):
    return TWINS.frame(spark).select("id", rules.near_identical(F.col("x"), F.col("y")).alias("near"))


_LOC = "kind string, start int, end int, sheet string, a1 string, page int, path string"
_N = (None,) * 7
LOCATORS = Fixture(
    "id int, " + ", ".join(f"{s}_{c}" for s in "lr" for c in _LOC.split(", ")),
    [
        (1, "text_span", 0, 10, None, None, None, None, "text_span", 9, 12, None, None, None, None), (2, "text_span", 0, 10, None, None, None, None, "text_span", 10, 12, None, None, None, None),
        (3, "spreadsheet_range", None, None, "S", "A1:C4", None, None, "spreadsheet_range", None, None, "S", "C4:D9", None, None), (4, "spreadsheet_range", None, None, "S", "A1", None, None, "spreadsheet_range", None, None, "T", "A1", None, None),
        (5, "spreadsheet_range", None, None, "S", "Z1:AA2", None, None, "spreadsheet_range", None, None, "S", "AB1:AC9", None, None), (6, "page", None, None, None, None, 3, None, "page", None, None, None, None, 4, None),
        (7, "page", None, None, None, None, 3, None, "page", None, None, None, None, 3, None), (8, "page", None, None, None, None, 3, None, "page", None, None, None, None, None, "/a"),
        (9, "node", None, None, None, None, None, "/a/b", "node", None, None, None, None, None, "/a"), (10, "node", None, None, None, None, None, "/ab", "node", None, None, None, None, None, "/a"), (11, "node", *_N[1:], "page", None, None, None, None, 1, None),
    ],
)


def _a1(column: str, last: bool) -> tuple[str, str]:
    cell = f"string_split({column}, ':')[{-1 if last else 1}]"
    letters = rf"regexp_extract({cell}, '^([A-Z]+)', 1)"
    number = f"list_reduce(list_prepend(0, list_transform(list_filter(string_split({letters}, ''), lambda c: c <> ''), lambda c: ascii(c) - 64)), lambda p, q: p * 26 + q)"
    return number, rf"cast(nullif(regexp_extract({cell}, '([0-9]+)$', 1), '') as int)"


(_AX, _AY), (_BX, _BY), (_CX, _CY), (_DX, _DY) = _a1("l_a1", False), _a1("l_a1", True), _a1("r_a1", False), _a1("r_a1", True)


@query(f"""select id, case when l_kind <> r_kind then 'ambiguous' when l_kind = 'text_span' then case when greatest(l_start, r_start) < least(l_end, r_end) then 'overlap' else 'disjoint' end
    when l_kind = 'spreadsheet_range' then case when l_sheet <> r_sheet or {_BX} < {_CX} or {_DX} < {_AX} or {_BY} < {_CY} or {_DY} < {_AY} then 'disjoint' else 'overlap' end
    when (l_page is null) <> (r_page is null) or (l_path is null) <> (r_path is null) or (l_page is null and l_path is null) then 'ambiguous'
    when l_page <> r_page or (l_path <> r_path and not starts_with(l_path, rtrim(r_path, '/') || '/') and not starts_with(r_path, rtrim(l_path, '/') || '/')) then 'disjoint' else 'overlap' end as relation from {LOCATORS.sql}""")
def fn_locator_relate(spark, sf_dir):
    return LOCATORS.frame(spark).select("id", rules.locators_relate().alias("relation"))


BOXES = Fixture(
    "id int, l double, t double, r double, b double, origin string, width double, height double, turn int, slack double",
    [(1, 10.0, 20.0, 60.0, 40.0, "TOPLEFT", 100.0, 200.0, 0, 0.0), (2, 10.0, 180.0, 60.0, 160.0, "BOTTOMLEFT", 100.0, 200.0, 90, 0.0), (3, 10.0, 20.0, 60.0, 40.0, "TOPLEFT", 100.0, 200.0, 180, 0.0), (4, -1.0, 20.0, 101.0, 40.0, "TOPLEFT", 100.0, 200.0, 0, 2.0), (5, -1.0, 20.0, 101.0, 40.0, "TOPLEFT", 100.0, 200.0, 0, 0.0), (6, 10.0, 20.0, 60.0, 40.0, "OTHER", 100.0, 200.0, 0, 0.0), (7, 60.0, 20.0, 10.0, 40.0, "TOPLEFT", 100.0, 200.0, 0, 0.0), (8, 10.0, 20.0, 60.0, 40.0, "TOPLEFT", 100.0, 200.0, 270, 0.0), (9, 1.0, 1.0, 2.0, 2.0, "TOPLEFT", 0.0, 200.0, 0, 0.0)],
)


@query(f"""with a as (select *, case origin when 'BOTTOMLEFT' then height - t when 'TOPLEFT' then t end as y0, case origin when 'BOTTOMLEFT' then height - b when 'TOPLEFT' then b end as y1 from {BOXES.sql}),
    n as (select *, width > 0 and height > 0 and -slack <= l and l < r and r <= width + slack and -slack <= y0 and y0 < y1 and y1 <= height + slack as ok, greatest(0, l) / width as x0n, least(width, r) / width as x1n, greatest(0, y0) / height as y0n, least(height, y1) / height as y1n from a)
    select id, case when ok then list_transform(case turn when 90 then [1 - y1n, x0n, 1 - y0n, x1n] when 180 then [1 - x1n, 1 - y1n, 1 - x0n, 1 - y0n] when 270 then [y0n, 1 - x1n, y1n, 1 - x0n] else [x0n, y0n, x1n, y1n] end, lambda v: round(v, 6)) end as box from n""")
def src_geometry(spark, sf_dir):
    d = BOXES.frame(spark).where("width > 0").withColumn("box", rules.page_box(*[F.col(c) for c in ("l", "t", "r", "b", "origin", "width", "height", "turn", "slack")]))
    return d.select("id", "box").union(BOXES.frame(spark).where("width <= 0").select("id", F.lit(None).cast("array<double>")))


FORMATS = Fixture("extension string, format string, mimes array<string>", [("pdf", "pdf", ["application/pdf"]), ("docx", "docx", ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"]), ("xlsx", "xlsx", ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"]), ("txt", "txt", ["text/plain"]), ("html", "html", ["text/html"]), ("htm", "html", ["text/html"]), ("md", "md", ["text/markdown", "text/plain"]), ("csv", "csv", ["text/csv", "application/vnd.ms-excel"]), ("png", "image", ["image/png"]), ("jpg", "image", ["image/jpeg"]), ("gz", "archive", ["application/gzip"]), ("tar.gz", "mets", ["application/gzip", "application/x-gzip"])])
FILES = Fixture("name string, mime string", [("A.PDF", "application/pdf"), ("a.pdf", "text/plain"), ("notes.md", "text/plain; charset=utf-8"), ("scan.tar.gz", "application/x-gzip"), ("scan.gz", "application/x-gzip"), ("x.exe", "application/pdf"), (".pdf", "application/pdf"), ("page.htm", ""), ("b.csv", None), ("plain", "text/plain")])


@query(f"select format, count(*) as extensions, sum(len(mimes))::bigint as mimes, min(extension) as first from {FORMATS.sql} group by format")
def src_format_table(spark, sf_dir):
    return FORMATS.frame(spark).groupBy("format").agg(F.count("*").alias("extensions"), F.sum(F.size("mimes")).alias("mimes"), F.min("extension").alias("first"))


@query(f"""with m as (select f.name, f.mime, max_by(e.format, length(extension)) as fmt, max_by(e.mimes, length(extension)) as mimes from {FILES.sql} f join {FORMATS.sql} e on ends_with(lower(f.name), '.' || extension) and length(f.name) > length(extension) + 1 group by all),
    j as (select f.*, fmt, lower(trim(split_part(coalesce(nullif(f.mime, ''), 'application/octet-stream'), ';', 1))) as said, mimes from {FILES.sql} f left join m on m.name = f.name and m.mime is not distinct from f.mime),
    k as (select *, list_contains(mimes, said) or said = 'application/octet-stream' as fits from j)
    select name, mime, case when fits and fmt is not null then fmt end as format, case when fmt is null then 'unsupported file extension' when not fits then 'MIME type and extension disagree' end as error from k""")
def src_declared_format(spark, sf_dir):
    files = FILES.frame(spark).withColumn("m", F.coalesce("mime", F.lit("\0")))
    told = rules.declared_format(files.select("name", F.col("m").alias("mime")).withColumn("mime", F.when(F.col("mime") == "\0", "").otherwise(F.col("mime"))).distinct(), FORMATS.frame(spark))
    d = files.withColumn("said", F.coalesce("mime", F.lit(""))).join(told.withColumnRenamed("mime", "said"), ["name", "said"])
    return d.select("name", "mime", "format", "error")


KEYS = Fixture("id int, workspace string, document string, uri string", [(1, "w 1", "d1", "s3://bucket/uploads/w%201/d1/v7/original"), (2, "w 1", "d1", "s3://bucket/uploads/d1/v6/original"), (3, "w 1", "d2", "s3://bucket/uploads/w%201/d1/v7/original"), (4, "w1", "d1", "file:///uploads/w1/d1/v8/copy"), (5, "w1", "d1", "http://h/uploads/w1/d1/v9/original"), (6, "w1", "d1", None)])


@query(r"""with p as (select *, string_split(ltrim(regexp_extract(uri, '^[a-z0-9]+://[^/]*(/[^?#]*)', 1), '/'), '/') as p, replace(workspace, ' ', '%20') as w from """ + KEYS.sql + r""")
    select id, 'uploads/' || w || '/' || document || '/v1/original' as key, case when len(p) = 4 and p[1] = 'uploads' and p[2] = document and p[4] = 'original' then p[3] when len(p) = 5 and p[1] = 'uploads' and p[2] = w and p[3] = document and p[5] = 'original' then p[4] end as version from p""")
def fn_storage_path(spark, sf_dir):
    p = F.split(F.ltrim(F.regexp_extract("uri", r"^[a-z0-9]+://[^/]*(/[^?#]*)", 1), F.lit("/")), "/")
    d = KEYS.frame(spark).withColumn("p", p).withColumn("w", F.replace("workspace", F.lit(" "), F.lit("%20")))
    at = lambda k: F.get("p", F.lit(k))
    short = (F.size("p") == 4) & (at(0) == "uploads") & (at(1) == F.col("document")) & (at(3) == "original")
    whole = (F.size("p") == 5) & (at(0) == "uploads") & (at(1) == F.col("w")) & (at(2) == F.col("document")) & (at(4) == "original")
    return d.select("id", F.concat_ws("/", F.lit("uploads"), "w", "document", F.lit("v1"), F.lit("original")).alias("key"), F.when(short, at(2)).when(whole, at(3)).alias("version"))


GRADES = Fixture("page int, low_grade string, mean_grade string, ocr double, layout double, parse double, tables double", [(1, "poor", "good", 0.3, 0.9, 0.8, None), (2, "good", "fair", 0.9, 0.4, 0.8, 0.7), (3, "good", "excellent", 0.1, 0.9, 0.9, 0.9), (4, "fair", "fair", None, 0.5, 0.6, None), (5, None, "poor", 0.5, 0.5, None, None)])


@query(f"select page, case when ocr = least(ocr, layout, parse, tables) then 'ocr_low_confidence' else 'low_text_page' end as code from {GRADES.sql} where low_grade in ('poor', 'fair') or mean_grade in ('poor', 'fair')")
def prd_quality_flags(spark, sf_dir):
    return rules.quality_issues(GRADES.frame(spark))


CELLS = Fixture(
    "table_id int, ordinal int, r0 int, r1 int, c0 int, c1 int, text string, header boolean",
    [(1, k, r, r + 1, c, c + 1, t, r == 0) for k, (r, c, t) in enumerate([(0, 0, "Room"), (0, 1, "Price"), (1, 0, "Single"), (1, 1, "100"), (2, 0, "Double"), (2, 1, "150")])]
    + [(2, 0, 0, 1, 0, 3, "Hours", True), (2, 1, 1, 2, 0, 1, "Pool", True), (2, 2, 1, 2, 1, 2, "10:00", True), (2, 3, 1, 2, 2, 3, "18:00", True), (2, 4, 2, 3, 0, 1, "Spa", False), (2, 5, 2, 3, 1, 2, "11:00", False), (2, 6, 2, 3, 2, 3, "19:00", False)]
    + [(3, k, r, r + 1, c, c + 1, t, True) for k, (r, c, t) in enumerate([(0, 0, "Name"), (0, 1, "Name"), (1, 0, "x"), (1, 1, "y")])]
    + [(4, k, r, r + 1, c, c + 1, t, True) for k, (r, c, t) in enumerate([(0, 0, "Name"), (0, 1, "Floor"), (1, 0, "x"), (1, 1, "2")])]
    + [(5, 0, 0, 2, 0, 1, "a", False), (5, 1, 1, 2, 0, 2, "b", False)],
)
_GRID = f"""u as (select table_id, ordinal, r0, text, header, unnest(range(r0, r1))::int as r, c0, c1 from {CELLS.sql}), v as (select * exclude (c0, c1), unnest(range(c0, c1))::int as c from u),
    g as (select table_id, r, c, max_by(text, ordinal) as text, max_by(header and r = r0, ordinal) as header from v group by all)"""


@query(f"with {_GRID} select * from g")
def str_grid(spark, sf_dir):
    return rules.cell_grid(CELLS.frame(spark))


@query(f"""with {_GRID}, s as (select *, case when coalesce(text, '') = '' then '' when {NUM.format('text')} then 'num' else 'text' end as s from g),
    ro as (select table_id, r, bool_or(header) as flag, array_to_string(list(s order by c), '|') as shape, list_filter(list(text), lambda t: t <> '') as labels from s group by all),
    l as (select *, min(flag::int) over (partition by table_id order by r) as led, count(*) over (partition by table_id) as n from ro),
    h as (select table_id, sum(led)::bigint as headers, max(n) as n from l group by all),
    b as (select table_id, shape, count(*) as k, min(r) as first from l where led = 0 group by all), p as (select table_id, shape as pattern from b qualify row_number() over (partition by table_id order by k desc, first) = 1),
    d as (select l.table_id, min(case when shape = pattern and list_contains(string_split(shape, '|'), 'num') then r end) as data, bool_or(r = 0 and n > 1 and len(labels) > 0 and len(list_distinct(labels)) = len(labels) and len(list_filter(labels, lambda t: {NUM.format('t')})) = 0) as sole from l left join p using (table_id) where led = 1 group by all)
    select table_id, headers, case when headers = 0 then 0 when headers >= n then sole::bigint else coalesce(data, headers) end::bigint as checked from h left join d using (table_id)""")
def win_header_rows(spark, sf_dir):
    return rules.header_rows(rules.cell_grid(CELLS.frame(spark)))


FACTS = Fixture("id int, table_hint string, row_label string, column_label string, expected string", [(1, "rooms", "single", "price", "100"), (2, None, "Double", "Price", "160"), (3, "spa", "Double", "Price", "150"), (4, "Rooms", "suite", "price", "300"), (5, "", "doub", "room", "double")])
TABLE = Fixture("table_id int, caption string, r int, c int, text string", [(t, cap, r, c, x) for t, cap, rows in ((1, "Our Rooms 2026", [["Room", "Price"], ["Single", "100"], ["Double", "150"]]), (2, "Spa", [["Treatment", "Price"], ["Double  massage", "80"]])) for r, row in enumerate(rows) for c, x in enumerate(row)])


@query(f"""with g as (select table_id, {plain("coalesce(caption, '')")} as caption, r, c, {plain('text')} as text from {TABLE.sql}),
    m as (select f.id, b.text, b.table_id, b.r, b.c from {FACTS.sql} f join g b on b.r > 0 join g h on h.table_id = b.table_id and h.r = 0 and h.c = b.c join g s on s.table_id = b.table_id and s.r = b.r and s.c = 0
        where contains(b.caption, {plain("coalesce(f.table_hint, '')")}) and contains(s.text, {plain('f.row_label')}) and contains(h.text, {plain('f.column_label')})),
    o as (select id, text as actual from m qualify row_number() over (partition by id order by table_id, r, c) = 1)
    select f.id, case when actual is null then 'missing' when actual = {plain('expected')} then 'found' else 'wrong' end as status, actual from {FACTS.sql} f left join o using (id)""")
def ev_tables(spark, sf_dir):
    return rules.table_facts(FACTS.frame(spark), TABLE.frame(spark))


UNITS = Fixture("id int, document string, kind string, name string, fields array<string>, items array<string>, names array<string>", [(1, "d1", "table", "Rooms", ["name", "price", "size"], ["single", "double"], ["rooms"]), (2, "d2", "table", "Odalar", ["price", "Name", "size"], ["double", "suite"], []), (3, "d2", "list", "Pools", ["name"], ["pool"], ["rooms"]), (4, "d3", "table", "Rooms", ["a", "b"], [], []), (5, "d3", "table", " ROOMS ", ["b", "a", "", "B"], ["x"], ["y"])])
PAIRS = Fixture("a int, b int", [(1, 2), (1, 3), (1, 4), (2, 3), (4, 5)])


@query(f"""with d as (select p.a, p.b, x.fields fa, y.fields fb, x.items ia, y.items ib, x.names na, y.names nb from {PAIRS.sql} p join {UNITS.sql} x on x.id = p.a join {UNITS.sql} y on y.id = p.b),
    s as (select a, b, case when least(len(fa), len(fb)) >= 2 then round(len(list_intersect(fa, fb)) / len(list_distinct(list_concat(fa, fb)))::double, 4) else 0.0 end as jaccard,
        case when least(len(ia), len(ib)) > 0 then round(len(list_intersect(ia, ib)) / least(len(ia), len(ib))::double, 4) else 0.0 end as overlap, len(list_intersect(ia, ib)) as shared, len(list_intersect(na, nb)) > 0 as named from d)
    select *, concat_ws(',', case when jaccard >= 0.6 then 'fields' end, case when named then 'name' end, case when shared >= 1 and overlap >= 0.5 then 'items' end) as reasons from s""")
def str_signals(spark, sf_dir):
    return rules.pair_signals(UNITS.frame(spark).select("id", "fields", "items", "names"), PAIRS.frame(spark))


@query(f"""with u as (select id, '["' || document || '", "' || kind || '", "' || {plain('name')} || '", [' || array_to_string(list_transform(list_sort(list_distinct(list_filter(list_transform(fields, lambda f: {plain('f')}), lambda f: f <> ''))), lambda f: '"' || f || '"'), ', ') || ']]' as payload from {UNITS.sql}),
    s as (select id, substr(sha256(payload), 1, 16) as signature from u)
    select p.a, p.b, x.signature as left_signature, 'cm_' || substr(sha256(least(x.signature, y.signature) || chr(10) || greatest(x.signature, y.signature)), 1, 24) as pair_signature from {PAIRS.sql} p join s x on x.id = p.a join s y on y.id = p.b""")
def str_signature(spark, sf_dir):
    u = UNITS.frame(spark)
    s = u.select("id", rules.unit_signature(F.col("document"), F.col("kind"), F.col("name"), F.col("fields")).alias("signature"))
    d = PAIRS.frame(spark).join(s.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a").join(s.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")
    return d.select("a", "b", F.col("x").alias("left_signature"), F.concat(F.lit("cm_"), F.substring(F.sha2(F.concat_ws("\n", F.least("x", "y"), F.greatest("x", "y")).cast("binary"), 256), 1, 24)).alias("pair_signature"))


@query(f"select k as kind, count(id) as n from (select unnest(['table', 'list', 'section', 'form']) as k) left join {UNITS.sql} on kind = k group by k")
def agg_unit_counts(spark, sf_dir):
    return rules.counts_of(["table", "list", "section", "form"], UNITS.frame(spark), "kind")


HITS = Fixture("strategy string, query string, rank int, labels array<string>", [("lexical", "q1", 1, ["a"]), ("lexical", "q1", 2, ["a", "b"]), ("lexical", "q1", 3, ["z"]), ("vector", "q1", 1, ["z"]), ("vector", "q1", 2, ["b", "c"]), ("lexical", "q2", 1, ["x"]), ("vector", "q3", 1, []), ("lexical", "q3", 6, ["d"])])
GRADED = Fixture("query string, label string, grade int", [("q1", "a", 1), ("q1", "b", 3), ("q1", "c", 2), ("q1", "e", 0), ("q2", "x", 0), ("q3", "d", 1)])
_GAIN = f"""s as (select distinct strategy from {HITS.sql}), qs as (select strategy, query from s, (select distinct query from {GRADED.sql})), h as (select * from {HITS.sql} where rank <= 5), p as (select * from {GRADED.sql} where grade > 0),
    fr as (select strategy, query, label, min(rank) as rank from (select strategy, query, rank, unnest(labels) as label from h) group by all),
    gn as (select strategy, query, rank, max(grade) as grade, count(*) as found from fr join p using (query, label) group by all),
    got as (select strategy, query, sum(found) as found, min(rank) as first, sum((2.0 ** grade - 1) / log2(rank + 1)) as dcg from gn group by all),
    be as (select query, count(*) as n, sum(case when pos <= 5 then (2.0 ** grade - 1) / log2(pos + 1) end) as ideal from (select *, row_number() over (partition by query order by grade desc, label) as pos from p) group by all),
    ev as (select strategy, query, case when n is not null then round(coalesce(found, 0) / n::double, 6) end as recall, case when n is not null then round(coalesce(1.0 / first, 0.0), 6)::double end as mrr, case when n is not null then round(coalesce(dcg, 0.0) / ideal, 6) end as ndcg, n is null and exists (select 1 from h where h.strategy = qs.strategy and h.query = qs.query) as false_positive from qs left join be using (query) left join got using (strategy, query))"""


def _evidence(spark):
    hits, graded = HITS.frame(spark), GRADED.frame(spark)
    key = F.concat_ws("\0", "strategy", "query")
    every = hits.select("strategy").distinct()
    rows = rules.evidence_gain(hits.withColumn("query", key), every.join(graded).withColumn("query", key))
    return rows.select(F.split("query", "\0")[0].alias("strategy"), F.split("query", "\0")[1].alias("query"), "recall", "mrr", "ndcg", "false_positive")


@query(f"with {_GAIN} select * from ev")
def irm_evidence(spark, sf_dir):
    return _evidence(spark)


@query(f"with {_GAIN} select strategy, round(avg(recall), 6) as recall, round(avg(mrr), 6) as mrr, round(avg(ndcg), 6) as ndcg, count(*) filter (false_positive) as no_answer_false_positives from ev group by strategy")
def irm_evaluate(spark, sf_dir):
    return rules.strategy_means(_evidence(spark))


ANSWERS = Fixture(
    "id int, kind string, expected array<string>, accept array<string>, conflict boolean, unit string, answer string, value string, value_unit string, abstained boolean, after boolean",
    [(1, "number", ["25"], [], False, "m2", "The area is 25 m2", "25", "m2", False, True), (2, "number", ["25"], [], False, "m2", "25", None, "eur", False, True), (3, "number", ["7,5"], [], False, None, "about 7.5 km", None, None, None, False), (4, "time_range", ["10:00-18:00"], [], False, None, "open 10.00 – 18.00 daily", None, None, False, True), (5, "list", ["Pool", "spa"], [], False, None, "a SPA, and a  pool", None, None, False, True),
     (6, "list", ["pool", "bar"], [], False, None, "pool", None, None, False, False), (7, "text", ["Blue room"], ["azure room"], False, None, "the Azure  Room", None, None, False, False), (8, "unanswerable", [], [], False, None, "", None, None, True, True), (9, "unanswerable", [], [], False, None, "yes", None, None, False, True), (10, "text", ["x"], [], False, None, "x", None, None, True, False), (11, "text", ["ten", "twelve"], [], True, None, "ten or twelve", None, None, False, True), (12, "text", ["ten", "twelve"], [], True, None, "ten", None, None, False, True), (13, "text", ["x"], [""], False, None, None, None, None, None, False)],
)
_VAL = r"try_cast(nullif(regexp_extract(replace({0}, ',', '.'), '-?[0-9]+(?:\.[0-9]+)?', 0), '') as double)"
_SPAN = r"nullif(replace(replace(regexp_extract(regexp_replace({0}, '\s', '', 'g'), '[0-9]{{1,2}}[:.][0-9]{{2}}[-–][0-9]{{1,2}}[:.][0-9]{{2}}', 0), '.', ':'), '–', '-'), '')"
_TOLD = plain("coalesce(nullif(answer, ''), value, '')")
_RIGHT = f"""sc as (select *, coalesce(case when answer is null and value is null and abstained is null then false when kind = 'unanswerable' then coalesce(abstained, false) when coalesce(abstained, false) then false
    when conflict or kind = 'list' then len(list_filter(expected, lambda e: not contains({_TOLD}, {plain('e')}))) = 0
    when kind = 'number' then (unit is null or value_unit is null or unit = value_unit) and coalesce({_VAL.format('value')}, {_VAL.format('answer')}) = {_VAL.format('expected[1]')}
    when kind = 'time_range' then coalesce({_SPAN.format('value')}, {_SPAN.format('answer')}) = {_SPAN.format('expected[1]')}
    else len(list_filter(list_concat(expected, accept), lambda e: e <> '' and contains({_TOLD}, {plain('e')}))) > 0 end, false) as correct from {ANSWERS.sql})"""


def _scored(spark):
    names = ("kind", "expected", "accept", "conflict", "unit", "answer", "value", "value_unit", "abstained")
    return ANSWERS.frame(spark).withColumn("correct", rules.answer_correct(*[F.col(c) for c in names]))


@query(f"with {_RIGHT} select id, correct from sc")
def ev_correct(spark, sf_dir):
    return _scored(spark).select("id", "correct")


@query(f"with {_RIGHT} select kind, count(*) as n, count(*) filter (correct) as n_correct, round(avg(correct::int), 6) as accuracy, round(avg(coalesce(abstained, false)::int), 6) as abstained from sc group by kind")
def ev_rescore(spark, sf_dir):
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return _scored(spark).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"), rate(F.col("correct")).alias("accuracy"), rate(F.coalesce("abstained", F.lit(False))).alias("abstained"))


@query(f"with {_RIGHT} select id, case when correct then 'correct' else 'wrong' end || ' -> ' || case when after then 'correct' else 'wrong' end as change from sc where correct <> after")
def ev_compare(spark, sf_dir):
    d = _scored(spark)
    return rules.run_changes(d.select("id", "correct"), d.select("id", F.col("after").alias("correct")))


EVIDENCE = Fixture("id int, document string, page int, locator string, quote string", [(1, "d1", 3, "§1", "the  Blue room"), (1, "d2", None, "§2", "pool"), (2, "d1", None, "§1", "green"), (3, "d9", 1, "§1", "x"), (4, "d2", 2, "§9", "Pool")])
CITED = Fixture("id int, document string, locator string", [(1, "d1", "p.4"), (1, "d1", "p.3"), (2, "d2", "p.1"), (4, "d2", "p.1")])


@query(f"""select e.id, bool_or(c.locator is not null) as document_hit, bool_or(case when e.page is not null then coalesce(contains(c.locator, e.page::varchar), false) end) as page_hit from {EVIDENCE.sql} e left join {CITED.sql} c on c.id = e.id and c.document = e.document group by e.id""")
def ev_citation(spark, sf_dir):
    return rules.citation_hits(EVIDENCE.frame(spark), CITED.frame(spark))


SECTIONS = Fixture("document string, locator string, split string, text string", [("d1", "§1", "holdout", "Here is the blue  ROOM of all."), ("d2", "§2", "train", "A pool and a bar"), ("d2", "§9", "holdout", "nothing")])


@query(f"""with t as (select e.id, e.document, bool_or(s.text is not null) as known, coalesce(bool_or(contains({plain('s.text')}, {plain('e.quote')})), false) as held from {EVIDENCE.sql} e left join {SECTIONS.sql} s using (document) group by e.id, e.document, e.quote)
    select e.id, e.document, coalesce(e.quote <> '' and contains({plain('s.text')}, {plain('e.quote')}), false) as in_source, coalesce(contains({plain('s.text')}, {plain('e.quote')}), false) and s.split = 'holdout' as in_holdout, case when not known then 'evidence_unknown_document' when not held then 'evidence_quote_not_in_source' end as failure
    from {EVIDENCE.sql} e left join {SECTIONS.sql} s on s.document = e.document and s.locator = e.locator join t on t.id = e.id and t.document = e.document""")
def ev_golden_evidence(spark, sf_dir):
    e = EVIDENCE.frame(spark).withColumn("key", F.concat_ws("\0", "id", "document"))
    s = SECTIONS.frame(spark)
    d = rules.golden_evidence(e.select(F.col("key").alias("id"), "document", "locator", "quote"), s, s.select("document", "text"))
    return d.select(F.split("id", "\0")[0].cast("int").alias("id"), F.split("id", "\0")[1].alias("document"), "in_source", F.coalesce("in_holdout", F.when(F.col("in_source"), None).otherwise(F.lit(False))).alias("in_holdout"), "failure")


_REV = "record string, lang string, value string, document string, quote string, sha256 string, revision string"
OLD = Fixture(_REV, [("r1", "en", "Pool", "d1", "Our  pool", "s1", "k1"), ("r2", "en", "Bar", "d1", "the bar", "s2", "k1"), ("r3", "tr", "Spa", "d2", "spa", None, "k1")])
NEW = Fixture(_REV, [("n1", "en", "Pool", "d1", "new words", "s1", "k1"), ("n2", "en", "Lobby bar", "d1", "The  bar", "s9", "k2"), ("n3", "en", "Spa", "d2", "spa", None, "k1"), ("n4", "en", "Gym", "d3", "gym", "s4", "k1")])


@query(f"""with j as (select o.record, n.record as matches, o.lang = n.lang and o.value = n.value as i, o.document = n.document and {plain('o.quote')} = {plain('n.quote')} as a, coalesce(o.sha256 = n.sha256 and o.revision = n.revision, false) as u from {OLD.sql} o, {NEW.sql} n)
    select record, matches, bool_or(i) as by_identity, bool_or(a) as by_anchor, bool_or(u) as unchanged from j where i or a group by all""")
def rev_fact_anchor(spark, sf_dir):
    return rules.fact_anchors(OLD.frame(spark), NEW.frame(spark))


CANDIDATES = Fixture("slot string, candidate string, value string, document string, version string, quote string", [("s1", "c1", "Blue room", "d1", "v1", "the blue  room here"), ("s1", "c2", "Blue", "d1", "v1", "a blue room"), ("s1", "c2", "Blue", "d2", "v1", "blue"), ("s2", "c3", "Red", "d1", "v1", "reddish"), ("s3", "c4", "Ten", "d1", "v0", "ten"), ("s4", "c6", "A", "d1", "v1", "a"), ("s4", "c5", "A", "d2", "v1", "a b")])
PINS = Fixture("document string, version string", [("d1", "v1"), ("d2", "v1")])


@query(f"""with e as (select c.*, p.document is not null and contains(' ' || {plain('quote')} || ' ', ' ' || {plain('value')} || ' ') as ok from {CANDIDATES.sql} c left join {PINS.sql} p on p.document = c.document and p.version = c.version),
    k as (select slot, candidate, bool_and(ok) as ok, count(distinct document) as d, count(*) as n from e group by all)
    select slot, candidate from k qualify row_number() over (partition by slot order by d desc, n desc, candidate) = 1 and bool_and(ok) over (partition by slot)""")
def rev_verified(spark, sf_dir):
    return rules.best_candidates(CANDIDATES.frame(spark), PINS.frame(spark))


_S, _T = [f"2026-05-{d:02d}" for d in (2, 9, 16, 23)], [f"2026-05-{d:02d}" for d in (3, 10, 17, 24)]
PROGRAM = Fixture("record string, document string, day string", [(r, d, x) for r, d, days in (("yoga", "d1", _S + ["2026-04-01"]), ("yoga", "d2", _T + ["2026-04-01"]), ("disco", "d1", _T), ("disco", "d2", _S), ("golf", "d1", _S), ("golf", "d2", _T[:3]), ("chess", "d1", _S), ("chess", "d3", _T), ("ball", "d1", _S[:2]), ("ball", "d2", _T[:2])) for x in days])


@query(f"""with d as (select record, document, list_sort(list(distinct day)) as days from {PROGRAM.sql} group by all), t as (select record, list(document order by document) as ds, list(days order by document) as p from d group by all having count(*) = 2),
    w as (select record, ds, p[1] as p, p[2] as q, list_sort(list_filter(p[1], lambda x: not list_contains(p[2], x))) as m, list_sort(list_filter(p[2], lambda x: not list_contains(p[1], x))) as l from t),
    j as (select a.record as a, b.record as b, a.p ap, a.q aq, b.p bp, b.q bq, list_min(list_concat(a.m, a.l)) as start, list_max(list_concat(a.m, a.l)) as end_ from w a join w b on a.ds = b.ds and a.record < b.record and a.m = b.l and a.l = b.m where len(a.m) >= 3 and len(a.l) >= 3)
    select a, b, start, end_ as "end" from j where list_filter(ap, lambda x: x between start and end_) = list_filter(bq, lambda x: x between start and end_) and list_filter(aq, lambda x: x between start and end_) = list_filter(bp, lambda x: x between start and end_)""")
def fn_schedule_swap(spark, sf_dir):
    return rules.schedule_swaps(PROGRAM.frame(spark))


AUDIT = Fixture("record string, state string", [("r1", "accepted"), ("r1", "rejected"), ("r2", "accepted"), ("r3", "needs_review")])


@query(f"select k as kind, count(state) as n from (select unnest(['accepted', 'rejected', 'needs_review', 'proposed']) as k) left join {AUDIT.sql} on state = k group by k")
def agg_review_counts(spark, sf_dir):
    return rules.counts_of(["accepted", "rejected", "needs_review", "proposed"], AUDIT.frame(spark), "state")
