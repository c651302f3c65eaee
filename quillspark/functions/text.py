"""Scalar functions over text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and what they fold to (fixed values).
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿğışőű"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyygisou"
WORD = r"[\p{L}\p{N}_]+"


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def tokens(c: Column) -> Column:
    """Case-folded runs of letters, digits and underscores."""
    return F.regexp_extract_all(casefold(c), F.lit(WORD), 0)


def fold(c: Column) -> Column:
    """Case and Latin marks folded, outer blanks gone: the search form."""
    return F.trim(F.translate(casefold(c), MARKED, PLAIN))


def normalize_quote(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def number(c: Column) -> Column:
    """A locale number: 1.234,56 and 12,5 and 1.234 (dots that group by three)."""
    t = F.regexp_extract(c, r"-?[0-9][0-9.,]*", 0)
    t = F.regexp_replace(t, r"[.,]+$", "")
    plain = (
        F.when(t.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(t.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^-?[0-9]+,[0-9]+$"), F.replace(t, F.lit(","), F.lit(".")))
        .otherwise(t)
    )
    return plain.try_cast("double")


def unit(c: Column) -> Column:
    t = F.lower(c)
    return (
        F.when(t.rlike(r"m²|m2|sqm"), "m2").when(t.rlike(r"€|eur"), "eur").when(t.rlike(r"person|guest|kişi"), "person").when(t.rlike(r"[0-9] ?m([^a-z0-9²]|$)"), "m")
    )


def time_range(c: Column) -> Column:
    """HH:MM-HH:MM, or null."""
    parts = [F.regexp_extract(c, r"([0-9]{1,2})[:.]([0-9]{2})\s*[-–]\s*([0-9]{1,2})[:.]([0-9]{2})", k) for k in (1, 2, 3, 4)]
    return F.when(parts[0] != "", F.concat(F.lpad(parts[0], 2, "0"), F.lit(":"), parts[1], F.lit("-"), F.lpad(parts[2], 2, "0"), F.lit(":"), parts[3]))


def list_items(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, r"[,;/\n]"), lambda x: F.trim(F.lower(x))), lambda x: x != "")))


def slug(c: Column) -> Column:
    """A label's snake-case key."""
    return F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def sorted_name(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """A name's distinct words in order, without stop words."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(tokens(fold(c)), lambda w: ~w.isin(*stop)) if stop else F.array_distinct(tokens(fold(c))))), " ")


def parse_date(c: Column) -> Column:
    """ISO, D.M.Y and D/M/Y dates; null for any other text and for days that do not exist."""
    t = F.trim(c)
    return F.coalesce(
        F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(t, "yyyy-MM-dd")),
        F.when(t.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$"), F.try_to_date(t, "d.M.yyyy")),
        F.when(t.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.try_to_date(t, "d/M/yyyy")),
    )


def column_number(c: Column) -> Column:
    """The number of a spreadsheet column: A is 1."""
    return F.aggregate(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)


def shape(c: Column) -> Column:
    """What a cell looks like: empty, number, date, short text or long text."""
    t = F.trim(c)
    return (
        F.when(t.isNull() | (t == ""), "e").when(t.rlike(r"^[-+]?[0-9][0-9.,]*%?$"), "n").when(t.rlike(r"^[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4}$"), "d")
        .when(F.length(t) <= 40, "s").otherwise("l")
    )


def scoped_id(prefix: str, *parts: Column) -> Column:
    """A stable id from a prefix and parts, told apart by a zero character."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256), 1, 24))


def etag(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def valid_vector(c: Column, dims: int) -> Column:
    return F.coalesce((F.size(c) == dims) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
