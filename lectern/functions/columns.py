"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTITY = r"^\s*(?:(HH|LL|H|L)\s+)?([-−]?\d+(?:\.\d+)?)\s*(\S+)(?:\s+(.*))?$"
BLANK = r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$"


def clamp_pct(c: Column) -> Column:
    """``c`` held within 0..100; null and NaN give null."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(0.0), F.least(F.lit(100.0), c)))


def pct_label(c: Column) -> Column:
    """The clamped value rounded half up, as a whole number."""
    return F.floor(clamp_pct(c) + 0.5)


def fallback_label(label: Column, page: Column) -> Column:
    """``label``, or 'Page N' where it is null or empty."""
    return F.coalesce(F.nullif(label, F.lit("")), F.concat(F.lit("Page "), page.cast("string")))


def trim_all(c: Column) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(c, BLANK, "")


def command_search_text(label: Column, keywords: Column) -> Column:
    """Label, a space, and the keywords joined by spaces; missing keywords leave the space."""
    return F.concat(label, F.lit(" "), F.concat_ws(" ", F.coalesce(keywords, F.array().cast("array<string>"))))


def parse_quantity(c: Column) -> Column:
    """Struct (limit_kind, value, unit, rest) of a quantity written as text; null without a match."""
    part = lambda g: F.nullif(F.regexp_extract(c, QUANTITY, g), F.lit(""))
    value = F.regexp_replace(F.regexp_extract(c, QUANTITY, 2), "−", "-").try_cast("double")
    return F.when(c.rlike(QUANTITY), F.struct(part(1).alias("limit_kind"), value.alias("value"), part(3).alias("unit"), part(4).alias("rest")))


def is_valid(c: Column, allowed: list[str]) -> Column:
    """Whether ``c`` is in a closed vocabulary; null is not."""
    return F.coalesce(c.isin(allowed), F.lit(False))


def normal_name(c: Column) -> Column:
    """Trimmed, lower case, white space runs as one space."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def normal_doi(c: Column) -> Column:
    """Lower case without resolver address or prefix."""
    return F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def words_of(c: Column) -> Column:
    """Runs of ASCII letters and digits and of any other letters, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if one is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
