"""Identifiers of papers and small scalar rules: normal ids, file names, DOIs of folders, years, roundings, image types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .headings import stripped


def norm_id(value: Column) -> Column:
    """The one join key: lower case, without DOI prefixes, other signs as single underscores; blank for null."""
    v = F.replace(F.replace(F.lower(stripped(value)), F.lit("https://doi.org/")), F.lit("doi:"))
    return F.regexp_replace(F.regexp_replace(v, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def safe_id(doi: Column) -> Column:
    """Other signs than letters and digits as single underscores, the case kept."""
    return F.regexp_replace(F.regexp_replace(stripped(doi), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")


def file_id(doi: Column) -> Column:
    """A file name for a DOI: lower case without prefixes; a digest stands in for a blank one."""
    bare = F.regexp_replace(F.lower(stripped(doi)), r"^https?://(dx\.)?doi\.org/", "")
    bare = stripped(F.regexp_replace(bare, r"^doi:\s*", ""))
    name = safe_id(bare)
    return F.when(name != "", name).otherwise(F.concat(F.lit("missing_doi_"), F.substring(F.sha1(bare.cast("binary")), 1, 12)))


def folder_doi(folder: Column, parts: bool = True) -> Column:
    """The DOI of a folder name: 10_1016_j_x is 10.1016/j.x; without ``parts`` only the first underscore becomes a slash."""
    v = stripped(folder)
    if not parts:
        return F.when(v.startswith("10_"), F.regexp_replace(v, "^10_", "10/")).otherwise(v)
    rest = F.regexp_replace(F.regexp_extract(v, "^10_[^_]+_(.*)$", 1), "_", ".")
    return F.when(v.rlike("^10_[^_]+_."), F.concat(F.lit("10."), F.regexp_extract(v, "^10_([^_]+)_", 1), F.lit("/"), rest)).otherwise(v)


def year_of(value: Column) -> Column:
    """The first four characters as a year from 1900 to 2100, else null."""
    y = F.expr("try_cast(null as int)") if value is None else F.try_to_number(F.substring(stripped(value.cast("string")), 1, 4), F.lit("9999")).cast("int")
    return F.when(y.between(1900, 2100), y)


def level_of(value: Column) -> Column:
    """A level of a CSV file: a number cut to an integer, null where it is none."""
    number = F.when(stripped(value).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), stripped(value)).cast("double")
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("int")


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def image_type(path: Column, content: Column | None = None) -> Column:
    """MIME type by suffix, else by the first bytes, else JPEG."""
    low = F.lower(path)
    out = F.when(low.endswith(".png"), "image/png").when(low.endswith(".webp"), "image/webp").when(low.endswith(".gif"), "image/gif")
    out = out.when(low.endswith(".bmp"), "image/bmp").when(low.rlike(r"\.jpe?g$"), "image/jpeg")
    if content is not None:
        head = F.hex(F.substring(content, 1, 4))
        out = out.when(head.startswith("89504E47"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("47494638"), "image/gif")
    return out.otherwise("image/jpeg")


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), image_type(path, content), F.lit(";base64,"), F.base64(content))


def relation_score(value: Column) -> Column:
    """A relation label's score by its beginning: traceable 1, partially traceable 0.5, not traceable 0; else null."""
    v = F.lower(stripped(value))
    return F.when(v.startswith("trace"), 1.0).when(v.startswith("partial"), 0.5).when(v.startswith("not"), 0.0)


def parse_flag(value: Column) -> Column:
    """A flag of a CSV file: false for "false" and "0" of any case, else true (also where it is missing)."""
    return ~F.lower(stripped(value)).isin("false", "0")
