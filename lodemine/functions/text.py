"""String forms that the sources and the report need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(s: Column) -> Column:
    """All runs of digits as numbers."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))


def permutation(line: Column) -> Column:
    """Of a line "perm <key> inds <i> <j> ...": its key and values."""
    parts = F.split(line, " inds ")
    return F.struct(F.get(digits(parts[0]), F.lit(0)).alias("key"), F.coalesce(digits(F.get(parts, F.lit(1))), F.array().cast("array<bigint>")).alias("values"))


def checksum(values: Column) -> Column:
    """The sum of an array of whole numbers."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def dotted_path(s: Column) -> Column:
    """a.b.c as a/b/c."""
    return F.translate(s, ".", "/")


def with_suffix(s: Column, suffix: str = ".jpg") -> Column:
    """Adds the suffix unless the name ends with it in either case."""
    return F.when(F.endswith(F.lower(s), F.lit(suffix)), s).otherwise(F.concat(s, F.lit(suffix)))


def image_cell(name: Column, title: Column | None = None, link: Column | None = None, suffix: str = ".jpg") -> Column:
    """A table cell with an image, a title and a link if given."""
    shown = F.format_string('<img src="%s"/>', with_suffix(name, suffix))
    if title is not None:
        shown = F.format_string('<img src="%s" title="%s"/>', with_suffix(name, suffix), title)
    if link is not None:
        shown = F.format_string('<a href="%s">%s</a>', link, shown)
    return F.format_string("<td>%s</td>", shown)
