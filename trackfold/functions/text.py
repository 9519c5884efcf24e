"""Recorded text lines to typed columns. Bad text becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("odo", "gps", "laser")


def fields(line: Column) -> Column:
    """Fields of a line separated by commas or semicolons, as they are written."""
    return F.split(F.translate(line, ";", ","), ",")


def text_field(parts: Column, at: int) -> Column:
    return F.get(parts, F.lit(at))


def number(written: Column) -> Column:
    """A finite number, else null: one NaN or Infinity would spoil a filter for good."""
    value = F.trim(written).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def double_field(parts: Column, at: int) -> Column:
    return number(text_field(parts, at))


def long_field(parts: Column, at: int) -> Column:
    return F.trim(text_field(parts, at)).try_cast("bigint")


def scan_field(parts: Column, at: int) -> Column:
    """All fields from ``at`` on, without quotes and brackets, as numbers; a bad one is null."""
    readings = F.slice(parts, F.lit(at + 1), F.greatest(F.size(parts) - F.lit(at), F.lit(0)))
    return F.transform(readings, lambda r: number(F.translate(r, '"[]', "")))


_NUMBER = r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
_PAIR = r"\(\s*" + _NUMBER + r"\s*,\s*" + _NUMBER + r"\s*\)"


def points(text: Column) -> Column:
    """``[(x, y), ...]`` as an array of (lx, ly)."""
    pair = F.lit(_PAIR)
    xs = F.regexp_extract_all(text, pair, F.lit(1))
    ys = F.regexp_extract_all(text, pair, F.lit(2))
    return F.zip_with(
        xs, ys, lambda x, y: F.struct(x.try_cast("double").alias("lx"), y.try_cast("double").alias("ly"))
    )


def are_points(text: Column) -> Column:
    """Whether a text is a list of pairs of finite numbers from end to end; false for null."""
    found = points(text)
    # nothing may be left beside the pairs but the brackets and a comma between each two
    left = F.regexp_replace(F.regexp_replace(text, _PAIR, "p"), r"\s+", "")
    bare = F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit("p"), F.size(found)), ","), F.lit("]"))
    limit = F.lit(float("inf"))
    finite = F.forall(found, lambda p: F.coalesce((F.abs(p["lx"]) < limit) & (F.abs(p["ly"]) < limit), F.lit(False)))
    return F.coalesce((left == bare) & finite, F.lit(False))


def points_text(points_column: Column) -> Column:
    """Inverse of ``points``."""
    pairs = F.transform(
        points_column, lambda p: F.concat(F.lit("("), p["lx"].cast("string"), F.lit(", "), p["ly"].cast("string"), F.lit(")"))
    )
    return F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]"))
