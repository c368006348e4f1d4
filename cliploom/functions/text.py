"""String functions over names, keys and free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(value: Column, length: int = 60, default: str = "unknown") -> Column:
    """White space runs become one blank; trimmed, cut, and a default where nothing is left."""
    out = F.substring(F.trim(F.regexp_replace(value, r"[ \t\n\r]+", " ")), 1, length)
    return F.when(F.coalesce(out, F.lit("")) == "", F.lit(default)).otherwise(out)


def slug(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-")


def motion_of(name: Column) -> Column:
    """True, false or null, from a marker in a name."""
    return F.when(F.contains(name, F.lit("_motion")), True).when(F.contains(name, F.lit("_idle")), False)


def json_in(value: Column) -> Column:
    """The outermost braces of a text and what is between them."""
    return F.nullif(F.regexp_extract(value, r"(?s)\{.*\}", 0), F.lit(""))


def clamped(value: Column) -> Column:
    """A text as a number from 0 to 1; what is none is 0."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
