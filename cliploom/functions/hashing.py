"""Seeded digests: stable orders and identifiers that any engine can recompute."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str, separator: str = "|") -> Column:
    """SHA-256, as hex, of parts joined by a separator."""
    return F.sha2(F.concat_ws(separator, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def short_id(value: Column) -> Column:
    return F.substring(F.coalesce(value, F.lit("")), 1, 8)
