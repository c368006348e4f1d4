"""Ratios and statistics in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """0.0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within 0 and 1; (0, 0) for no trials."""
    p, m = successes.cast("double") / n, n.cast("double")
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return (
        F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)),
        F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), centre + half)),
    )


def tiles_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image that is counted by tiles of 512."""
    return 85 + 170 * F.ceil(width / 512) * F.ceil(height / 512)


def area_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image that is counted by its area."""
    return F.ceil(width * height / 750)


def expected_tokens(primary: Column, fallback_rate: Column, fallback: Column) -> Column:
    return primary + fallback_rate * fallback


def token_reduction(baseline: Column, expected: Column) -> Column:
    return 1 - expected / baseline


def most_fallback(baseline: Column, primary: Column, target: Column, fallback: Column) -> Column:
    """Largest share of rows that may fall back while the target is kept, from 0 to 1."""
    left = baseline * (1 - target) - primary
    return F.when(left <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / fallback)))


def per_second(frames: Column, seconds: Column) -> Column:
    """Null without frames or without a length."""
    return F.when(frames.isNotNull() & (seconds > 0), frames / seconds)


def rounded_ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """The ratio to so many digits (6 at most), ties to the even one; 0.0 where there is nothing to divide by.

    What counts as a tie is the binary value, not its shortest decimal form: twice the value in steps is taken apart into
    products that are exact, so its side of the midpoint is certain."""
    scale = float(10**digits)
    value = ratio(part, whole)
    low = F.floor(value * scale).cast("double")
    high_bits = value.cast("float").cast("double")
    beyond = (high_bits * (2 * scale) - (2 * low + 1)) + (value - high_bits) * (2 * scale)
    up = (beyond > 0) | ((beyond == 0) & (low % 2 != 0))
    return (low + F.when(up, 1.0).otherwise(0.0)) / scale
