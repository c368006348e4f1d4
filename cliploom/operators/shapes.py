"""Shapes of a short numeric series inside one row, and orders inside a small scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_below(values: Column, bound: float) -> Column:
    """start (from 0) and length of the longest run of values below `bound` times the largest one; the earliest of equal
    runs; length 0 and start null without any. A series whose largest value is not above 0 has no run."""
    peak = F.array_max(values).cast("double")
    fold = F.aggregate(
        values,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(None).cast("int").alias("start")),
        lambda acc, x: _step(acc, (peak > 0) & (x.cast("double") / peak < bound)),
    )
    return F.struct(fold["start"].alias("start"), fold["best"].alias("length"))


def _step(acc: Column, low: Column) -> Column:
    now = F.when(low, acc["now"] + 1).otherwise(0)
    longer = now > acc["best"]
    return F.struct(
        (acc["i"] + 1).alias("i"),
        now.alias("now"),
        F.when(longer, now).otherwise(acc["best"]).alias("best"),
        F.when(longer, acc["i"] - now + 1).otherwise(acc["start"]).alias("start"),
    )


def even_indices(n: Column, k: int) -> Column:
    """k positions from 0 to n - 1 at even distances, cut to whole numbers; all positions where n is at most k."""
    last = n - 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == k - 1, last).otherwise((i * (last / float(k - 1))).cast("long")))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= k, F.sequence(F.lit(0).cast("bigint"), last)).otherwise(spread)


def levels(values: Column, width: int, most: int = 7) -> Column:
    """Largest value of every `width` values, as digits from 0 (the lowest of these) to `most` (the highest)."""
    count = F.ceil(F.size(values) / width).cast("int")
    tops = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.array_max(F.slice(values, i * width + 1, width)).cast("double"))
    low, high = F.array_min(tops), F.array_max(tops)
    digit = lambda t: F.when(high == low, F.lit(0)).otherwise(F.floor((t - low) / (high - low) * most)).cast("string")
    return F.array_join(F.transform(tops, digit), "")


#: Glyphs from low to high, and the most that a line has.
GLYPHS, MOST_GLYPHS = "▁▂▃▄▅▆▇█", 60


def spark_line(values: Column) -> Column:
    """A glyph for each value from 0 to 1 (values beyond are the lowest or highest glyph); of more than 60 values the largest
    of each of 60 even parts. Empty for no values."""
    n = F.size(values)
    part = n / float(MOST_GLYPHS)
    edge = lambda i: F.floor(i * part).cast("int")
    tops = F.transform(F.sequence(F.lit(0), F.lit(MOST_GLYPHS - 1)), lambda i: F.array_max(F.slice(values, edge(i) + 1, edge(i + 1) - edge(i))).cast("double"))
    shown = F.when(n > MOST_GLYPHS, tops).otherwise(values.cast("array<double>"))
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(len(GLYPHS) - 1), (v * len(GLYPHS)).cast("int")))
    return F.array_join(F.transform(shown, lambda v: F.substring(F.lit(GLYPHS), level(v) + 1, F.lit(1))), "")


def low_high(rows: DataFrame, scope: list[str], value: str, key: str) -> DataFrame:
    """Place of each row when smallest and largest values of its scope take turns (1: the smallest, 2: the largest)."""
    nth = F.row_number().over(Window.partitionBy(*scope).orderBy(value, key))
    n = F.count("*").over(Window.partitionBy(*scope))
    return rows.withColumns({"nth": nth, "n": n}).withColumn("place", F.when(2 * F.col("nth") <= F.col("n") + 1, 2 * F.col("nth") - 1).otherwise(2 * (F.col("n") - F.col("nth") + 1))).drop("nth", "n")
