"""Comparisons of sets, coverage counts and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, once each, and on which side."""
    return a.subtract(b).withColumn("side", F.lit("first")).unionByName(b.subtract(a).withColumn("side", F.lit("second")))


def key_report(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Counts of keys that are missing, unexpected and common, and whether the sets are equal."""
    a, b = expected.select(key).distinct().withColumn("e", F.lit(1)), actual.select(key).distinct().withColumn("a", F.lit(1))
    out = a.join(b, key, "full").agg(
        F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("e").isNull()).alias("unexpected"), F.count_if(F.col("a").isNotNull() & F.col("e").isNotNull()).alias("common")
    )
    return out.withColumn("complete", (F.col("missing") == 0) & (F.col("unexpected") == 0))


def coverage(rows: DataFrame) -> DataFrame:
    """Distinct clips by camera and day, by camera and in all: eligible ones, those with evidence and complete ones.
    A clip is reduced to one row first, so one aggregation over the grouping sets needs no distinct counts."""
    one = rows.groupBy("camera_id", "activity_day", "clip_id").agg(F.max(F.col("evidence").cast("int")).alias("e"), F.max(F.col("complete").cast("int")).alias("c"))
    grouped = one.groupingSets([[F.col("camera_id"), F.col("activity_day")], [F.col("camera_id")], []], "camera_id", "activity_day").agg(
        F.grouping_id().alias("level"), F.count("*").alias("eligible"), F.sum("e").alias("with_evidence"), F.sum("c").alias("n_complete")
    )
    return grouped.withColumn("complete_ratio", ratio(F.col("n_complete"), F.col("eligible")))


def ladder(gates: list[tuple[str, object]]):
    """Name of the first gate that fails, else pass."""
    out = None
    for name, holds in gates:
        out = F.when(~holds, F.lit(name)) if out is None else out.when(~holds, F.lit(name))
    return out.otherwise(F.lit("pass"))


def leakage(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that occur in more than one part, and keys that occur twice in one."""
    seen = rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(part).alias("n_parts"))
    both = seen.filter("n_parts > 1").select(F.lit("both_parts").alias("code"), F.col(key).cast("string").alias("key"))
    return both.unionByName(seen.filter("n > n_parts").select(F.lit("duplicate").alias("code"), F.col(key).cast("string").alias("key")))


def shared_keys(rows: DataFrame, axes: dict[str, Column], part: str) -> DataFrame:
    """axis and key of what more than one part has, for each axis; rows are read once."""
    asked = F.array(*[F.struct(F.lit(name).alias("axis"), key.alias("key")) for name, key in axes.items()])
    told = rows.select(part, F.explode(asked).alias("a")).groupBy("a.axis", "a.key").agg(F.size(F.collect_set(part)).alias("n_parts"))
    return told.filter("n_parts > 1").select("axis", "key")
