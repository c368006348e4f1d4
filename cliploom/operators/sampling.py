"""Selections that any engine repeats: orders come from digests, not from random numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest


def hashed(rows: DataFrame, seed: str, key: str) -> DataFrame:
    return rows.withColumn("draw", digest(seed, F.col(key)))


def per_stratum(rows: DataFrame, seed: str, key: str, strata: list[str], k: int) -> DataFrame:
    """k rows of each stratum. A stratum may hold any share of the rows: each of 64 slices of it is cut to k first."""
    slice_no = F.pmod(F.xxhash64(key), F.lit(64))
    first = Window.partitionBy(*strata, "slice_no").orderBy("draw", key)
    again = Window.partitionBy(*strata).orderBy("draw", key)
    cut = hashed(rows, seed, key).withColumn("slice_no", slice_no).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k)
    return cut.withColumn("nth", F.row_number().over(again)).filter(F.col("nth") <= k).drop("slice_no")


def round_robin(rows: DataFrame, seed: str, key: str, strata: list[str], rounds: int, n: int) -> DataFrame:
    """One of each stratum in turn, strata by their digest, up to n rows."""
    picked = per_stratum(rows, seed, key, strata, rounds).withColumn("stratum", digest(seed, *[F.col(s) for s in strata]))
    return picked.orderBy("nth", "stratum", key).limit(n)


def ranks(rows: DataFrame, strata: list[str], value: str, key: str, slices: int = 256) -> DataFrame:
    """rows with their rank (from 0) by value and key in their stratum, and the stratum's number of rows. Strata are cut
    into slices of their range of values; only slices are sorted, and start where the counts of those before them end."""
    spans = rows.groupBy(*strata).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n_group"))
    cut = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.lit(slices - 1), F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * slices)))
    sliced = rows.join(spans, strata).withColumn("slice", F.coalesce(cut, F.lit(-1)).cast("int")).drop("low", "high")
    before = Window.partitionBy(*strata).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # at most slices + 1 rows
    starts = sliced.groupBy(*strata, "slice").agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    nth = F.row_number().over(Window.partitionBy(*strata, "slice").orderBy(value, key)) - 1
    return sliced.withColumn("nth", nth).join(starts, [*strata, "slice"]).withColumn("rank", F.col("start") + F.col("nth")).drop("nth", "start", "slice")


def bucket_winner(rows: DataFrame, seed: str, key: str, bucket: list[str]) -> DataFrame:
    """Of near duplicates in a bucket the one with the smallest digest."""
    rest = [c for c in rows.columns if c not in bucket]
    return hashed(rows, seed, key).groupBy(*bucket).agg(F.min_by(F.struct(*rest), F.struct("draw", key)).alias("r"), F.count("*").alias("n_bucket")).select(*bucket, "r.*", "n_bucket")


def quartile_sample(rows: DataFrame, seed: str, key: str, strata: list[str], value: str, k: int) -> DataFrame:
    """k rows of each quarter of a stratum by value (earlier quarters take what does not divide)."""
    ranked = ranks(rows, strata, value, key)
    size, more = F.floor(F.col("n_group") / 4), F.col("n_group") % 4
    first = more * (size + 1)  # ranks in the quarters that have one row more
    at = F.col("rank")
    quarter = F.when(at < first, F.floor(at / (size + 1))).otherwise(more + F.floor((at - first) / size)) + 1
    return per_stratum(ranked.withColumn("quarter", quarter.cast("int")).drop("rank", "n_group"), seed, key, [*strata, "quarter"], k)


def split(rows: DataFrame, seed: str, key: str, percent: int) -> DataFrame:
    """`percent` of the rows, by digest, exactly; at least one. The rank comes from counts of digest prefixes, so no task
    sees more than one prefix."""
    drawn = hashed(rows, seed, key).withColumn("prefix", F.substring("draw", 1, 3))
    before = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 prefixes
    counts = drawn.groupBy("prefix").agg(F.count("*").alias("c"))
    starts = counts.withColumns({"start": F.coalesce(F.sum("c").over(before), F.lit(0)), "n": F.sum("c").over(Window.partitionBy(F.lit(1)))})
    nth = F.row_number().over(Window.partitionBy("prefix").orderBy("draw", key))
    cut = F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100))
    placed = drawn.withColumn("in_prefix", nth).join(F.broadcast(starts.drop("c")), "prefix")
    return placed.withColumn("part", F.when(F.col("start") + F.col("in_prefix") <= cut, "first").otherwise("second")).drop("prefix", "in_prefix", "start", "n")
