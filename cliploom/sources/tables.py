"""Parquet tables, and the clip domain derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import activity_day, micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of ten cameras; every seventh has no media key."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("clip_id"),
        (F.col("user_id") % 10).alias("camera_id"),
        F.col("ts").alias("started_at"),
        micros(F.col("ts")).alias("us"),
        activity_day(F.col("ts")).alias("activity_day"),
        F.col("value").alias("duration_sec"),
        (F.col("event_type") != "error").alias("has_motion"),
        F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("clips/cam"), (F.col("user_id") % 10).cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".mp4"))).alias("media_key"),
        "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the clips that were looked into, and why."""
    states = ["quarantined", "media_deleted", "restored", "candidate", "deletion_blocked"]
    state = F.array(*[F.lit(s) for s in states])[(F.col("event_id") % 5).cast("int")]
    code = F.when(F.col("event_id") % 4 == 0, "device_error").when(F.col("event_id") % 4 == 1, "").when(F.col("event_id") % 4 == 2, "duplicate_key")
    return table(spark, sf_dir, "events").filter(F.col("event_type") == "error").select(F.col("event_id").alias("clip_id"), state.alias("state"), code.alias("reason_code"))


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions under two policy versions; clips with a high k have none."""
    k = F.get_json_object("props", "$.k").cast("long")
    return (
        table(spark, sf_dir, "events")
        .filter(k < 70)
        .select(
            F.col("event_id").alias("clip_id"),
            F.when(k < 20, "active").when(k < 45, "static").otherwise("absent").alias("decision"),
            F.when(F.col("event_id") % 2 == 0, "v1").otherwise("v2").alias("policy_version"),
        )
    )


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Switches of a camera; every fifth camera has no row."""
    cam = (F.col("user_id") % 10).alias("camera_id")
    return (
        table(spark, sf_dir, "events")
        .select(cam)
        .distinct()
        .filter(F.col("camera_id") % 5 != 0)
        .select(
            "camera_id",
            (F.col("camera_id") % 2 == 1).alias("enabled"),
            (F.col("camera_id") % 3 == 0).alias("exclude_absent"),
            (F.col("camera_id") % 4 != 2).alias("exclude_static"),
            F.when(F.col("camera_id") < 5, "v1").otherwise("v2").alias("active_policy"),
        )
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth, prediction and confidence of four models."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"),
        F.col("l_orderkey").alias("clip_id"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_suppkey") % 4).alias("model"),
        F.col("l_returnflag").alias("truth"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") < 40), "N").when(F.col("l_quantity") < 25, "A").otherwise("R").alias("pred"),
        (F.col("l_discount") * 10).alias("conf"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job ledger: open, failed and done jobs with priority, attempts and lease."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("owner_id"),
        F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("leased").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        micros(F.col("o_orderdate")).alias("created_us"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempt"),
        F.col("o_totalprice").alias("cost"),
        (micros(F.col("o_orderdate")) + (F.col("o_orderkey") % 30) * F.lit(86_400_000_000)).alias("lease_us"),
    )


#: Measures of a clip, made from its number n as (n * factor % modulus) / divisor.
FEATURES = {
    "brightness_mean": (7, 600, 10),
    "brightness_std": (13, 160, 10),
    "motion_mean": (3, 50, 1000),
    "motion_peak": (17, 200, 1000),
    "motion_std": (19, 80, 1000),
    "active_ratio": (11, 100, 100),
    "late_ratio": (23, 300, 100),
    "center_ratio": (29, 100, 100),
    "saturation": (31, 100, 100),
    "longest_burst": (37, 16, 1),
    "delta": (41, 80, 100),
    "last_motion": (43, 60, 1),
    "baseline": (47, 90, 100),
}


def features(spark: SparkSession, sf_dir: str, missing: bool = True) -> DataFrame:
    """Feature rows of clips; with `missing`, some have no motion mean or no time of the last motion."""
    n = F.col("event_id")
    e = table(spark, sf_dir, "events")
    rows = e.select(
        n.alias("clip_id"),
        F.col("value").alias("duration_sec"),
        (F.col("event_type") != "error").alias("has_motion"),
        F.hour(F.col("ts") + F.expr("INTERVAL 9 HOURS")).alias("hour"),
        "event_type",
        F.when(n % 13 == 0, "pending").when(n % 13 != 1, "ready").alias("status"),
        F.when(n % 11 == 0, "low").when(n % 11 == 2, "medium").when(n % 11 != 1, "high").alias("reliability"),
        F.when(n % 9 != 0, n % 6).alias("bursts"),
        (n % 3).alias("window_10m"),
        F.when(n % 8 != 0, n % 5).alias("window_30m"),
        *[((n * a % m).cast("double") / d).alias(name) for name, (a, m, d) in FEATURES.items()],
    )
    if not missing:
        return rows
    return rows.withColumns({"motion_mean": F.when(F.col("clip_id") % 17 != 0, F.col("motion_mean")), "last_motion": F.when(F.col("clip_id") % 10 != 0, F.col("last_motion"))})
