"""Predicates that let clips into queues, samples and reports. Exclusions of any kind are anti joins, never lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import HOUR, day_start_us

#: States of an exclusion that cannot be undone by a label.
TERMINAL = ("quarantined", "media_deleted")


def without_terminal(clips: DataFrame, exclusions: DataFrame) -> DataFrame:
    return clips.join(exclusions.filter(F.col("state").isin(*TERMINAL)), "clip_id", "left_anti")


def labelable(clips: DataFrame, exclusions: DataFrame, short_cameras: list[int], least_sec: float = 50.0) -> DataFrame:
    """Clips without a terminal exclusion; those of some cameras only from a length on."""
    return without_terminal(clips.filter(~F.col("camera_id").isin(short_cameras) | (F.col("duration_sec") >= least_sec)), exclusions)


def production(clips: DataFrame, exclusions: DataFrame, purpose: str, prefix: str) -> DataFrame:
    return without_terminal(clips.filter((F.col("purpose") == purpose) & F.startswith("media_key", F.lit(prefix))), exclusions)


def for_role(clips: DataFrame, exclusions: DataFrame, done: DataFrame, reviewer: int, owner: bool, state: str | None) -> DataFrame:
    """What a reviewer's queue holds: an owner sees clips in a state (all without one), others what they can label and play
    and have not completed. The plans are two, so filters of either reach the scan."""
    if owner:
        return clips if state is None else clips.filter(F.col("review_state") == state)
    mine = done.filter(F.col("reviewer") == reviewer).select("clip_id")
    return without_terminal(clips.filter((F.col("review_state") == "label") & F.col("media_key").isNotNull()), exclusions).join(mine, "clip_id", "left_anti")


def media_status(clips: DataFrame, exclusions: DataFrame) -> DataFrame:
    """clip_id and what a request for its media gets."""
    told = F.when(F.col("state") == "quarantined", "not_found").when(F.col("state") == "media_deleted", "gone").otherwise("ok")
    return clips.select("clip_id").join(exclusions.select("clip_id", "state"), "clip_id", "left").select("clip_id", told.alias("status"))


def valid_seconds(under: Column, seconds: Column) -> Column:
    """Whether a bound is above 0 and all seconds lie in [0, bound); none at all do."""
    return (under > 0) & F.forall(seconds, lambda s: (s >= 0) & (s < under))


def conservative_rule(rule: dict[str, float] | None) -> Column:
    """auto_label where all measures of a feature row keep to the rule; without a rule everything falls back."""
    if rule is None:
        return F.lit("fallback_vlm")
    holds = (F.col("saturation") <= rule["saturation"])
    for name in ("motion_mean", "motion_peak", "active_ratio", "brightness_std"):
        holds = holds & (F.col(name) >= rule[name])
    return F.when(holds, "auto_label").otherwise("fallback_vlm")


def evidence(level0: Column, level1: Column, dwell: Column, least_sec: float, least_seen: int) -> Column:
    """Both levels ok and a dwell long and often enough; a measure that is missing is 0."""
    measure = lambda f: F.coalesce(dwell[f].cast("double"), F.lit(0.0))
    good = F.coalesce(level0 == "ok", F.lit(False)) & F.coalesce(level1 == "ok", F.lit(False)) & dwell.isNotNull()
    return good & (measure("observed_sec") >= least_sec) & (measure("n_seen") >= least_seen)


def formal(clips: DataFrame, t0_us: int, not_before_us: int, excluded: DataFrame, *seen: DataFrame) -> DataFrame:
    """Clips for a blind trial: begun in [not_before, t0), of an activity day that is closed by t0, ready, labelable, and in
    none of the given tables (exclusions, lessons, submissions, consensus, ground truth)."""
    closes = day_start_us(F.col("activity_day")) + 24 * HOUR
    open_ = clips.filter((F.col("us") < t0_us) & (F.col("us") >= not_before_us) & (closes <= t0_us) & F.col("media_key").isNotNull() & F.col("has_motion"))
    known = excluded.select("clip_id")
    for table in seen:
        known = known.unionByName(table.select("clip_id"))
    return open_.join(known.distinct(), "clip_id", "left_anti")


def workload(clips: DataFrame, assessments: DataFrame, prelabels: DataFrame, policy: str, cameras: list[int], least_frames: int) -> DataFrame:
    """Clips of some cameras with a finite length, a key and an assessment under the policy whose prelabel saw enough
    frames; the prelabel's box tells the stratum."""
    seconds = F.col("duration_sec")
    good = clips.filter(F.col("camera_id").isin(cameras) & (seconds > 0) & ~F.isnan(seconds) & (seconds < float("inf")) & F.col("media_key").isNotNull())
    told = assessments.filter(F.col("policy_version") == policy).select("clip_id", "prelabel_id")
    enough = prelabels.filter(F.col("frames") >= least_frames)
    stratum = F.when(F.col("box").isNotNull(), "present").otherwise("absent")
    return good.join(told, "clip_id").join(enough, "prelabel_id").select("clip_id", "camera_id", "frames", stratum.alias("stratum"))


def guard_reasons(clips: DataFrame, protections: dict[str, DataFrame]) -> DataFrame:
    """clip_id and the names of the tables that protect it, in order: one join with the union of all of them, not one a
    table."""
    every = None
    for name, table in protections.items():
        ids = table.select("clip_id").distinct().withColumn("by", F.lit(name))
        every = ids if every is None else every.unionByName(ids)
    by = every.groupBy("clip_id").agg(F.array_sort(F.collect_set("by")).alias("by"))
    return clips.select("clip_id").join(by, "clip_id", "left").select("clip_id", F.col("by").isNotNull().alias("protected"), F.array_join(F.coalesce("by", F.array().cast("array<string>")), ",").alias("by"))
