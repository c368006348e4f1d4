"""Filters, queues and pages over clips and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def every(*conditions: Column | None) -> Column:
    """All conditions that are given."""
    out = F.lit(True)
    for c in conditions:
        out = out if c is None else out & c
    return out


def visible(clips: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Clips that are neither quarantined nor deleted."""
    return clips.join(exclusions.filter(F.col("state").isin("quarantined", "media_deleted")), "clip_id", "left_anti")


def pending(clips: DataFrame, logs: DataFrame, n: int) -> DataFrame:
    """Oldest clips with motion and media that no log speaks of."""
    return clips.filter("has_motion AND media_key IS NOT NULL").join(logs, "clip_id", "left_anti").orderBy("us", "clip_id").limit(n)


def page(rows: DataFrame, time: str, key: str, after: tuple[int, int] | None, n: int) -> DataFrame:
    """Newest first; what comes after a (time, key) cursor. One row more than a page tells that there is another."""
    size = max(1, min(100, n))
    seek = None if after is None else (F.col(time) < after[0]) | ((F.col(time) == after[0]) & (F.col(key) < after[1]))
    return rows.filter(every(seek)).orderBy(F.desc(time), F.desc(key)).limit(size + 1)


def names_of(text: str | None) -> list[str] | None:
    """Names in a text, cut at commas; None without any, so that a blank filter filters nothing."""
    names = [n.strip() for n in (text or "").split(",")]
    return [n for n in names if n] or None


def listed(
    clips: DataFrame,
    *,
    camera_id: int | None = None,
    has_motion: bool | None = None,
    from_us: int | None = None,
    to_us: int | None = None,
    types: list[str] | None = None,
    before_us: int | None = None,
    before_id: int | None = None,
    n: int = 30,
) -> DataFrame:
    """Clips under all filters that are given, both ends of the range inside, newest first (of one time the largest id first) and
    one more than a page. With `before_id` the cursor is a time and an id; a time alone passes over clips of the page's last
    time that the page has not shown."""
    given = [
        None if camera_id is None else F.col("camera_id") == camera_id,
        None if has_motion is None else F.col("has_motion") == has_motion,
        None if from_us is None else F.col("us") >= from_us,
        None if to_us is None else F.col("us") <= to_us,
        None if types is None else F.col("event_type").isin(types),
        None if before_us is None else (F.col("us") < before_us) | ((F.col("us") == before_us) & (F.col("clip_id") < before_id) if before_id is not None else F.lit(False)),
    ]
    return clips.filter(every(*given)).orderBy(F.desc("us"), F.desc("clip_id")).limit(max(1, min(100, n)) + 1)


def logged(clips: DataFrame, logs: DataFrame, has: bool | None, actions: list[str] | None = None) -> DataFrame:
    """has false: clips without a log; true or actions: clips with one (of these actions); neither: all."""
    if has is False:
        return clips.join(logs, "clip_id", "left_anti")
    if has or actions is not None:
        wanted = logs if actions is None else logs.filter(F.col("action").isin(actions) if actions else F.lit(False))
        return clips.join(wanted, "clip_id", "left_semi")
    return clips


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key: the first in order, which must be total."""
    newest = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(newest)).filter("nth = 1").drop("nth")


def latest_seen(rows: DataFrame, key: str, at: str, seen: str) -> DataFrame:
    """The latest row of each key by `at`; of equal ones that which was seen first. An aggregation, so no key's rows are sorted."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, (-F.col(seen)).alias("seen"))).alias("r")).select(key, "r.*")


def prefer(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """One row a key: the first side's value, where it has none the second's."""
    a, b = first.select(key, F.col(value).alias("a")), second.select(key, F.col(value).alias("b"))
    return a.join(b, key, "full").select(key, F.coalesce("a", "b").alias(value), F.when(F.col("a").isNotNull(), "first").otherwise("second").alias("origin"))


def effective_activity(clips: DataFrame, assessments: DataFrame, settings: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Seconds that count. They are 0 only where the camera's setting is on and its switch for the decision too; a camera
    without a setting, and a clip without an assessment under the camera's policy, keep all."""
    s = settings.withColumnRenamed("camera_id", "s_camera")
    a = assessments.withColumnRenamed("clip_id", "a_clip")
    with_setting = clips.join(s, F.col("camera_id") == F.col("s_camera"), "left")
    both = with_setting.join(a, (F.col("clip_id") == F.col("a_clip")) & (F.col("policy_version") == F.col("active_policy")), "left")
    cut = F.coalesce(F.col("enabled"), F.lit(False)) & (
        ((F.col("decision") == "absent") & F.coalesce("exclude_absent", F.lit(False))) | ((F.col("decision") == "static") & F.coalesce("exclude_static", F.lit(False)))
    )
    return both.select(
        "clip_id",
        "camera_id",
        "us",
        "duration_sec",
        F.coalesce("decision", F.lit("pending")).alias("decision"),
        F.when(F.coalesce(cut, F.lit(False)), 0.0).otherwise(F.col("duration_sec")).alias("effective_sec"),
        *(carry or []),
    )


def capped_top(rows: DataFrame, bucket: list[str], cap: int, n: int, *order: Column) -> DataFrame:
    """First n rows in order with at most `cap` of a bucket: the same as walking down and skipping full buckets."""
    nth = F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= cap).orderBy(*order).limit(n)


def claimable(jobs: DataFrame, now_us: int, most_attempts: int, n: int) -> DataFrame:
    """Queued jobs, and leased ones whose lease is over, that may be tried again: the highest priority first, then the oldest."""
    free = (F.col("status") == "queued") | ((F.col("status") == "leased") & (F.col("lease_us") <= now_us))
    return jobs.filter(free & (F.col("attempt") < most_attempts)).orderBy(F.desc("priority"), "created_us", "job_id").limit(n)
