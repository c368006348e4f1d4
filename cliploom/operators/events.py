"""Accounting of clips, and grouping of neighbouring clips into events, pairs and chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..functions.times import gap_bin

#: One camera and activity day is a run's scope, so a window never holds more than a day of one camera.
SCOPE = ("camera_id", "activity_day")


def _end(row: str = "") -> Column:
    return F.col("us") + (F.col("duration_sec") * 1_000_000).cast("long")


#: States of an exclusion that take a clip out of activity.
ACTIVE_STATES = ("candidate", "quarantined", "media_deleted", "deletion_blocked")


def account(clips: DataFrame, exclusions: DataFrame, blocked: Column | None = None) -> DataFrame:
    """Exactly one kind and reason for each clip: blocked beats an active exclusion, which beats a bad duration. A clip that
    counts has no reason."""
    states = exclusions.filter(F.col("state").isin(*ACTIVE_STATES))
    bad = F.col("duration_sec").isNull() | F.isnan("duration_sec") | (F.col("duration_sec") <= 0)
    stop = F.lit(False) if blocked is None else blocked
    return clips.join(states, "clip_id", "left").withColumns(
        {
            "kind": F.when(stop, "blocked").when(F.col("state").isNotNull() | bad, "diagnostic").otherwise("candidate"),
            "reason": F.when(stop, "formal_or_frozen_manifest")
            .when(F.col("state").isNotNull(), F.concat_ws(":", F.coalesce(F.nullif(F.col("reason_code"), F.lit("")), F.lit("unknown")), F.col("state")))
            .when(bad, "invalid_duration"),
        }
    )


def _in_order():
    return Window.partitionBy(*SCOPE).orderBy("us", "clip_id")


def with_previous(accounted: DataFrame) -> DataFrame:
    """Each row with the row before it in its camera's day, whatever that one's kind, and the gap from that one's end."""
    before = F.lag(F.struct("clip_id", "kind", _end().alias("end_us"))).over(_in_order())
    return accounted.withColumn("prev", before).withColumn("gap_us", F.col("us") - F.col("prev.end_us"))


def numbered_events(accounted: DataFrame, threshold_sec: float) -> DataFrame:
    """Candidates with the number of their event. A gap up to the threshold continues an event, measured from the end of
    the row directly before; any other row between two candidates ends it."""
    goes_on = (F.col("prev.kind") == "candidate") & (F.col("gap_us") <= int(threshold_sec * 1_000_000))
    starts = F.when((F.col("kind") == "candidate") & ~F.coalesce(goes_on, F.lit(False)), 1).otherwise(0)
    running = _in_order().rowsBetween(Window.unboundedPreceding, 0)
    return with_previous(accounted).withColumn("event_no", F.sum(starts).over(running)).filter(F.col("kind") == "candidate")


def events(accounted: DataFrame, threshold_sec: float) -> DataFrame:
    """One row an event, with an identifier from its members in order."""
    members = F.array_sort(F.collect_list(F.struct("us", "clip_id")))
    ids = F.array_join(F.transform(members, lambda m: m["clip_id"].cast("string")), "\0")
    grouped = numbered_events(accounted, threshold_sec).groupBy(*SCOPE, "event_no").agg(
        F.count("*").alias("n_clips"), F.min("us").alias("started_us"), F.max(_end()).alias("ended_us"), ids.alias("members")
    )
    return grouped.withColumn("event_id", digest("events-v1", F.col("camera_id"), F.col("activity_day"), F.col("members"), separator="\0"))


def adjacent_pairs(accounted: DataFrame, most_sec: float = 300.0) -> DataFrame:
    """Consecutive candidates of a night with a gap up to most_sec; overlaps (negative gaps) count."""
    gap = F.col("gap_us") / 1_000_000
    return (
        with_previous(accounted)
        .filter((F.col("kind") == "candidate") & (F.col("prev.kind") == "candidate") & (F.col("gap_us") <= int(most_sec * 1_000_000)))
        .select(
            *SCOPE,
            F.col("prev.clip_id").alias("left_clip"),
            F.col("clip_id").alias("right_clip"),
            F.col("us").alias("right_us"),
            "gap_us",
            gap_bin(gap).alias("gap_bin"),
            digest("pair-v1", F.col("prev.clip_id"), F.col("clip_id")).alias("pair_id"),
        )
    )


def chains(pairs: DataFrame) -> DataFrame:
    """Longest chains of pairs that share a clip; a negative gap ends a chain and its pair is dropped."""
    usable = pairs.filter(F.col("gap_us") >= 0)
    order = Window.partitionBy(*SCOPE).orderBy("right_us", "right_clip")
    starts = F.when(F.lag("right_clip").over(order).eqNullSafe(F.col("left_clip")), 0).otherwise(1)
    return (
        usable.withColumn("starts", starts)
        .withColumn("chain_no", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*SCOPE, "chain_no")
        .agg(F.count("*").alias("n_pairs"), F.min("gap_us").alias("least_gap_us"), F.max("gap_us").alias("most_gap_us"))
    )


def threshold_sweep(judged: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold, pairs judged different that it would merge and pairs judged same that it would split; `chosen`
    marks the threshold that merges none and splits least (of several, the smallest).

    A pair is counted at the first threshold that merges it, and the few counts are then spread over the thresholds."""
    at = sorted(thresholds)
    first = F.lit(len(at))
    for i in range(len(at) - 1, -1, -1):
        first = F.when(F.col("gap_sec") <= at[i], i).otherwise(first)
    cells = judged.filter(F.col("decision") != "uncertain").groupBy(first.alias("first")).agg(
        F.count_if(F.col("decision") == "different").alias("different"), F.count_if(F.col("decision") == "same").alias("same")
    )
    spread = cells.withColumn("t", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(at)])))
    merges = F.col("first") <= F.col("t.i")
    out = spread.groupBy("t.threshold").agg(
        F.sum(F.when(merges, F.col("different")).otherwise(0)).alias("over_merge"),
        F.sum("different").alias("n_different"),
        F.sum(F.when(merges, 0).otherwise(F.col("same"))).alias("over_split"),
        F.sum("same").alias("n_same"),
    )
    best = out.filter("over_merge = 0").agg(F.min_by("threshold", F.struct("over_split", "threshold")).alias("best"))
    return out.crossJoin(F.broadcast(best)).withColumn("chosen", F.coalesce(F.col("threshold") == F.col("best"), F.lit(False))).drop("best")  # one row


def accounting_issues(source: DataFrame, accounted: DataFrame, members: DataFrame) -> DataFrame:
    """code and how many clips break it; all must be 0. `members`: event_id, camera_id, activity_day, clip_id of events.

    A clip is reduced to one row of counts of its three tables, so no table is joined with another one."""
    none = F.lit(None)
    row = lambda df, n, kind, camera, day: df.select("clip_id", F.lit(n).alias("t"), kind.cast("string").alias("kind"), camera.cast("long").alias("camera"), day.cast("date").alias("day"))
    every = (
        row(source, 0, none, none, none)
        .unionByName(row(accounted, 1, F.col("kind"), F.col("camera_id"), F.col("activity_day")))
        .unionByName(row(members, 2, none, F.col("camera_id"), F.col("activity_day")))
    )
    of = lambda n, c: F.max(F.when(F.col("t") == n, F.col(c)))
    clip = every.groupBy("clip_id").agg(
        *[F.count_if(F.col("t") == n).alias(name) for n, name in enumerate(("in_source", "in_accounts", "in_events"))],
        of(1, "kind").alias("kind"),
        ((of(1, "camera") != of(2, "camera")) | (of(1, "day") != of(2, "day"))).alias("crosses"),
    )
    candidate = F.coalesce(F.col("kind") == "candidate", F.lit(False))
    checks = {
        "duplicate": (F.col("in_source") > 1) | (F.col("in_accounts") > 1),
        "source_mismatch": (F.col("in_source") > 0) != (F.col("in_accounts") > 0),
        "protected_in_event": (F.col("in_events") > 0) & ~candidate,
        "crosses_camera_or_day": F.coalesce(F.col("crosses"), F.lit(False)),
        "event_coverage": candidate & (F.col("in_events") != 1),
    }
    counts = clip.agg(F.array(*[F.struct(F.lit(code).alias("code"), F.count_if(bad).alias("n")) for code, bad in checks.items()]).alias("c"))
    return counts.select(F.explode("c").alias("c")).select("c.*")
