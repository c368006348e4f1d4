"""State machines of jobs, clips and reviews, as functions from a snapshot to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import backoff


def reclaimed(jobs: DataFrame, now_us: int, most_attempts: int) -> DataFrame:
    """Leased jobs whose lease is over are retried after a pause that doubles, or fail for good at the last attempt."""
    over = (F.col("status") == "leased") & (F.col("lease_us") <= now_us)
    spent = F.col("attempt") + 1 >= most_attempts
    return jobs.withColumns(
        {
            "next_status": F.when(over & spent, "failed").when(over, "queued").otherwise(F.col("status")),
            "next_attempt": F.when(over, F.col("attempt") + 1).otherwise(F.col("attempt")),
            "next_us": F.when(over & ~spent, backoff(F.lit(now_us), F.col("attempt"))),
        }
    )


#: What a camera without a policy goes by.
CANDIDATE_UNDER, RULE_VERSION, RETENTION_HOURS = 15.0, "short-device-error-v1", 168
#: States that a new detection leaves as they are, and what it answers then.
SETTLED = {"restored": "reused_restored", "media_deleted": "reused", "quarantined": "reused", "deletion_blocked": "reused"}


def short_clip_detection(clips: DataFrame, policies: DataFrame, exclusions: DataFrame, protected: DataFrame, now_us: int, write: Column) -> DataFrame:
    """What a detection run does with each clip: clip_id, route, state (after it), and, where a state is written, event, before
    and after, rule_version, displayed (seconds) and delete_after_us.

    A clip shorter than its camera's bound is a candidate; if the camera's policy is on and names the seconds that the clip
    displays, it is quarantined, or blocked from deletion if people have worked on it. What was restored is never taken again,
    and what is settled stays (no event). Without `write` the answer is what a clip ought to be, whatever it is now. Repeated
    rows of a camera's policy or a clip's exclusion are an error of the input; the first by content counts.

    clips: clip_id, camera_id, duration_sec; policies: camera_id, enabled, under_sec, version, hours, seconds (array);
    exclusions: clip_id, state; protected: clip_id."""
    policy = policies.groupBy("camera_id").agg(F.min(F.struct("enabled", "under_sec", "version", "hours", "seconds")).alias("p"))
    now = exclusions.groupBy("clip_id").agg(F.min("state").alias("state"))
    told = (
        clips.select("clip_id", "camera_id", "duration_sec", write.alias("write"))
        .join(policy, "camera_id", "left")
        .join(now, "clip_id", "left")
        .join(protected.select("clip_id", F.lit(True).alias("kept")).distinct(), "clip_id", "left")
        .withColumn("displayed", F.floor(F.col("duration_sec") + 0.5).cast("int"))
    )
    short = F.coalesce(F.col("duration_sec") < F.coalesce("p.under_sec", F.lit(CANDIDATE_UNDER)), F.lit(False))
    match = F.coalesce(F.col("p.enabled") & F.array_contains("p.seconds", F.col("displayed")), F.lit(False))
    target = F.when(match & F.col("kept").isNotNull(), "protected").when(match, "quarantined").otherwise("candidate")
    state_of = lambda t: F.when(t == "protected", "deletion_blocked").otherwise(t)
    settled = F.create_map(*[F.lit(x) for kv in SETTLED.items() for x in kv])[F.col("state")]
    stays = F.col("write") & (settled.isNotNull() | ((F.col("target") == "candidate") & F.col("state").isNotNull()))
    route = F.when(~F.col("short"), "ineligible").when(~F.col("write"), F.col("target")).when(settled.isNotNull(), settled).when(stays, "reused").otherwise(F.col("target"))
    after = F.when(~F.col("short"), "none").when(stays, F.when(settled.isNotNull(), F.col("state")).otherwise("candidate")).otherwise(state_of(F.col("target")))
    moves = F.col("short") & F.col("write") & ~stays
    event = F.when(F.col("target") == "quarantined", "auto_quarantined").when(F.col("target") == "protected", "delete_blocked").otherwise("candidate_detected")
    out = told.withColumns({"short": short, "target": target}).withColumns({"route": route, "after_": after, "moves": moves})
    only = lambda c: F.when(F.col("moves"), c)
    hours = F.coalesce("p.hours", F.lit(RETENTION_HOURS)).cast("long")
    return out.select(
        "clip_id",
        "route",
        F.col("after_").alias("state"),
        only(event).alias("event"),
        only(F.when(F.col("state").isNotNull(), "candidate").otherwise("none")).alias("before"),
        only(F.col("after_")).alias("after"),
        only(F.coalesce("p.version", F.lit(RULE_VERSION))).alias("rule_version"),
        only(F.col("displayed")).alias("displayed"),
        F.when(F.col("moves") & (F.col("target") == "quarantined"), F.lit(now_us) + hours * F.lit(3_600_000_000)).alias("delete_after_us"),
    )


def detection_events(detected: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events with before and after of the detections that moved a state; a clip whose same move is in the ledger (a run that is
    made again) writes none."""
    moved = detected.filter("event IS NOT NULL").select("clip_id", "event", "before", "after", "rule_version", "displayed")
    return moved.join(ledger.select("clip_id", "event").distinct(), ["clip_id", "event"], "left_anti")


def folded(events: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """State after the last event of each key, and how many there were."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("state"), F.count("*").alias("n_events"))


def first_time(rows: DataFrame, ledger: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key that the ledger does not have yet: a claim that succeeds once."""
    kept = rows.join(ledger.select(key).distinct(), key, "left_anti")
    rest = [c for c in rows.columns if c != key]
    return kept.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def admitted(jobs: DataFrame, budget: float, by: str) -> DataFrame:
    """Spent and reserved cost of each `by`, and whether one more of the mean cost would fit. Sums are of decimals."""
    cost = F.col("cost").cast("decimal(18,2)")
    out = jobs.groupBy(by).agg(
        F.coalesce(F.sum(F.when(F.col("status") == "done", cost)), F.lit(0)).cast("double").alias("spent"),
        F.coalesce(F.sum(F.when(F.col("status").isin("queued", "leased"), cost)), F.lit(0)).cast("double").alias("reserved"),
        F.max(cost).cast("double").alias("largest"),
    )
    return out.withColumn("fits", F.col("spent") + F.col("reserved") + F.col("largest") <= budget)


#: States of an exclusion that is in force.
ACTIVE = ("candidate", "quarantined", "media_deleted", "deletion_blocked")


def merge_exclusions(existing: DataFrame, categories: dict[str, DataFrame]) -> DataFrame:
    """Exclusions after clips of some categories (which must not share a clip) are taken out: one in force stays as it is, any
    other, and a clip without one, becomes deleted for the category's reason."""
    new = None
    for name, ids in categories.items():
        one = ids.select("clip_id").distinct().withColumn("new_reason", F.lit(name))
        new = one if new is None else new.unionByName(one)
    shared = F.assert_true(F.count("*") == 1, F.lit("a clip is in two categories"))
    checked = new.groupBy("clip_id").agg(F.max("new_reason").alias("new_reason"), shared.alias("ok")).filter("ok IS NULL").drop("ok")
    both = existing.join(checked, "clip_id", "full")
    stays = F.col("new_reason").isNull() | F.coalesce(F.col("state").isin(*ACTIVE), F.lit(False))
    return both.select("clip_id", F.when(stays, F.col("state")).otherwise("media_deleted").alias("state"), F.when(stays, F.col("reason")).otherwise(F.col("new_reason")).alias("reason"))
