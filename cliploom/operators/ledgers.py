"""Transactions of queues and reviews as functions from tables to tables: what is inserted, accepted, refused and handed on.

One run is one writer, so a batch decides as a whole; a row's lock becomes a guard in the transition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import backoff


def enqueued(rows: DataFrame, jobs: DataFrame, key: str, *order: str) -> DataFrame:
    """Job rows to insert for new rows: the first of each key that no job has yet."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
    return first.join(jobs.select(key).distinct(), key, "left_anti").withColumns({"status": F.lit("queued"), "attempt": F.lit(0)})


def inserted_or_existing(rows: DataFrame, existing: DataFrame, identity: list[str]) -> DataFrame:
    """One row for each identity that is asked for: the one that exists (`created` false) or the new one."""
    values = [c for c in existing.columns if c not in identity]
    old = existing.select(*identity, F.struct(*values).alias("old"))
    new = rows.groupBy(*identity).agg(F.min(F.struct(*values)).alias("new"))
    told = new.join(old, identity, "left").withColumn("r", F.coalesce("old", "new"))
    return told.select(*identity, "r.*", F.col("old").isNull().alias("created"))


def append_only_violations(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """code and key of rows that a later state of an append-only table has changed or lost; none may be there."""
    values = [c for c in before.columns if c != key]
    mark = lambda df, name: df.select(key, F.xxhash64(*values).alias(name))
    both = mark(before, "a").join(mark(after, "b"), key, "left")
    code = F.when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "updated")
    return both.select(code.alias("code"), key).filter("code IS NOT NULL")


def guarded_updates(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates that saw the row as it is (`expected_us` is its updated_us) are accepted, others conflict; of several for one
    row only the first (by update_id) can be. What has no row is unknown."""
    first = updates.groupBy(key).agg(F.min("update_id").alias("first_id"))
    told = updates.join(first, key).join(current.select(key, "updated_us"), key, "left")
    state = F.when(F.col("updated_us").isNull(), "unknown").when(F.col("expected_us") != F.col("updated_us"), "conflict").when(F.col("update_id") != F.col("first_id"), "conflict").otherwise("accepted")
    return told.select("update_id", key, state.alias("result"))


def claimed(jobs: DataFrame, now_us: int, most_attempts: int, n: int, worker: str, lease_us: int) -> DataFrame:
    """Expired leases go back to the queue, or end at the last attempt; then the first n are leased, the highest
    priority first, then the oldest."""
    over = (F.col("status") == "leased") & (F.col("lease_us") <= now_us)
    back = jobs.withColumn("state", F.when(over & (F.col("attempt") >= most_attempts), "failed").when(over, "queued").otherwise(F.col("status")))
    picked = back.filter((F.col("state") == "queued") & (F.col("attempt") < most_attempts)).orderBy(F.desc("priority"), "created_us", "job_id").limit(n)
    return picked.select("job_id", F.lit("leased").alias("status"), (F.col("attempt") + 1).alias("attempt"), F.lit(worker).alias("worker"), F.lit(now_us + lease_us).alias("lease_us"))


def finished(jobs: DataFrame, outcomes: DataFrame, now_us: int, most_attempts: int) -> DataFrame:
    """Each outcome's effect: only the worker that holds a job's running lease may end it; a failure is retried after a pause
    that doubles, or is final."""
    told = outcomes.join(jobs, "job_id", "left")
    held = (F.col("status") == "leased") & (F.col("owner_id") == F.col("worker_id")) & (F.col("lease_us") > now_us)
    result = (
        F.when(F.col("status").isNull(), "unknown_job")
        .when(~held, "not_owner")
        .when(F.col("ok"), "done")
        .when(F.col("attempt") + 1 >= most_attempts, "failed")
        .otherwise("queued")
    )
    return told.select("job_id", "worker_id", result.alias("result"), F.when(result == "queued", backoff(F.lit(now_us), F.col("attempt"))).alias("next_us"))


def slots(clips: DataFrame, groups: DataFrame, frozen: DataFrame, existing: DataFrame, from_day: Column) -> DataFrame:
    """Review slots to add: two for each clip in the window that has none. A clip belongs to the group of its first consensus
    for good, else to its camera's group now; without a group it gets no slots."""
    window = clips.filter(F.col("activity_day") >= from_day)
    told = window.join(frozen, "clip_id", "left").join(groups, "camera_id", "left").withColumn("group_id", F.coalesce("frozen_group", "camera_group")).filter("group_id IS NOT NULL")
    fresh = told.join(existing.select("clip_id").distinct(), "clip_id", "left_anti")
    return fresh.select("clip_id", "group_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("slot"))


def slot_faults(existing: DataFrame) -> DataFrame:
    """Clips whose number of slots is not two."""
    return existing.groupBy("clip_id").agg(F.count("*").alias("n")).filter("n <> 2")


def submitted(stored: DataFrame, incoming: DataFrame, now_us: int) -> DataFrame:
    """Result of each blind submission, and its peer's id if the peer has handed in. A reviewer hands in a clip once: the same
    digest again is a replay, another one is refused, as is one whose lease is over."""
    own = stored.select("clip_id", "reviewer", F.col("digest").alias("stored"))
    peers = stored.select("clip_id", F.col("reviewer").alias("peer"), F.col("submission_id").alias("peer_id"))
    told = incoming.join(own, ["clip_id", "reviewer"], "left")
    result = F.when(F.col("stored") == F.col("digest"), "replayed").when(F.col("stored").isNotNull(), "conflict").when(F.col("lease_us") <= now_us, "lease_over").otherwise("accepted")
    both = told.join(peers, "clip_id", "left").withColumn("other", F.when(F.col("peer") != F.col("reviewer"), F.col("peer_id")))
    return both.groupBy("clip_id", "reviewer", result.alias("result")).agg(F.min("other").alias("peer_id"))


def finalised(consensus: DataFrame, compared: DataFrame) -> DataFrame:
    """Consensus rows after comparison: only one that waits, with both digests as compared, becomes agreed or conflict, once. An
    agreement carries a decision, a conflict does not."""
    told = consensus.join(compared, "clip_id", "left")
    same = (F.col("a_digest") == F.col("seen_a")) & (F.col("b_digest") == F.col("seen_b"))
    shaped = ((F.col("outcome") == "agreed") & F.col("decision").isNotNull()) | ((F.col("outcome") == "conflict") & F.col("decision").isNull())
    moves = (F.col("status") == "awaiting") & F.coalesce(same & shaped, F.lit(False))
    why = F.when(F.col("outcome").isNull(), "no_comparison").when(F.col("status") != "awaiting", "not_waiting").when(~F.coalesce(same, F.lit(False)), "stale").when(~F.coalesce(shaped, F.lit(False)), "payload").otherwise("moved")
    return told.select("clip_id", F.when(moves, F.col("outcome")).otherwise(F.col("status")).alias("status"), F.when(moves, F.col("decision")).alias("decision"), why.alias("why"))


def resolved(conflicts: DataFrame, choices: DataFrame) -> DataFrame:
    """The owner's choice for conflicts alone: one of the two answers, or a new one that has to be given."""
    told = choices.join(conflicts, "clip_id", "left")
    value = F.when(F.col("choice") == "a", F.col("a_value")).when(F.col("choice") == "b", F.col("b_value")).when(F.col("choice") == "new", F.col("new_value"))
    result = F.when(F.coalesce(F.col("status") != "conflict", F.lit(True)), "not_in_conflict").when(value.isNull(), "no_value").otherwise("owner_resolved")
    return told.select("clip_id", result.alias("result"), F.when(result == "owner_resolved", value).alias("value"))


def stop_reason(one: DataFrame, target: int, most_errors: float, least_volume: int) -> DataFrame:
    """Whether a run that has counted done, errors and waiting goes on: unreliable, complete, out of volume or going."""
    seen = F.col("done") + F.col("errors")
    reason = F.when((seen > 0) & (F.col("errors") > seen * most_errors), "unreliable").when(F.col("done") >= target, "complete").when(F.col("waiting") < least_volume, "out_of_volume").otherwise("going")
    return one.withColumn("reason", reason)


def late_added(slots: DataFrame, visited: DataFrame, closed: Column) -> DataFrame:
    """By owner: slots of days after the one that was visited, up to the last closed day, and those that came late: of a day
    already visited, made after the visit."""
    told = slots.join(visited, "owner_id")
    ahead = (F.col("day") > F.col("priority_day")) & (F.col("day") <= closed)
    late = (F.col("day") <= F.col("priority_day")) & (F.col("created_us") > F.col("visited_us"))
    return told.groupBy("owner_id").agg(F.count_if(ahead).alias("ahead"), F.count_if(late).alias("late"))


def bounded_queue(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The newest rows of a dead-letter queue; older ones beyond the bound are dropped."""
    return rows.orderBy(F.desc(order)).limit(most)
