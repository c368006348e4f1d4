"""Joins that look rows up: the best row of a key, the listing of a library, pairs of sources, qualifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row a key, the largest by `order` (which must be total): an aggregation, so a key's rows are never sorted."""
    rest = [c for c in rows.columns if c != key]
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), ranked).alias("r")).select(key, "r.*")


def canary_of(consensus: DataFrame) -> DataFrame:
    """The canary consensus that counts for a clip: of an open cohort first, then the newest."""
    rows = consensus.filter("kind = 'canary'")
    return best(rows, "clip_id", F.col("cohort_open").cast("int"), F.col("created_us"), F.col("id"))


def legacy_of(sessions: DataFrame, owner: int) -> DataFrame:
    """The old session that counts for a clip: the owner's first, then the newest; its current answer, else its first."""
    rows = sessions.filter("initial_gt IS NOT NULL").withColumn("gt", F.coalesce("current_gt", "initial_gt"))
    return best(rows, "clip_id", (F.col("reviewer") == owner).cast("int"), F.col("updated_us"), F.col("id")).select("clip_id", "reviewer", "gt")


#: States of a consensus, and the comparator of a decision that the owner took alone.
FINAL, OPEN, ALONE = ("agreed", "owner_resolved"), ("awaiting", "conflict"), "owner-single-adopt-v1"


def listed(clips: DataFrame, consensus: DataFrame, sessions: DataFrame, owner: int) -> DataFrame:
    """clips with public_state, public_source, public_decision and public_gt. A canary consensus beats a live one, which
    beats an old session; a consensus that is open hides decision and answer."""
    of = lambda rows, p: rows.select("clip_id", *[F.col(c).alias(f"{p}_{c}") for c in ("status", "version", "decision", "gt")])
    old = legacy_of(sessions, owner).select("clip_id", F.col("reviewer").alias("old_reviewer"), F.col("gt").alias("old_gt"))
    base = clips.join(of(consensus.filter("kind = 'live'"), "live"), "clip_id", "left").join(of(canary_of(consensus), "canary"), "clip_id", "left").join(old, "clip_id", "left")
    canary, live = F.col("canary_status"), F.col("live_status")
    state = (
        F.when(canary.isin(*FINAL), "final")
        .when(canary.isin(*OPEN), "re_review")
        .when(live.isin(*FINAL), "final")
        .when(live == "conflict", "owner_review")
        .when(live == "awaiting", "awaiting")
        .when(F.col("old_gt").isNotNull(), "final")
        .otherwise("unlabeled")
    )
    source = (
        F.when(canary.isNotNull() & (F.col("canary_version") == ALONE), "owner_single_adopt")
        .when(canary.isNotNull(), "blind_consensus")
        .when(live.isNotNull() & (F.col("live_version") == ALONE), "owner_single_adopt")
        .when(live.isNotNull(), "blind_consensus")
        .when(F.col("old_gt").isNotNull() & (F.col("old_reviewer") == owner), "owner_legacy")
        .when(F.col("old_gt").isNotNull(), "single_legacy")
        .otherwise("none")
    )
    told = lambda field, old: F.when(canary.isin(*FINAL), F.col(f"canary_{field}")).when(canary.isNotNull(), None).when(live.isin(*FINAL), F.col(f"live_{field}")).when(live.isNotNull(), None).otherwise(old)
    return base.select(
        *clips.columns,
        state.alias("public_state"),
        source.alias("public_source"),
        told("decision", F.when(F.col("old_gt").isNotNull(), "label")).alias("public_decision"),
        told("gt", F.col("old_gt")).alias("public_gt"),
    )


def paged_then_joined(rows: DataFrame, clips: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows, and of these the ones that have a clip: a page may be short."""
    return rows.orderBy(*order).limit(n).join(clips, "clip_id")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and has no parent."""
    return rows.filter(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def two_sources(log: DataFrame, key: str, source: str, value: str, first: str, second: str, *order: Column) -> DataFrame:
    """A row for each key that the first source knows: its latest value of either source; the second's may be missing."""
    ranked = F.struct(*order)
    latest = lambda s: F.max_by(F.when(F.col(source) == s, F.col(value)), F.when(F.col(source) == s, ranked))
    return log.groupBy(key).agg(latest(first).alias(first), latest(second).alias(second)).filter(F.col(first).isNotNull())


def compared(truth: DataFrame, base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """truth's rows that the baseline has, and what became of them; a row that the new side lacks is missing."""
    rows = truth.join(base, key).join(new, key, "left")
    t, b, n = F.col("truth"), F.col("base"), F.col("new")
    change = (
        F.when(n.isNull(), "missing")
        .when((b == t) & (n == t), "held")
        .when((b != t) & (n == t), "recovered")
        .when((b == t) & (n != t), "broken")
        .when(b == n, "wrong_same")
        .otherwise("wrong_changed")
    )
    return rows.withColumn("change", change)


def qualified(reviewers: DataFrame, approvals: DataFrame, members: DataFrame, lessons: DataFrame, run: int, needed: int) -> DataFrame:
    """Labelers who are approved, active members and have completed that many different lessons of a run."""
    done = lessons.filter(F.col("run") == run).groupBy("reviewer").agg(F.countDistinct("lesson").alias("n")).filter(F.col("n") == needed)
    return reviewers.filter("role = 'labeler'").join(approvals, "reviewer", "left_semi").join(members.filter("active"), "reviewer", "left_semi").join(done, "reviewer", "left_semi")


def first_truth(predicted: DataFrame, human: DataFrame, store: DataFrame, clips: DataFrame, label: str, truth: str) -> DataFrame:
    """Clips that are predicted `label` though they are `truth`: the truth comes from the human log, else from the label store
    (the first that says anything), and tells which."""
    wanted = predicted.filter(F.col("action") == label).select("clip_id").distinct()
    blank = lambda c: F.nullif(c, F.lit(""))
    rows = wanted.join(clips.filter(F.col("media_key").isNotNull()).select("clip_id"), "clip_id").join(human.select("clip_id", F.col("action").alias("h")), "clip_id", "left").join(store.select("clip_id", F.col("action").alias("s")), "clip_id", "left")
    told = rows.select("clip_id", F.coalesce(blank(F.col("h")), blank(F.col("s"))).alias("truth"), F.when(blank(F.col("h")).isNotNull(), "log").when(blank(F.col("s")).isNotNull(), "store").alias("origin"))
    return told.filter(F.col("truth") == truth)
