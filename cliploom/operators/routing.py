"""Rules that route a clip: ordered, the first that holds decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import ratio
from .sampling import ranks


def decide(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    out = None
    for name, holds in rules:
        out = F.when(holds, F.lit(name)) if out is None else out.when(holds, F.lit(name))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def routed(rules: list[tuple[Column, str, float, str, str | Column]], otherwise: tuple[str, float, str, str]) -> Column:
    """route, priority, risk and reason of the first rule that holds."""
    told = lambda route, priority, risk, reason: F.struct(
        F.lit(route).alias("route"), F.lit(priority).alias("priority"), F.lit(risk).alias("risk"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")
    )
    out = None
    for holds, *result in rules:
        out = F.when(holds, told(*result)) if out is None else out.when(holds, told(*result))
    return told(*otherwise) if out is None else out.otherwise(told(*otherwise))


# Fixed values below: thresholds, priorities and names of the routing rules. Columns are those of a feature row.


def first_route() -> Column:
    """Router without context, first version."""
    mean, peak, active = F.col("motion_mean"), F.col("motion_peak"), F.col("active_ratio")
    return routed(
        [
            ((F.col("brightness_mean") < 18.0) | (F.col("brightness_std") < 2.0), "review_candidate", 0.74, "medium", "poor_visibility_requires_review"),
            ((mean >= 0.026) | (peak >= 0.120) | (F.col("motion_std") >= 0.035) | (F.col("late_ratio") >= 1.8), "cloud_now", 0.86, "high", "high_or_bursty_motion_could_hide_p0_behavior"),
            ((peak < 0.018) & (active < 0.12), "activity_only", 0.18, "low", "very_static_low_motion_clip"),
            ((mean < 0.010) & (active < 0.25), "cloud_later", 0.42, "medium", "low_activity_but_not_safe_to_drop"),
        ],
        ("cloud_later", 0.58, "medium", "moderate_motion_batchable"),
    )


def second_route() -> Column:
    """Router without context, second version: only what is seen well and hardly moves is left out."""
    mean, peak, active = F.col("motion_mean"), F.col("motion_peak"), F.col("active_ratio")
    static = (mean < 0.003) & (peak < 0.010) & (active < 0.05) & (F.col("brightness_mean") >= 35.0) & (F.col("brightness_std") >= 4.0)
    return routed(
        [
            ((F.col("brightness_mean") < 18.0) | (F.col("brightness_std") < 2.0), "review_candidate", 0.74, "medium", "poor_visibility_requires_review"),
            (static, "activity_only", 0.16, "low", "extreme_static_visible_clip"),
            ((mean >= 0.030) | (peak >= 0.140) | (F.col("motion_std") >= 0.050) | (F.col("late_ratio") >= 2.2), "cloud_now", 0.88, "high", "high_or_bursty_motion_could_hide_p0_behavior"),
            ((mean < 0.014) & (active < 0.35), "cloud_later", 0.38, "medium", "low_motion_batchable_not_droppable"),
        ],
        ("cloud_later", 0.56, "medium", "moderate_motion_batchable"),
    )


def derived_evidence() -> dict[str, Column]:
    """What the third router derives: night, distance from the camera's baseline, bursts, span and reliability."""
    active, seconds = F.col("active_ratio"), F.col("duration_sec")
    bursts = F.when(active < 0.03, 0).otherwise(F.greatest(F.lit(1), F.bround(active * 4).cast("int")))
    dark = (F.col("brightness_mean") < 25.0) | (F.col("brightness_std") < 3.0)
    return {
        "night": (F.col("hour") >= 20) | (F.col("hour") < 6),
        "above_baseline": F.greatest(F.lit(0.0), active - F.col("baseline")),
        "bursts_told": bursts,
        "longest_sec": F.least(seconds, seconds * active),
        "first_sec": F.when(bursts > 0, 0.0),
        "last_sec": F.when(bursts > 0, seconds * F.least(F.lit(1.0), F.col("late_ratio"))),
        "reliability_told": F.when(dark, "low").when(F.col("brightness_std") >= 8.0, "high").otherwise("medium"),
    }


def third_route() -> Column:
    """Router on derived evidence (see derived_evidence)."""
    mean, peak, active = F.col("motion_mean"), F.col("motion_peak"), F.col("active_ratio")
    high = (mean >= 0.030) | (peak >= 0.140) | (F.col("above_baseline") >= 0.45)
    sparse = (F.col("window_10m") <= 0) | ((active < 0.06) & (F.col("late_ratio") >= 2.0))
    static = (mean < 0.003) & (peak < 0.010) & (active < 0.03) & (F.col("reliability_told") == "high") & (F.col("window_30m") <= 1)
    return routed(
        [
            ((F.col("reliability_told") == "low") | high, "cloud_now", 0.88, "high", "v2_high_or_unreliable_evidence"),
            (sparse, "review_candidate", 0.72, "medium", "v2_conflicting_sparse_evidence"),
            (static, "activity_only", 0.18, "low", "v2_extreme_static_reliable_clip"),
        ],
        ("cloud_later", 0.52, "medium", "v2_batchable_contextual_activity"),
    )


def operational_route() -> Column:
    """Router on stored features. What is not known decides nothing: a missing number of bursts is no strong sign."""
    mean, peak, active, bursts = F.col("motion_mean"), F.col("motion_peak"), F.col("active_ratio"), F.col("bursts")
    holds = lambda c: F.coalesce(c, F.lit(False))
    missing = mean.isNull() | peak.isNull() | active.isNull() | holds(F.col("reliability") == "low")
    long_burst = (F.col("duration_sec") != 0) & (F.col("longest_burst") >= F.least(F.lit(12.0), F.col("duration_sec") * 0.25))
    strong = holds(mean >= 0.035) | holds(peak >= 0.140) | holds(F.col("motion_std") >= 0.045) | holds(active >= 0.65) | holds(F.col("delta") >= 0.35) | holds(bursts >= 4) | holds(long_burst)
    few = lambda c, n: c.isNull() | (c <= n)
    static = holds(~F.col("has_motion")) | (
        (mean < 0.002) & (peak < 0.010) & (active < 0.02) & few(bursts, 1) & few(F.col("window_30m"), 2) & (F.col("reliability").isNull() | F.col("reliability").isin("medium", "high"))
    )
    status = F.coalesce(F.col("status"), F.lit(""))
    return routed(
        [
            (status != "ready", "review_candidate", 0.90, "high", F.concat(F.lit("feature_not_ready:"), F.coalesce(F.nullif(status, F.lit("")), F.lit("missing")))),
            (missing, "review_candidate", 0.78, "medium", "feature_not_ready:missing_or_low_reliability"),
            (strong, "cloud_now", 0.88, "high", "strong_activity_or_burst"),
            (static, "activity_only", 0.18, "low", "extreme_static_reliable"),
            ((mean < 0.012) & (peak < 0.045) & (active < 0.20) & few(bursts, 2), "cloud_later", 0.42, "medium", "low_activity_batchable"),
        ],
        ("cloud_later", 0.58, "medium", "moderate_activity_batchable"),
    )


def guarded(baseline: Column) -> Column:
    """route and reason after the care guard's two patches of a baseline route."""
    peak, active = F.col("motion_peak"), F.col("active_ratio")
    off_centre = (baseline == "cloud_now") & (F.col("center_ratio") < 0.55) & (active < 0.95) & (F.col("last_motion").isNull() | (F.col("last_motion") < 56.0))
    late = (baseline == "cloud_later") & (F.col("late_ratio") >= 1.8) & (peak >= 0.08) & (active >= 0.15)
    told = lambda route, reason: F.struct(route.alias("route"), F.lit(reason).alias("reason"))
    return F.when(off_centre, told(F.lit("cloud_later"), "off_center_motion_batchable")).when(late, told(F.lit("review_candidate"), "late_low_motion_care_sentinel")).otherwise(told(baseline, "unchanged"))


def enriched(features: DataFrame) -> DataFrame:
    """Feature rows with the operational route, the guard's route, and the priority and risk of the latter."""
    out = features.withColumn("b", operational_route()).withColumn("g", guarded(F.col("b.route")))
    ranks = [
        (F.col("g.reason") == "off_center_motion_batchable", 0.42, "medium"),
        (F.col("g.reason") == "late_low_motion_care_sentinel", 0.74, "medium"),
        (F.col("g.route") == "cloud_now", 0.88, "high"),
        (F.col("g.route") == "review_candidate", 0.78, "medium"),
        (F.col("g.route") == "activity_only", 0.18, "low"),
    ]
    rank = None
    for holds, priority, risk in ranks:
        told = F.struct(F.lit(priority).alias("priority"), F.lit(risk).alias("risk"))
        rank = F.when(holds, told) if rank is None else rank.when(holds, told)
    rank = rank.otherwise(F.struct(F.lit(0.58).alias("priority"), F.lit("medium").alias("risk")))
    return out.withColumn("r", rank).select(
        *features.columns,
        F.col("b.route").alias("baseline_route"),
        F.col("b.reason").alias("baseline_reason"),
        F.col("g.route").alias("candidate_route"),
        F.col("g.reason").alias("candidate_reason"),
        "r.priority",
        "r.risk",
    )


def route_rates(routes: DataFrame) -> DataFrame:
    """kind (route, risk or reason), value, how many, and their share."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("route", "risk", "reason")])
    counts = routes.groupBy("route", "risk", "reason").agg(F.count("*").alias("c")).withColumn("k", F.explode(kinds)).groupBy("k.kind", "k.value").agg(F.sum("c").alias("n"))
    whole = counts.filter("kind = 'route'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select("kind", "value", "n", ratio(F.col("n"), F.col("whole")).alias("share"))  # one row


def guard_summary(rows: DataFrame, care: list[str]) -> DataFrame:
    """One row from rows of clip_id, gt, baseline_route and candidate_route: what the guard changed for moving clips and
    for those of the care classes, and how many of the latter it lowered (`lowered` lists them)."""
    cells = rows.groupBy("gt", "baseline_route", "candidate_route").agg(F.count("*").alias("n"))
    cared = F.col("gt").isin(care)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    one = cells.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        total((F.col("gt") == "moving") & (F.col("baseline_route") == "cloud_now")).alias("moving_before"),
        total((F.col("gt") == "moving") & (F.col("candidate_route") == "cloud_now")).alias("moving_after"),
        total(cared & F.col("candidate_route").isin("cloud_now", "review_candidate")).alias("care_kept"),
        total(cared).alias("care_total"),
        total(cared & (F.col("candidate_route") == "activity_only")).alias("care_activity_only"),
        total(cared & (F.col("baseline_route") == "cloud_now") & (F.col("candidate_route") == "cloud_later")).alias("care_lowered"),
    )
    return one.withColumns({"reduction_rate": ratio(F.col("moving_before") - F.col("moving_after"), F.col("moving_before")), "care_recall": ratio(F.col("care_kept"), F.col("care_total"))})


def lowered(rows: DataFrame, care: list[str]) -> DataFrame:
    """clip_id, gt and place (nth of its class, by clip_id) of clips of the care classes that the guard moved from now to later."""
    down = rows.filter(F.col("gt").isin(care) & (F.col("baseline_route") == "cloud_now") & (F.col("candidate_route") == "cloud_later"))
    # Few by nature: a guard that lowers many care clips is none. Ranks come from slices all the same.
    return ranks(down.select("clip_id", "gt"), ["gt"], "clip_id", "clip_id").select("clip_id", "gt", (F.col("rank") + 1).alias("nth"))


def inspection_summary(rows: DataFrame, inspect: Column, known: Column) -> DataFrame:
    """One row: calls before and after the guard where nothing is to be inspected and the share saved, rows to inspect and those
    of them in the cheap lanes, and whether all known regressions still go to a call or a review."""
    told = rows.select("baseline_route", "candidate_route", inspect.alias("inspect"), known.alias("known"))
    after = F.col("candidate_route")
    one = told.agg(
        F.count("*").alias("n"),
        F.count_if(~F.col("inspect") & (F.col("baseline_route") == "cloud_now")).alias("before"),
        F.count_if(~F.col("inspect") & (after == "cloud_now")).alias("after"),
        F.count_if("inspect").alias("n_inspect"),
        F.count_if(F.col("inspect") & (after == "activity_only")).alias("inspect_activity_only"),
        F.count_if(F.col("inspect") & (after == "cloud_later")).alias("inspect_low"),
        F.count_if(F.col("known") & ~after.isin("cloud_now", "review_candidate")).alias("n_regressed"),
    )
    return one.withColumns({"reduction_rate": ratio(F.col("before") - F.col("after"), F.col("before")), "regression_pass": F.col("n_regressed") == 0})


def leakage(rows: DataFrame, priority_classes: list[str]) -> DataFrame:
    """Clips of each class and route, and whether a priority class went to a cheap lane there."""
    leaks = F.col("gt").isin(priority_classes) & F.col("route").isin("activity_only", "cloud_later")
    return rows.groupBy("gt", "route").agg(F.count("*").alias("n")).withColumn("leaks", leaks)


def best_rule(rows: DataFrame, means: list[float], peaks: list[float], seconds: list[float], most_false: float) -> DataFrame:
    """Of all rules (mean, peak and seconds each at least a threshold), the one that decides most rows with a false rate of
    at most `most_false`; then the lowest false rate, then the first in the order of the lists.

    Rows are first counted by how many thresholds of each list they reach, so rules meet at most a few hundred counts,
    not rows."""
    reached = lambda name, at: sum(((F.col(name) >= t).cast("int") for t in sorted(at)), F.lit(0))
    cells = rows.groupBy(reached("mean", means).alias("m"), reached("peak", peaks).alias("p"), reached("seconds", seconds).alias("s")).agg(
        F.count("*").alias("n"), F.count_if(~F.col("good")).alias("bad")
    )
    rules = [(i * len(peaks) * len(seconds) + j * len(seconds) + k, a, b, c) for i, a in enumerate(means) for j, b in enumerate(peaks) for k, c in enumerate(seconds)]
    levels = [{t: 1 + sorted(at).index(t) for t in at} for at in (means, peaks, seconds)]
    grid = rows.sparkSession.createDataFrame(
        [(i, float(a), float(b), float(c), levels[0][a], levels[1][b], levels[2][c]) for i, a, b, c in rules],
        "place int, mean_at double, peak_at double, seconds_at double, m_at int, p_at int, s_at int",
    )
    auto = (F.col("m") >= F.col("m_at")) & (F.col("p") >= F.col("p_at")) & (F.col("s") >= F.col("s_at"))
    tried = (
        cells.crossJoin(F.broadcast(grid))  # counts and rules: both bounded by the lists
        .groupBy("place", "mean_at", "peak_at", "seconds_at")
        .agg(F.sum("n").alias("n"), F.sum(F.when(auto, F.col("n")).otherwise(0)).alias("n_auto"), F.sum(F.when(auto, F.col("bad")).otherwise(0)).alias("n_false"))
        .withColumns({"auto_rate": ratio(F.col("n_auto"), F.col("n")), "false_rate": ratio(F.col("n_false"), F.col("n_auto"))})
    )
    return tried.filter((F.col("false_rate") <= most_false) & (F.col("n_auto") > 0)).orderBy(F.desc("auto_rate"), "false_rate", "place").limit(1)
