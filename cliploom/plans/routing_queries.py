"""Queries on routing rules, over feature rows derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing
from ..sources.tables import FEATURES, features
from .registry import query

VALUES = ", ".join(f"CAST(event_id * {a} % {m} AS DOUBLE) / {d} AS {name}" for name, (a, m, d) in FEATURES.items())
ROWS = f"""f0 AS (
  SELECT event_id AS clip_id, value AS duration_sec, event_type <> 'error' AS has_motion, hour(ts + INTERVAL 9 HOUR) AS hour, event_type,
         CASE event_id % 13 WHEN 0 THEN 'pending' WHEN 1 THEN NULL ELSE 'ready' END AS status,
         CASE event_id % 11 WHEN 0 THEN 'low' WHEN 1 THEN NULL WHEN 2 THEN 'medium' ELSE 'high' END AS reliability,
         CASE WHEN event_id % 9 <> 0 THEN event_id % 6 END AS bursts, event_id % 3 AS window_10m, CASE WHEN event_id % 8 <> 0 THEN event_id % 5 END AS window_30m, {VALUES}
  FROM events),
f AS (SELECT * REPLACE (CASE WHEN clip_id % 17 <> 0 THEN motion_mean END AS motion_mean, CASE WHEN clip_id % 10 <> 0 THEN last_motion END AS last_motion) FROM f0)"""
NAMES = """names(reason, route, priority, risk) AS (VALUES
  ('poor_visibility_requires_review', 'review_candidate', 0.74::DOUBLE, 'medium'), ('high_or_bursty_motion_could_hide_p0_behavior', 'cloud_now', {strong}, 'high'),
  ('very_static_low_motion_clip', 'activity_only', 0.18, 'low'), ('low_activity_but_not_safe_to_drop', 'cloud_later', 0.42, 'medium'),
  ('moderate_motion_batchable', 'cloud_later', {moderate}, 'medium'), ('extreme_static_visible_clip', 'activity_only', 0.16, 'low'),
  ('low_motion_batchable_not_droppable', 'cloud_later', 0.38, 'medium'), ('v2_high_or_unreliable_evidence', 'cloud_now', 0.88, 'high'),
  ('v2_conflicting_sparse_evidence', 'review_candidate', 0.72, 'medium'), ('v2_extreme_static_reliable_clip', 'activity_only', 0.18, 'low'),
  ('v2_batchable_contextual_activity', 'cloud_later', 0.52, 'medium'))"""
FIRST, SECOND = (NAMES.format(strong=s, moderate=m) for s, m in (("0.86", "0.58"), ("0.88", "0.56")))


def told(df, route):
    return df.withColumn("r", route).select("clip_id", "r.route", "r.priority", "r.risk", "r.reason")


@query(f"""WITH {ROWS}, {FIRST}, d AS (SELECT clip_id, CASE
  WHEN brightness_mean < 18 OR brightness_std < 2 THEN 'poor_visibility_requires_review'
  WHEN motion_mean >= 0.026 OR motion_peak >= 0.12 OR motion_std >= 0.035 OR late_ratio >= 1.8 THEN 'high_or_bursty_motion_could_hide_p0_behavior'
  WHEN motion_peak < 0.018 AND active_ratio < 0.12 THEN 'very_static_low_motion_clip' WHEN motion_mean < 0.01 AND active_ratio < 0.25 THEN 'low_activity_but_not_safe_to_drop'
  ELSE 'moderate_motion_batchable' END AS reason FROM f0)
SELECT clip_id, route, priority, risk, reason FROM d JOIN names USING (reason)""")
def router_v0(spark, sf_dir):
    return told(features(spark, sf_dir, missing=False), routing.first_route())


@query(f"""WITH {ROWS}, {SECOND}, d AS (SELECT clip_id, CASE
  WHEN brightness_mean < 18 OR brightness_std < 2 THEN 'poor_visibility_requires_review'
  WHEN motion_mean < 0.003 AND motion_peak < 0.01 AND active_ratio < 0.05 AND brightness_mean >= 35 AND brightness_std >= 4 THEN 'extreme_static_visible_clip'
  WHEN motion_mean >= 0.03 OR motion_peak >= 0.14 OR motion_std >= 0.05 OR late_ratio >= 2.2 THEN 'high_or_bursty_motion_could_hide_p0_behavior'
  WHEN motion_mean < 0.014 AND active_ratio < 0.35 THEN 'low_motion_batchable_not_droppable' ELSE 'moderate_motion_batchable' END AS reason FROM f0)
SELECT clip_id, route, priority, risk, reason FROM d JOIN names USING (reason)""")
def router_v1(spark, sf_dir):
    return told(features(spark, sf_dir, missing=False), routing.second_route())


DERIVED = f"""{ROWS}, e AS (SELECT *, hour >= 20 OR hour < 6 AS night, greatest(0.0, active_ratio - baseline) AS above_baseline,
         CASE WHEN active_ratio < 0.03 THEN 0 ELSE greatest(1, CAST(round_even(active_ratio * 4, 0) AS INTEGER)) END AS bursts_told,
         least(duration_sec, duration_sec * active_ratio) AS longest_sec,
         CASE WHEN brightness_mean < 25 OR brightness_std < 3 THEN 'low' WHEN brightness_std >= 8 THEN 'high' ELSE 'medium' END AS reliability_told FROM f0)"""


@query(f"""WITH {DERIVED}, {SECOND}, d AS (SELECT *, CASE
  WHEN reliability_told = 'low' OR motion_mean >= 0.03 OR motion_peak >= 0.14 OR above_baseline >= 0.45 THEN 'v2_high_or_unreliable_evidence'
  WHEN window_10m <= 0 OR active_ratio < 0.06 AND late_ratio >= 2 THEN 'v2_conflicting_sparse_evidence'
  WHEN motion_mean < 0.003 AND motion_peak < 0.01 AND active_ratio < 0.03 AND reliability_told = 'high' AND window_30m <= 1 THEN 'v2_extreme_static_reliable_clip'
  ELSE 'v2_batchable_contextual_activity' END AS reason FROM e)
SELECT clip_id, names.route, names.priority, names.risk, reason, night, above_baseline, bursts_told, longest_sec, CASE WHEN bursts_told > 0 THEN 0.0::DOUBLE END AS first_sec,
       CASE WHEN bursts_told > 0 THEN duration_sec * least(1.0, late_ratio) END AS last_sec, reliability_told FROM d JOIN names USING (reason)""")
def router_v2(spark, sf_dir):
    found = routing.derived_evidence()
    rows = features(spark, sf_dir, missing=False).withColumns(found).withColumn("r", routing.third_route())
    return rows.select("clip_id", "r.route", "r.priority", "r.risk", "r.reason", *found)


OPERATIONAL = f"""{ROWS}, o AS (SELECT *, CASE WHEN coalesce(status, '') <> 'ready' THEN 1
  WHEN motion_mean IS NULL OR motion_peak IS NULL OR active_ratio IS NULL OR coalesce(reliability = 'low', false) THEN 2
  WHEN motion_mean >= 0.035 OR motion_peak >= 0.14 OR motion_std >= 0.045 OR active_ratio >= 0.65 OR delta >= 0.35 OR coalesce(bursts >= 4, false)
    OR coalesce(duration_sec <> 0 AND longest_burst >= least(12.0, duration_sec * 0.25), false) THEN 3
  WHEN NOT has_motion OR motion_mean < 0.002 AND motion_peak < 0.01 AND active_ratio < 0.02 AND coalesce(bursts <= 1, true) AND coalesce(window_30m <= 2, true)
    AND coalesce(reliability IN ('medium', 'high'), true) THEN 4
  WHEN motion_mean < 0.012 AND motion_peak < 0.045 AND active_ratio < 0.2 AND coalesce(bursts <= 2, true) THEN 5 ELSE 6 END AS rule FROM f),
op AS (SELECT o.*, r.route, r.priority, r.risk, CASE WHEN rule = 1 THEN 'feature_not_ready:' || coalesce(nullif(status, ''), 'missing') ELSE r.reason END AS reason
  FROM o JOIN (VALUES (1, 'review_candidate', 0.9::DOUBLE, 'high', ''), (2, 'review_candidate', 0.78, 'medium', 'feature_not_ready:missing_or_low_reliability'),
    (3, 'cloud_now', 0.88, 'high', 'strong_activity_or_burst'), (4, 'activity_only', 0.18, 'low', 'extreme_static_reliable'),
    (5, 'cloud_later', 0.42, 'medium', 'low_activity_batchable'), (6, 'cloud_later', 0.58, 'medium', 'moderate_activity_batchable')) r(rule, route, priority, risk, reason) USING (rule))"""


@query(f"WITH {OPERATIONAL} SELECT clip_id, route, priority, risk, reason FROM op")
def operational_router(spark, sf_dir):
    return told(features(spark, sf_dir), routing.operational_route())


GUARDED = f"""{OPERATIONAL}, g AS (SELECT op.* EXCLUDE (priority, risk), CASE
    WHEN route = 'cloud_now' AND coalesce(center_ratio < 0.55 AND active_ratio < 0.95 AND (last_motion IS NULL OR last_motion < 56), false) THEN 'off_center_motion_batchable'
    WHEN route = 'cloud_later' AND coalesce(late_ratio >= 1.8 AND motion_peak >= 0.08 AND active_ratio >= 0.15, false) THEN 'late_low_motion_care_sentinel' ELSE 'unchanged' END AS candidate_reason FROM op),
en AS (SELECT *, CASE candidate_reason WHEN 'off_center_motion_batchable' THEN 'cloud_later' WHEN 'late_low_motion_care_sentinel' THEN 'review_candidate' ELSE route END AS candidate_route FROM g),
rich AS (SELECT *, CASE WHEN candidate_reason = 'off_center_motion_batchable' THEN 0.42::DOUBLE WHEN candidate_reason = 'late_low_motion_care_sentinel' THEN 0.74 WHEN candidate_route = 'cloud_now' THEN 0.88
    WHEN candidate_route = 'review_candidate' THEN 0.78 WHEN candidate_route = 'activity_only' THEN 0.18 ELSE 0.58 END AS priority,
  CASE WHEN candidate_reason <> 'unchanged' THEN 'medium' WHEN candidate_route = 'cloud_now' THEN 'high' WHEN candidate_route = 'activity_only' THEN 'low' ELSE 'medium' END AS risk FROM en)"""


@query(f"WITH {GUARDED} SELECT clip_id, route AS baseline_route, reason AS baseline_reason, candidate_route, candidate_reason, priority, risk FROM rich")
def routed_candidates(spark, sf_dir):
    return routing.enriched(features(spark, sf_dir)).select("clip_id", "baseline_route", "baseline_reason", "candidate_route", "candidate_reason", "priority", "risk")


@query(f"WITH {GUARDED} SELECT clip_id, route AS before, candidate_route AS after, candidate_reason AS reason FROM rich WHERE candidate_reason <> 'unchanged'")
def care_guard(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("before", routing.operational_route()["route"]).withColumn("g", routing.guarded(F.col("before")))
    return rows.filter("g.reason <> 'unchanged'").select("clip_id", "before", F.col("g.route").alias("after"), "g.reason")


@query(f"""WITH {OPERATIONAL}, k AS (SELECT unnest([{{'kind': 'route', 'value': route}}, {{'kind': 'risk', 'value': risk}}, {{'kind': 'reason', 'value': reason}}]) AS k FROM op)
SELECT k.kind, k.value, count(*) AS n, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM op) AS share FROM k GROUP BY ALL""")
def route_distribution(spark, sf_dir):
    return routing.route_rates(told(features(spark, sf_dir), routing.operational_route()))


CARE = ["click", "error"]
GT = "CASE event_type WHEN 'view' THEN 'moving' ELSE event_type END"


@query(f"""WITH {GUARDED}, c AS (SELECT {GT} AS gt, route, candidate_route FROM rich), s AS (SELECT count(*) AS n,
  count(*) FILTER (WHERE gt = 'moving' AND route = 'cloud_now') AS moving_before, count(*) FILTER (WHERE gt = 'moving' AND candidate_route = 'cloud_now') AS moving_after,
  count(*) FILTER (WHERE gt IN ('click', 'error') AND candidate_route IN ('cloud_now', 'review_candidate')) AS care_kept, count(*) FILTER (WHERE gt IN ('click', 'error')) AS care_total,
  count(*) FILTER (WHERE gt IN ('click', 'error') AND candidate_route = 'activity_only') AS care_activity_only,
  count(*) FILTER (WHERE gt IN ('click', 'error') AND route = 'cloud_now' AND candidate_route = 'cloud_later') AS care_lowered FROM c)
SELECT *, CASE WHEN moving_before = 0 THEN 0.0::DOUBLE ELSE CAST(moving_before - moving_after AS DOUBLE) / moving_before END AS reduction_rate,
  CASE WHEN care_total = 0 THEN 0.0::DOUBLE ELSE CAST(care_kept AS DOUBLE) / care_total END AS care_recall FROM s""")
def guard_summary(spark, sf_dir):
    gt = F.when(F.col("event_type") == "view", "moving").otherwise(F.col("event_type"))
    return routing.guard_summary(routing.enriched(features(spark, sf_dir)).withColumn("gt", gt), CARE)


@query(f"WITH {OPERATIONAL} SELECT event_type AS gt, route, count(*) AS n, event_type IN ('click', 'error') AND route IN ('activity_only', 'cloud_later') AS leaks FROM op GROUP BY ALL")
def priority_leakage(spark, sf_dir):
    rows = features(spark, sf_dir).select(F.col("event_type").alias("gt"), routing.operational_route()["route"].alias("route"))
    return routing.leakage(rows, CARE)


@query(f"""WITH {ROWS}, {FIRST}, d AS (SELECT event_type, CASE
  WHEN brightness_mean < 18 OR brightness_std < 2 THEN 'review_candidate' WHEN motion_mean >= 0.026 OR motion_peak >= 0.12 OR motion_std >= 0.035 OR late_ratio >= 1.8 THEN 'cloud_now'
  WHEN motion_peak < 0.018 AND active_ratio < 0.12 THEN 'activity_only' ELSE 'cloud_later' END AS route FROM f0)
SELECT route, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_urgent FROM d GROUP BY 1""")
def router_basic(spark, sf_dir):
    rows = features(spark, sf_dir, missing=False).select("event_type", routing.first_route()["route"].alias("route"))
    return rows.groupBy("route").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_urgent"))
