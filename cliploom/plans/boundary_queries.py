"""Queries on studies of event boundaries, scores of paired forms, and how numbers are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ratios import rounded_ratio
from ..operators import boundaries, events, paired, shapes
from ..sources.reviews import SUBMISSIONS, submissions
from ..sources.tables import clips, table
from .event_queries import PAIRS, accounted
from .registry import CLIPS, query
from .study_queries import FITS

DECISIONS = boundaries.DECISIONS


def study(spark, sf_dir):
    """Neighbouring clips with two decisions, the owner's side and, where it is needed, a resolution."""
    right, left = F.col("right_clip"), F.col("left_clip")
    a = F.when(right % 7 < 4, DECISIONS[0]).when(right % 7 < 6, DECISIONS[1]).otherwise(DECISIONS[2])
    b = F.when(right % 11 < 2, DECISIONS[1]).when(right % 11 == 2, DECISIONS[2]).otherwise(F.col("a"))
    owner = F.when(left % 3 == 0, "a").when(left % 3 == 1, "b")
    rows = events.adjacent_pairs(accounted(spark, sf_dir)).withColumn("a", a).withColumn("b", b)
    ends = F.when(right % 3 == 0, DECISIONS[0]).otherwise(DECISIONS[1])
    open_ = (F.col("a") != F.col("b")) | (F.col("a") == DECISIONS[2])
    return rows.select("left_clip", "right_clip", (F.col("gap_us") / 1_000_000).alias("gap_sec"), "a", "b", F.when(open_, ends).alias("resolution"), owner.alias("owner_side"))


STUDY = f"""{PAIRS}, s0 AS (SELECT left_clip, right_clip, gap_us / 1e6 AS gap_sec, CASE WHEN right_clip % 7 < 4 THEN 'same_event' WHEN right_clip % 7 < 6 THEN 'different_event' ELSE 'uncertain' END AS a FROM pairs),
s1 AS (SELECT *, CASE WHEN right_clip % 11 < 2 THEN 'different_event' WHEN right_clip % 11 = 2 THEN 'uncertain' ELSE a END AS b, CASE left_clip % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS owner_side FROM s0),
study AS (SELECT *, a <> b OR a = 'uncertain' AS open, CASE WHEN a = b AND a <> 'uncertain' THEN a WHEN right_clip % 3 = 0 THEN 'same_event' ELSE 'different_event' END AS final FROM s1)"""
SWEEP = """sweep AS (SELECT threshold_sec, count(*) FILTER (WHERE gap_sec <= threshold_sec AND final = 'different_event') AS overmerge, count(*) FILTER (WHERE gap_sec > threshold_sec AND final = 'same_event') AS oversplit
  FROM study, (SELECT unnest([0, 5, 15, 30, 60, 120]) AS threshold_sec) GROUP BY 1)"""


@query(f"WITH {STUDY} SELECT x.d AS a, y.d AS b, count(s.a) AS n FROM (SELECT unnest({list(DECISIONS)}) AS d) x CROSS JOIN (SELECT unnest({list(DECISIONS)}) AS d) y LEFT JOIN study s ON s.a = x.d AND s.b = y.d GROUP BY 1, 2")
def boundary_confusion(spark, sf_dir):
    """How often either decision met either, with zeros."""
    return boundaries.confusion(boundaries.boundary_cells(boundaries.resolved(study(spark, sf_dir))))


@query(f"WITH {STUDY}, {SWEEP} SELECT threshold_sec, overmerge, oversplit FROM sweep")
def boundary_sweep(spark, sf_dir):
    """Gaps as a rule for one event: wrongly merged and wrongly split pairs."""
    return boundaries.threshold_sweep(boundaries.boundary_cells(boundaries.resolved(study(spark, sf_dir))))


SHARES = ", ".join(f"count(*) FILTER (WHERE {side} = '{d}') AS {side}_{d.split('_')[0]}" for side in ("a", "b", "final") for d in DECISIONS)


@query(f"""WITH RECURSIVE {STUDY}, {SWEEP}, same AS (SELECT left_clip AS a, right_clip AS b FROM study WHERE final = 'same_event'), n AS (SELECT a AS x, b AS y FROM same UNION SELECT b, a FROM same),
reach AS (SELECT x, x AS y FROM n UNION SELECT reach.x, n.y FROM reach JOIN n ON reach.y = n.x WHERE n.y < reach.x),
saved AS (SELECT count(*) AS saved FROM (SELECT x FROM reach GROUP BY 1 HAVING min(y) <> x)), l AS (SELECT count(*) AS n_clips FROM (SELECT left_clip AS clip FROM study UNION SELECT right_clip FROM study)),
c AS (SELECT count(*) AS n_pairs, count(*) FILTER (WHERE open) AS n_resolved, 0 AS n_open, count(*) FILTER (WHERE a = b) AS agreed, {SHARES},
  count(*) FILTER (WHERE open AND final = CASE owner_side WHEN 'a' THEN a WHEN 'b' THEN b END) AS adopted FROM study),
t AS (SELECT *, CAST(a_same * b_same + a_different * b_different + a_uncertain * b_uncertain AS DOUBLE) / (CAST(n_pairs AS DOUBLE) * n_pairs) AS pe, n_clips - saved AS n_events, saved::DOUBLE / n_clips AS reduction,
  (SELECT threshold_sec FROM sweep WHERE overmerge = 0 ORDER BY oversplit, threshold_sec LIMIT 1) AS selected_threshold_sec FROM c, l, saved)
SELECT n_pairs, n_resolved, n_open, agreed::DOUBLE / n_pairs AS agreement, (agreed::DOUBLE / n_pairs - pe) / (1 - pe) AS kappa, {", ".join(f"{side}_{d.split('_')[0]}" for side in ("a", "b", "final") for d in DECISIONS)},
  (a_uncertain + b_uncertain) / (2.0::DOUBLE * n_pairs) AS uncertain_rate, n_resolved::DOUBLE / n_pairs AS owner_rate, adopted::DOUBLE / n_resolved AS adoption_rate, n_clips, n_events, reduction, selected_threshold_sec,
  CASE WHEN final_uncertain > 0 THEN 'HOLD_UNRESOLVED_BOUNDARY' ELSE 'DEVELOPMENT_EVENT_GT_READY_FOR_LOCAL_VLM_BASELINE' END AS gt_verdict,
  CASE WHEN final_uncertain = 0 AND reduction >= 0.15 AND selected_threshold_sec > 0 THEN 'PASS' ELSE 'EVENT_GT_READY_ROUTER_UTILITY_HOLD' END AS utility_verdict FROM t""")
def boundary_study(spark, sf_dir):
    """Agreement, kappa, owner's part, event count, rule and verdicts of a study in one row."""
    return boundaries.boundary_study(study(spark, sf_dir))


def _rate(d: str) -> str:
    return f"CASE WHEN {d}_evaluable > 0 THEN {d}_agreements::DOUBLE / {d}_evaluable END AS {d}_rate"


SETS = "list_sort(list_distinct(a.{0})) = list_sort(list_distinct(b.{0}))"


@query(f"""WITH {SUBMISSIONS}, t0 AS (SELECT * FROM sub WHERE NOT (reviewer = 2 AND clip_id % 13 = 0)), x AS (SELECT * FROM t0 WHERE reviewer = 1), y AS (SELECT * FROM t0 WHERE reviewer = 2),
who AS (SELECT count(*) FILTER (WHERE reviewer = 1) AS unique_a, count(*) FILTER (WHERE reviewer = 2) AS unique_b, count(*) FILTER (WHERE reviewer = 1 AND human_confidence IN ('uncertain', 'unjudgeable')) AS abstains_a,
  count(*) FILTER (WHERE reviewer = 2 AND human_confidence IN ('uncertain', 'unjudgeable')) AS abstains_b FROM t0),
gone AS (SELECT count(*) FILTER (WHERE a.clip_id IS NULL) AS gone_a, count(*) FILTER (WHERE b.clip_id IS NULL) AS gone_b FROM x a FULL JOIN y b ON a.clip_id = b.clip_id),
p0 AS (SELECT a.clip_id, a.decision AS decision, a.human_confidence NOT IN ('uncertain', 'unjudgeable') AND b.human_confidence NOT IN ('uncertain', 'unjudgeable') AS open, a.decision = b.decision AS agree,
  a.visibility <> 'uncertain' AND b.visibility <> 'uncertain' AS v_can, a.visibility = b.visibility AS v_same, a.primary_action = b.primary_action AS p_same, {SETS.format('observed_actions')} AS o_same,
  a.target <> 'uncertain' AND b.target <> 'uncertain' AS t_can, a.target = b.target AND {SETS.format('context_tags')} AS t_same, a.segments AS sa, b.segments AS sb FROM x a JOIN y b ON a.clip_id = b.clip_id),
e AS (SELECT clip_id, i, j FROM (SELECT clip_id, sa, sb, unnest(range(1, len(sa) + 1)) AS i FROM p0) q, range(1, 3) t(j) WHERE j <= len(sb) AND (SELECT {FITS} FROM (SELECT sa[i] AS l, sb[j] AS r))),
m AS (SELECT a.clip_id, max(CASE WHEN a.i <> b.i AND a.j <> b.j THEN 2 ELSE 1 END) AS tp FROM e a JOIN e b ON a.clip_id = b.clip_id GROUP BY 1),
p AS (SELECT p0.* EXCLUDE (agree), open AND agree AS agree, open AND agree AND decision = 'label' AS l, coalesce(tp, 0) AS tp FROM p0 LEFT JOIN m USING (clip_id)),
z AS (SELECT *, CASE WHEN l THEN v_can AND v_same AND p_same AND o_same AND t_can AND t_same AND tp = len(sa) AND tp = len(sb) ELSE agree AND decision <> 'label' END AS automatic FROM p),
s AS (SELECT count(*) AS paired, count(*) FILTER (WHERE open) AS decision_evaluable, count(*) FILTER (WHERE agree) AS decision_agreements, count(*) FILTER (WHERE l AND v_can) AS visibility_evaluable, count(*) FILTER (WHERE l AND v_can AND v_same) AS visibility_agreements,
  count(*) FILTER (WHERE l) AS primary_action_evaluable, count(*) FILTER (WHERE l AND p_same) AS primary_action_agreements, count(*) FILTER (WHERE l) AS observed_action_set_evaluable, count(*) FILTER (WHERE l AND o_same) AS observed_action_set_agreements,
  count(*) FILTER (WHERE l AND t_can) AS target_context_evaluable, count(*) FILTER (WHERE l AND t_can AND t_same) AS target_context_agreements, count(*) FILTER (WHERE l) AS segments_evaluable,
  CAST(coalesce(sum(tp) FILTER (WHERE l), 0) AS BIGINT) AS tp, CAST(coalesce(sum(len(sa) - tp) FILTER (WHERE l), 0) AS BIGINT) AS fp, CAST(coalesce(sum(len(sb) - tp) FILTER (WHERE l), 0) AS BIGINT) AS fn,
  count(*) FILTER (WHERE automatic) AS automatic, count(*) FILTER (WHERE NOT automatic) AS to_owner FROM z),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1 END AS "precision", CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1 END AS recall FROM s)
SELECT unique_a AS submissions_a, unique_b AS submissions_b, unique_a, unique_b, 0 AS repeats_a, 0 AS repeats_b, abstains_a, abstains_b, greatest(30 - unique_a, gone_a, 0) AS missing_a, greatest(30 - unique_b, gone_b, 0) AS missing_b, r.*,
  {", ".join(_rate(d) for d in paired.DIMENSIONS)}, CASE WHEN "precision" + recall > 0 THEN 2 * "precision" * recall / ("precision" + recall) ELSE 0 END AS f1 FROM r, who, gone""")
def paired_scores(spark, sf_dir):
    """Agreement of two reviewers by dimension, matched segments, automatic agreement; reviewer 2 lacks some clips."""
    rows = submissions(spark, sf_dir).filter(~((F.col("reviewer") == 2) & (F.col("clip_id") % 13 == 0)))
    return paired.paired_scores(rows, ["duration_sec"], 30)


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings), w AS (SELECT vec_id, list_transform(v, lambda x: x / list_max(v)) AS w FROM v),
t AS (SELECT vec_id, list_transform(range(60), lambda i: list_max(w[CAST(floor(i * (len(w) / 60.0::DOUBLE)) AS BIGINT) + 1:CAST(floor((i + 1) * (len(w) / 60.0::DOUBLE)) AS BIGINT)])) AS t FROM w)
SELECT vec_id, array_to_string(list_transform(t, lambda x: ['▁', '▂', '▃', '▄', '▅', '▆', '▇', '█'][least(7, CAST(trunc(x * 8) AS BIGINT)) + 1]), '') AS line FROM t""")
def spark_glyphs(spark, sf_dir):
    """Each vector's sizes, against its largest, as a line of 60 glyphs."""
    sizes = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", sizes.alias("v")).withColumn("top", F.array_max("v"))
    return rows.select("vec_id", shapes.spark_line(F.transform("v", lambda x: x / F.col("top"))).alias("line"))


@query(f"""WITH {CLIPS}, r AS (SELECT clip_id, clip_id % 161 AS part, [160, 32, 0, 7][clip_id % 4 + 1] AS whole FROM clips), h AS (SELECT *, part * 20000 AS twice, part * 10000 // nullif(whole, 0) AS low FROM r)
SELECT clip_id, CASE WHEN whole = 0 THEN 0.0::DOUBLE WHEN twice = (2 * low + 1) * whole AND whole = 32 THEN (low + low % 2) / 10000.0::DOUBLE
  WHEN twice = (2 * low + 1) * whole THEN CAST(format('{{:.4f}}', part / whole::DOUBLE) AS DOUBLE) WHEN twice > (2 * low + 1) * whole THEN (low + 1) / 10000.0::DOUBLE ELSE low / 10000.0::DOUBLE END AS rate FROM h""")
def rounded_rates(spark, sf_dir):
    """Shares to four digits, ties of the binary value to the even digit."""
    whole = F.get(F.array(*[F.lit(x) for x in (160, 32, 0, 7)]), (F.col("clip_id") % 4).cast("int"))
    return clips(spark, sf_dir).select("clip_id", rounded_ratio(F.col("clip_id") % 161, whole).alias("rate"))
