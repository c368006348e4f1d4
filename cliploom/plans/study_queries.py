"""Queries on study statistics, cascades, gates and validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merkle, studies
from ..sources.reviews import SUBMISSIONS
from ..sources.tables import assessments, clips, features, jobs, predictions, settings, table
from .metric_queries import TWO, two_models
from .registry import ASSESSMENTS, CLIPS, JOBS, PREDICTIONS, SETTINGS, merkle_sql, query
from .review_queries import pairs
from .routing_queries import ROWS

B = 200
WEIGHT = " + ".join(f"CAST(u >= {p} AS INTEGER)" for p in studies.POISSON)


@query(f"""WITH {PREDICTIONS}, c AS (SELECT substr(md5(CAST(sample_id AS VARCHAR)), 1, 2) AS part, truth, pred, count(*) AS n FROM predictions GROUP BY 1, 2, 3),
d AS (SELECT *, CAST(CAST('0x' || substr(md5('boot|' || b || '|' || part), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296 AS u FROM c, range({B}) r(b)),
k AS (SELECT b, truth, pred, sum(n * ({WEIGHT})) AS w FROM d GROUP BY 1, 2, 3 HAVING sum(n * ({WEIGHT})) > 0),
s AS (SELECT b, truth AS label, truth = pred AS hit, true AS t, w FROM k UNION ALL SELECT b, pred, truth = pred, false, w FROM k),
l AS (SELECT b, label, coalesce(sum(w) FILTER (WHERE t AND hit), 0) AS tp, coalesce(sum(w) FILTER (WHERE t), 0) AS support, sum(w) AS total FROM s GROUP BY 1, 2),
m AS (SELECT b, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy, CAST(sum(CAST(round(CAST(2 * tp AS DOUBLE) / CAST(total AS DOUBLE) * 1e9) AS BIGINT)) AS DOUBLE) / count(*) AS macro FROM l GROUP BY 1),
o AS (SELECT list_sort(list(accuracy)) AS a, list_sort(list(macro)) AS f FROM m)
SELECT (SELECT count(*) FROM predictions) AS n, a[{int(0.025 * B) + 1}] AS accuracy_low, a[{int(0.975 * B) + 1}] AS accuracy_high, f[{int(0.025 * B) + 1}] AS macro_e9_low, f[{int(0.975 * B) + 1}] AS macro_e9_high FROM o""")
def bootstrap_intervals(spark, sf_dir):
    return studies.bootstrap(predictions(spark, sf_dir), "sample_id", B, "boot")


@query(f"""WITH {PREDICTIONS} SELECT model, count(*) AS n, coalesce(count(*) FILTER (WHERE truth = 'R' AND pred = 'R') / CAST(nullif(count(*) FILTER (WHERE truth = 'R'), 0) AS DOUBLE), 0.0) AS present_recall,
  count(*) FILTER (WHERE pred = 'N') / CAST(count(*) AS DOUBLE) AS abstained, coalesce(count(*) FILTER (WHERE pred <> 'N' AND pred = truth) / CAST(nullif(count(*) FILTER (WHERE pred <> 'N'), 0) AS DOUBLE), 0.0) AS told_accuracy FROM predictions GROUP BY 1""")
def presence_rates(spark, sf_dir):
    return studies.presence(predictions(spark, sf_dir), "model", "R", "N")


@query(f"""WITH {PREDICTIONS}, {TWO}, o AS (SELECT count(*) AS n, count(*) FILTER (WHERE base <> truth AND strong = truth) AS recovered, count(*) FILTER (WHERE base = truth AND strong <> truth) AS broken,
  count(*) FILTER (WHERE base <> truth AND strong <> truth AND base <> strong) AS harmless, count(*) FILTER (WHERE base = truth) AS base_right, count(*) FILTER (WHERE strong = truth) AS new_right FROM two)
SELECT *, CAST(new_right - base_right AS DOUBLE) / n AS gain, CAST(new_right - base_right AS DOUBLE) / n > 0.03 AND recovered > broken AS adopt FROM o""")
def paired_change(spark, sf_dir):
    return studies.paired(two_models(spark, sf_dir).withColumnRenamed("strong", "new"))


@query(f"""WITH {ROWS}, r AS (SELECT event_type AS truth, CASE WHEN motion_mean >= 0.03 THEN 'auto_label' ELSE 'fallback_vlm' END AS route, 'view' AS auto_action, CASE WHEN clip_id % 3 = 0 THEN 'view' ELSE event_type END AS base FROM f0),
o AS (SELECT count(*) AS n, count(*) FILTER (WHERE route = 'auto_label') AS n_auto, count(*) FILTER (WHERE route = 'auto_label' AND auto_action <> truth) AS n_false,
  count(*) FILTER (WHERE CASE WHEN route = 'auto_label' THEN auto_action ELSE base END = truth) AS n_right, count(*) FILTER (WHERE base = truth) AS base_right FROM r)
SELECT *, CAST(n - n_auto AS DOUBLE) / n AS fallback_rate, CAST(n_right AS DOUBLE) / n AS accuracy, CAST((base_right - n_right) * 100 AS DOUBLE) / n AS drop_points, CASE WHEN n_auto = 0 THEN 0.0 ELSE CAST(n_false AS DOUBLE) / n_auto END AS false_rate,
  1 - CAST(n - n_auto AS DOUBLE) / n * 900 / 1000 AS token_reduction FROM o""")
def cascade_score(spark, sf_dir):
    f = features(spark, sf_dir, missing=False)
    route = F.when(F.col("motion_mean") >= 0.03, "auto_label").otherwise("fallback_vlm")
    rows = f.select(F.col("event_type").alias("truth"), route.alias("route"), F.lit("view").alias("auto_action"), F.when(F.col("clip_id") % 3 == 0, "view").otherwise(F.col("event_type")).alias("baseline_action"))
    return studies.cascade_score(rows, 1000.0, 900.0)


@query(f"""WITH {PREDICTIONS}, {TWO}, u AS (SELECT truth, base, strong, unnest([{{'rule': 'class', 'up': base = 'R'}}, {{'rule': 'unsure', 'up': conf < 0.4}}, {{'rule': 'disagree', 'up': base <> strong}}, {{'rule': 'all', 'up': true}}]) AS x FROM two),
o AS (SELECT x.rule AS rule, count(*) AS n, count(*) FILTER (WHERE x.up) AS n_escalated, count(*) FILTER (WHERE CASE WHEN x.up THEN strong ELSE base END = truth) AS n_right, count(*) FILTER (WHERE strong = truth) AS s, count(*) FILTER (WHERE base = truth) AS b FROM u GROUP BY 1)
SELECT rule, n, n_escalated, n_right, CASE WHEN s = b THEN 0.0 ELSE CAST(n_right - b AS DOUBLE) / (s - b) END AS recovered FROM o""")
def cascade_triggers(spark, sf_dir):
    rules = {"class": F.col("base") == "R", "unsure": F.col("conf") < 0.4, "disagree": F.col("base") != F.col("strong"), "all": F.lit(True)}
    return studies.escalated(two_models(spark, sf_dir), rules)


@query(f"""WITH {PREDICTIONS}, {TWO}, o AS (SELECT *, row_number() OVER (ORDER BY reverse(CAST(clip_id AS VARCHAR)), strong = truth, base = truth) AS nth FROM two),
k AS (SELECT count(*) FILTER (WHERE base = 'R') AS n1, count(*) FILTER (WHERE conf < 0.4) AS n2, count(*) FILTER (WHERE base <> strong) AS n3, count(*) AS n4 FROM o),
u AS (SELECT truth, base, strong, unnest([{{'rule': 'class', 'up': base = 'R', 'c': nth <= n1}}, {{'rule': 'unsure', 'up': conf < 0.4, 'c': nth <= n2}}, {{'rule': 'disagree', 'up': base <> strong, 'c': nth <= n3}}, {{'rule': 'all', 'up': true, 'c': nth <= n4}}, {{'rule': 'none', 'up': false, 'c': false}}]) AS x FROM o, k),
o2 AS (SELECT x.rule AS rule, count(*) AS n, count(*) FILTER (WHERE x.up) AS n_escalated, count(*) FILTER (WHERE CASE WHEN x.up THEN strong ELSE base END = truth) AS n_right, count(*) FILTER (WHERE CASE WHEN x.c THEN strong ELSE base END = truth) AS control_right,
  count(*) FILTER (WHERE strong = truth) AS s, count(*) FILTER (WHERE base = truth) AS b FROM u GROUP BY 1)
SELECT rule, n, n_escalated, n_right, CASE WHEN s = b THEN 0.0 ELSE CAST(n_right - b AS DOUBLE) / (s - b) END AS recovered, control_right, CASE WHEN s = b THEN 0.0 ELSE CAST(control_right - b AS DOUBLE) / (s - b) END AS control_recovered FROM o2""")
def cascade_controls(spark, sf_dir):
    """Each trigger beside as many rows taken without looking: what it wins back more than chance does."""
    rules = {"class": F.col("base") == "R", "unsure": F.col("conf") < 0.4, "disagree": F.col("base") != F.col("strong"), "all": F.lit(True), "none": F.lit(False)}
    return studies.escalated_with_control(two_models(spark, sf_dir), rules, "clip_id")


CALLS = "calls AS (SELECT a.truth, a.pred AS p_pred, a.conf AS p_conf, CAST(a.quantity AS BIGINT) AS p_tokens, b.pred AS f_pred, CASE WHEN b.quantity > 3 THEN CAST(b.quantity * 3 AS BIGINT) END AS f_tokens, CAST(floor(a.price) AS BIGINT) AS p_wall, CAST(floor(b.price) AS BIGINT) AS f_wall FROM predictions a JOIN predictions b ON a.clip_id = b.clip_id AND a.line = 1 AND b.line = 2)"


@query(f"""WITH {PREDICTIONS}, {CALLS}, c AS (SELECT *, p_conf < 0.5 OR p_pred NOT IN ('A', 'R') AS back FROM calls),
o AS (SELECT count(*) AS n, count(*) FILTER (WHERE back) AS n_back, count(*) FILTER (WHERE CASE WHEN back THEN f_pred ELSE p_pred END = truth) AS n_right,
  CAST(sum(p_tokens + CASE WHEN back THEN coalesce(f_tokens, 0) ELSE 0 END) AS BIGINT) AS tokens, CAST(sum(coalesce(f_tokens, 0)) AS BIGINT) AS frame_tokens, CAST(sum(p_wall + CASE WHEN back THEN f_wall ELSE 0 END) AS BIGINT) AS wall FROM c)
SELECT * EXCLUDE (wall), CAST(wall AS DOUBLE) / n AS avg_wall_ms, CAST(n_back AS DOUBLE) / n AS fallback_rate, CAST(n_right AS DOUBLE) / n AS accuracy, 1 - CAST(tokens AS DOUBLE) / frame_tokens AS token_reduction FROM o""")
def fallback_cascade(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    a = rows.filter("line = 1").select("clip_id", "truth", F.col("pred").alias("p_pred"), F.col("conf").alias("p_conf"), F.col("quantity").cast("long").alias("p_tokens"), F.floor("price").alias("p_wall_ms"))
    b = rows.filter("line = 2").select("clip_id", F.col("pred").alias("f_pred"), F.when(F.col("quantity") > 3, (F.col("quantity") * 3).cast("long")).alias("f_tokens"), F.floor("price").alias("f_wall_ms"))
    return studies.fallback_cascade(a.join(b, "clip_id"), 0.5, ["A", "R"])


@query(f"""WITH {PREDICTIONS}, s AS (SELECT clip_id, pred, count(*) AS n, sum(CAST(conf AS DECIMAL(18, 6))) AS w FROM predictions GROUP BY 1, 2),
v AS (SELECT clip_id, sum(n) AS n, arg_min(pred, (-w, pred)) AS weighted, arg_min(pred, (-w, pred)) FILTER (WHERE pred IN ('A', 'R')) AS p, CAST(max(w) AS DOUBLE) AS best, CAST(sum(w) AS DOUBLE) AS whole FROM s GROUP BY 1)
SELECT clip_id, CAST(n AS BIGINT) AS n, weighted, coalesce(p, weighted) AS priority, CASE WHEN whole = 0 THEN 0.0 ELSE best / whole END AS share FROM v WHERE n >= 2""")
def weighted_votes(spark, sf_dir):
    return studies.all_votes(predictions(spark, sf_dir), "clip_id", ["A", "R"])


@query(f"""WITH {SUBMISSIONS}, j AS (SELECT a.primary_action AS truth, b.primary_action AS pred, CASE WHEN a.clip_id % 2 = 0 THEN 'cam-motion' ELSE 'upload' END AS source, a.clip_id % 19 = 0 AS hard FROM sub a JOIN sub b ON a.clip_id = b.clip_id AND a.reviewer = 1 AND b.reviewer = 2),
g AS (SELECT CASE WHEN hard THEN 'F_hardneg_face' WHEN truth = 'drinking' AND pred = 'drinking' THEN 'A_drink_hit' WHEN truth = 'drinking' AND pred = 'moving' AND source = 'cam-motion' THEN 'B_drink_miss_cam' WHEN truth = 'drinking' AND pred = 'moving' THEN 'C_drink_miss_other'
  WHEN truth = 'drinking' AND pred = 'eating_paste' THEN 'D_drink_to_paste' WHEN truth = 'moving' AND pred = 'drinking' THEN 'E_false_pos' WHEN truth = 'moving' AND pred = 'moving' AND source = 'cam-motion' THEN 'G_moving_ctrl_cam' END AS "group" FROM j)
SELECT "group", count(*) AS n FROM g GROUP BY 1""")
def error_groups(spark, sf_dir):
    n = F.col("clip_id")
    group = studies.error_group(F.col("s1.form.primary_action"), F.col("s2.form.primary_action"), F.when(n % 2 == 0, "cam-motion").otherwise("upload"), n % 19 == 0)
    return pairs(spark, sf_dir).groupBy(group.alias("group")).agg(F.count("*").alias("n"))


VERDICTS = ["informative_care", "informative", "boring", "absent", "unsure"]
SHEET = f"sheet AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'score' ELSE 'random' END AS \"group\", {VERDICTS}[o_custkey % 5 + 1] AS verdict FROM orders)"
SCORES = f"""{SHEET}, scores AS (SELECT "group", count(*) AS n, count(*) FILTER (WHERE verdict <> 'unsure') AS judged, count(*) FILTER (WHERE verdict IN ('informative_care', 'informative')) AS informative,
  count(*) FILTER (WHERE verdict = 'informative_care') AS care, count(*) FILTER (WHERE verdict = 'absent') AS absent, round(count(*) FILTER (WHERE verdict IN ('informative_care', 'informative')) / CAST(count(*) FILTER (WHERE verdict <> 'unsure') AS DOUBLE), 4) AS informative_rate FROM sheet GROUP BY 1)"""


def probe_scores(spark, sf_dir):
    verdict = F.get(F.array(*[F.lit(v) for v in VERDICTS]), (F.col("o_custkey") % 5).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "score").otherwise("random").alias("group"), verdict.alias("verdict"))
    return studies.reviewer_scores(rows, ["informative_care", "informative"], "informative_care")


@query(f'WITH {SCORES} SELECT * FROM scores')
def reviewer_scores(spark, sf_dir):
    return probe_scores(spark, sf_dir)


@query(f"""WITH {SCORES}, b AS (SELECT a.informative AS a_n, a.informative_rate AS a_rate, b.informative AS b_n, b.informative_rate AS b_rate FROM scores a, scores b WHERE a."group" = 'score' AND b."group" = 'random')
SELECT *, CASE WHEN a_rate - b_rate >= 0.15 AND a_n >= 8 THEN 'adopt' WHEN a_rate - b_rate < 0.0 OR a_n <= 4 THEN 'reject' ELSE 'hold' END AS verdict FROM b""")
def probe_gate(spark, sf_dir):
    return studies.probe_gate(probe_scores(spark, sf_dir), "score", "random", 0.15, 0.0, 8, 4)


@query(f"""WITH {PREDICTIONS}, s(truth) AS (VALUES ('A'), ('N'), ('R'), ('X')), c AS (SELECT truth, count(*) AS n, count(*) FILTER (WHERE pred = truth) AS r FROM predictions GROUP BY 1)
SELECT truth, coalesce(n, 0) AS n, coalesce(r, 0) AS n_right, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE CAST(r AS DOUBLE) / n END AS accuracy FROM s LEFT JOIN c USING (truth)""")
def opened_strata(spark, sf_dir):
    return studies.strata(predictions(spark, sf_dir), "truth", ["A", "N", "R", "X"], F.col("pred") == F.col("truth"))


@query(f"""WITH {PREDICTIONS}, o AS (SELECT count(*) AS n, count(*) FILTER (WHERE truth <> 'N') AS n_inside, count(*) FILTER (WHERE truth <> 'N' AND pred = truth) AS inside_right, count(*) FILTER (WHERE truth = 'N') AS n_outside,
  count(*) FILTER (WHERE truth = 'N' AND pred = truth) AS outside_right, CAST(sum(CAST(price AS DECIMAL(18, 2))) AS DOUBLE) AS cost FROM predictions)
SELECT *, CAST(inside_right AS DOUBLE) / n_inside AS accuracy, CAST(outside_right AS DOUBLE) / n_outside AS outside_recall FROM o""")
def split_score(spark, sf_dir):
    return studies.split_score(predictions(spark, sf_dir).withColumnRenamed("price", "cost"), ["N"])


@query(f"""WITH {PREDICTIONS}, {TWO}, u AS (SELECT truth, unnest([{{'s': 'all', 'i': true}}, {{'s': 'sure', 'i': conf >= 0.5}}, {{'s': 'urgent', 'i': truth = 'R'}}]) AS x, unnest([[base, strong], [base, strong], [base, strong]]) AS m FROM two),
v AS (SELECT x.s AS subset, truth, unnest([{{'model': 'base', 'p': m[1]}}, {{'model': 'strong', 'p': m[2]}}]) AS y FROM u WHERE x.i)
SELECT subset, y.model AS model, count(*) AS n, count(*) FILTER (WHERE y.p = truth) AS n_right, count(*) FILTER (WHERE replace(y.p, 'N', 'A') = replace(truth, 'N', 'A')) AS merged_right FROM v GROUP BY 1, 2""")
def subset_panel(spark, sf_dir):
    subsets = {"all": F.lit(True), "sure": F.col("conf") >= 0.5, "urgent": F.col("truth") == "R"}
    return studies.panel(two_models(spark, sf_dir), subsets, ["base", "strong"], {"N": "A"})


FITS = """l.action = r.action AND (CASE WHEN greatest(l.end_sec, r.end_sec) - least(l.start_sec, r.start_sec) > 0 THEN greatest(0.0, least(l.end_sec, r.end_sec) - greatest(l.start_sec, r.start_sec)) / (greatest(l.end_sec, r.end_sec) - least(l.start_sec, r.start_sec)) ELSE 0 END >= 0.5
  OR (abs(l.start_sec - r.start_sec) <= 2 AND abs(l.end_sec - r.end_sec) <= 2))"""


@query(f"""WITH {SUBMISSIONS}, p AS (SELECT a.clip_id, a.segments AS x, b.segments AS y FROM sub a JOIN sub b ON a.clip_id = b.clip_id AND a.reviewer = 1 AND b.reviewer = 2),
e AS (SELECT clip_id, i, j FROM (SELECT clip_id, x, y, unnest(range(1, len(x) + 1)) AS i FROM p) q, range(1, 3) t(j) WHERE j <= len(y) AND (SELECT {FITS} FROM (SELECT x[i] AS l, y[j] AS r))),
m AS (SELECT a.clip_id, max(CASE WHEN a.i <> b.i AND a.j <> b.j THEN 2 ELSE 1 END) AS tp FROM e a JOIN e b ON a.clip_id = b.clip_id GROUP BY 1)
SELECT p.clip_id, CAST(coalesce(tp, 0) AS INTEGER) AS tp, CAST(len(x) - coalesce(tp, 0) AS INTEGER) AS fp, CAST(len(y) - coalesce(tp, 0) AS INTEGER) AS fn FROM p LEFT JOIN m USING (clip_id)""")
def maximum_matching(spark, sf_dir):
    a, b = F.col("s1.form.segments"), F.col("s2.form.segments")
    rows = pairs(spark, sf_dir).select("clip_id", a.alias("a"), b.alias("b")).withColumn("tp", studies.most_matches("a", "b"))
    return rows.select("clip_id", "tp", (F.size("a") - F.col("tp")).alias("fp"), (F.size("b") - F.col("tp")).alias("fn"))


@query(f"""WITH {CLIPS}, {ASSESSMENTS}, {SETTINGS}, c AS (SELECT camera_id, count(*) AS eligible, count(a.clip_id) AS with_any, count(a.clip_id) FILTER (WHERE policy_version = 'v1') AS ready, count(a.clip_id) FILTER (WHERE policy_version = 'v1' AND c.clip_id % 50 <> 0) AS complete
  FROM clips c LEFT JOIN assessments a USING (clip_id) GROUP BY 1),
j AS (SELECT c.*, coalesce(enabled, false) AS enabled FROM c LEFT JOIN settings USING (camera_id)),
g AS (SELECT *, CASE WHEN NOT enabled THEN NULL WHEN eligible = 0 THEN 'no_eligible_clips:' || camera_id WHEN with_any = 0 THEN 'zero_prelabel_coverage:' || camera_id WHEN CAST(ready AS DOUBLE) / eligible < 0.35 THEN 'policy_ready_below:' || camera_id END AS gap FROM j),
o AS (SELECT count(*) FILTER (WHERE enabled) AS e, CAST(sum(ready) AS BIGINT) AS ready, CAST(sum(complete) AS BIGINT) AS complete, coalesce(string_agg(gap, ',' ORDER BY gap), '') AS gaps FROM g)
SELECT CASE WHEN ready > 0 AND complete < ready THEN 'HOLD' WHEN e = 0 OR gaps <> '' THEN 'GAP' ELSE 'PASS' END AS verdict, CASE WHEN ready > 0 AND complete < ready THEN complete || '/' || ready END AS incomplete, CASE WHEN e = 0 THEN 'no_enabled_camera' ELSE gaps END AS gaps FROM o""")
def coverage_verdict(spark, sf_dir):
    a = assessments(spark, sf_dir).select("clip_id", "policy_version")
    ready = F.col("policy_version") == "v1"
    cameras = clips(spark, sf_dir).join(a, "clip_id", "left").groupBy("camera_id").agg(
        F.count("*").alias("eligible"), F.count("policy_version").alias("with_any"), F.count_if(ready).alias("ready"), F.count_if(ready & (F.col("clip_id") % 50 != 0)).alias("complete")
    )
    on = settings(spark, sf_dir).select("camera_id", "enabled")
    return studies.coverage_verdict(cameras.join(on, "camera_id", "left").withColumn("enabled", F.coalesce("enabled", F.lit(False))), 0.35)


@query(f"""WITH {JOBS}, o AS (SELECT count(*) AS n, max(cost) AS most, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'queued') AS queued FROM jobs)
SELECT *, done >= 2 * queued AS ok_capacity, most <= 600000 AS ok_memory, n >= 100 AS ok_sample, CASE WHEN NOT done >= 2 * queued THEN 'capacity' WHEN NOT most <= 600000 THEN 'memory' WHEN NOT n >= 100 THEN 'sample' ELSE 'pass' END AS verdict FROM o""")
def throughput_gates(spark, sf_dir):
    one = jobs(spark, sf_dir).agg(F.count("*").alias("n"), F.max("cost").alias("most"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "queued").alias("queued"))
    return studies.first_failing(one, {"capacity": F.col("done") >= 2 * F.col("queued"), "memory": F.col("most") <= 600000, "sample": F.col("n") >= 100})


SCORES = f"""{PREDICTIONS}, c AS (SELECT model, truth, pred, count(*) AS k FROM predictions GROUP BY 1, 2, 3),
s AS (SELECT model, label, CAST(sum(k) FILTER (WHERE side = 't') AS BIGINT) AS support, CAST(sum(k) FILTER (WHERE side = 'p') AS BIGINT) AS told, CAST(coalesce(sum(k) FILTER (WHERE side = 't' AND hit), 0) AS BIGINT) AS hits
  FROM (SELECT model, truth AS label, 't' AS side, truth = pred AS hit, k FROM c UNION ALL SELECT model, pred, 'p', false, k FROM c) GROUP BY 1, 2),
scores AS (SELECT model, label, coalesce(support, 0) AS support, coalesce(told, 0) AS told, hits, CAST(round(hits * 2e9 / (coalesce(support, 0) + coalesce(told, 0))) AS BIGINT) AS f1_e9 FROM s)"""
SCORE_COLUMNS = ["model", "label", "support", "told", "hits", "f1_e9"]


@query(f"""WITH {SCORES}, {merkle_sql("scores", SCORE_COLUMNS)} SELECT p.plan, n, digest, true AS agrees FROM m0, (VALUES ('cells'), ('rows')) p(plan)""")
def recomputed_digest(spark, sf_dir):
    """Scores of each model and class by two plans that share nothing but the rows: sums over confusion cells in the DataFrame
    API, and SQL that counts truths, predictions and hits in three aggregations of the rows and joins them."""
    rows = predictions(spark, sf_dir).select("model", "truth", "pred")
    cells = rows.groupBy("model", "truth", "pred").agg(F.count("*").alias("k"))
    sides = cells.select("model", "k", F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"), (F.col("truth") == F.col("pred")).alias("hit"))
    total = lambda c: F.sum(F.col("k") * c).cast("long")
    sums = sides.groupBy("model", "s.label").agg(total(F.col("s.t")).alias("support"), total(F.col("s.p")).alias("told"), total(F.col("s.t") * F.col("hit").cast("int")).alias("hits"))
    first = sums.withColumn("f1_e9", F.round(F.col("hits") * F.lit(2e9) / (F.col("support") + F.col("told"))).cast("long"))
    second = spark.sql(
        """WITH t AS (SELECT model, truth AS label, count(*) AS support FROM {rows} GROUP BY ALL), p AS (SELECT model, pred AS label, count(*) AS told FROM {rows} GROUP BY ALL),
        h AS (SELECT model, pred AS label, count(*) AS hits FROM {rows} WHERE truth = pred GROUP BY ALL),
        j AS (SELECT model, label, coalesce(support, 0) AS support, coalesce(told, 0) AS told, coalesce(hits, 0) AS hits FROM t FULL JOIN p USING (model, label) LEFT JOIN h USING (model, label))
        SELECT *, CAST(round(hits * 2e9D / (support + told)) AS BIGINT) AS f1_e9 FROM j""",
        rows=rows,
    )
    return merkle.agreement({"cells": first, "rows": second}, SCORE_COLUMNS)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(f"""WITH {merkle_sql("orders", ORDER_COLUMNS)} SELECT CAST(level AS INTEGER) AS level, prefix, n, digest FROM (SELECT 0 AS level, * FROM m0 UNION ALL SELECT 1, * FROM m1 UNION ALL SELECT 2, * FROM m2)""")
def merkle_nodes(spark, sf_dir):
    """Every node of the hash tree over orders."""
    return merkle.tree(table(spark, sf_dir, "orders"), ORDER_COLUMNS)


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 997 = 1 THEN o_custkey + 1 ELSE o_custkey END AS o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 1009 <> 2
  UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 1013 = 3),
t AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, 1 AS sign FROM orders UNION ALL SELECT *, -1 FROM n)
SELECT CASE WHEN sum(sign) > 0 THEN 'old' ELSE 'new' END AS side, CAST(abs(sum(sign)) AS BIGINT) AS n, o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM t GROUP BY ALL HAVING sum(sign) <> 0""")
def merkle_changes(spark, sf_dir):
    """Rows that differ between orders and a copy with changed, lost and repeated rows, found by walking down two trees."""
    old = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    key = F.col("o_orderkey")
    new = old.filter(key % 1009 != 2).withColumn("o_custkey", F.when(key % 997 == 1, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))).unionByName(old.filter(key % 1013 == 3))
    return merkle.changed_rows(old, new, ORDER_COLUMNS, depth=3)


@query(f"""WITH {PREDICTIONS}, {TWO} SELECT clip_id, truth, base, strong, CASE WHEN strong = truth THEN 'strong' WHEN base = truth THEN 'base' ELSE 'none' END AS right_one FROM two WHERE base <> strong""")
def discordant_rows(spark, sf_dir):
    who = F.when(F.col("strong") == F.col("truth"), "strong").when(F.col("base") == F.col("truth"), "base").otherwise("none")
    return two_models(spark, sf_dir).filter("base <> strong").select("clip_id", "truth", "base", "strong", who.alias("right_one"))


@query("""WITH r AS (SELECT l_orderkey AS sample, CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity < 5 THEN 'Z' ELSE l_returnflag END AS action, CASE WHEN l_tax > 0.07 THEN 1.5 WHEN l_tax > 0.06 THEN NULL ELSE l_discount END::DOUBLE AS confidence FROM lineitem WHERE l_linenumber = 1),
x AS (SELECT o_orderkey AS sample FROM orders WHERE o_orderkey % 10 <> 0), s AS (SELECT sample, count(*) AS n FROM r GROUP BY 1)
SELECT 'schema' AS code, sample FROM r WHERE action IS NULL OR confidence IS NULL GROUP BY 2 UNION ALL SELECT 'class', sample FROM r WHERE action NOT IN ('A', 'N', 'R') GROUP BY 2 UNION ALL SELECT 'range', sample FROM r WHERE confidence NOT BETWEEN 0 AND 1 GROUP BY 2
UNION ALL SELECT 'duplicate', sample FROM s WHERE n > 1 UNION ALL SELECT 'mismatch', sample FROM s WHERE sample NOT IN (SELECT sample FROM x) UNION ALL SELECT 'missing', sample FROM x WHERE sample NOT IN (SELECT sample FROM s)""")
def result_errors(spark, sf_dir):
    q, tax = F.col("l_quantity"), F.col("l_tax")
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(
        F.col("l_orderkey").alias("sample"), F.when(q < 3, None).when(q < 5, "Z").otherwise(F.col("l_returnflag")).alias("action"), F.when(tax > 0.07, 1.5).when(tax > 0.06, None).otherwise(F.col("l_discount")).cast("double").alias("confidence")
    )
    return studies.result_errors(rows, table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("sample")), ["A", "N", "R"])


@query(f"""WITH {CLIPS}, u AS (SELECT unnest([{{'kind': 'camera_id', 'value': CAST(camera_id AS VARCHAR)}}, {{'kind': 'day', 'value': CAST(activity_day AS VARCHAR)}}, {{'kind': 'event_type', 'value': event_type}}]) AS k FROM clips),
c AS (SELECT k.kind AS kind, k.value AS value, count(*) AS n FROM u GROUP BY ALL) SELECT kind, value, n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, value) <= 20""")
def inventory_top(spark, sf_dir):
    rows = clips(spark, sf_dir).withColumn("day", F.col("activity_day").cast("string"))
    return studies.top_values(rows, ["camera_id", "day", "event_type"], 20)


@query(f"""WITH {PREDICTIONS} SELECT model, truth || ' -> ' || pred AS mistake, count(*) AS n, CAST(sum(CAST(quantity AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(CAST(quantity AS BIGINT)) AS DOUBLE) * 3 / 1000000 AS cost FROM predictions WHERE truth <> pred GROUP BY 1, 2""")
def mistakes_by_model(spark, sf_dir):
    out = predictions(spark, sf_dir).filter("truth <> pred").groupBy("model", F.concat_ws(" -> ", "truth", "pred").alias("mistake")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("quantity").cast("long"), F.lit(0))).alias("tokens"))
    return out.withColumn("cost", F.col("tokens").cast("double") * 3 / 1_000_000)


@query("""WITH s AS (SELECT b.n AS batch, o_orderkey AS item, o_custkey AS who FROM orders JOIN (SELECT unnest(range(0, 5)) AS n) b ON o_orderkey % 5 = b.n) SELECT CAST(batch AS BIGINT) AS batch, count(*) AS total, count(*) FILTER (WHERE who % 4 = 1) AS mine FROM s GROUP BY 1""")
def batch_progress(spark, sf_dir):
    """Items of a batch, and those that I have reviewed."""
    items = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).alias("batch"), F.col("o_orderkey").alias("item"))
    mine = table(spark, sf_dir, "orders").filter("o_custkey % 4 = 1").select(F.col("o_orderkey").alias("item"), F.lit(1).alias("label"))
    return items.join(mine, "item", "left").groupBy("batch").agg(F.count("*").alias("total"), F.count("label").alias("mine"))


@query(f"""WITH RECURSIVE {SUBMISSIONS}, d AS (SELECT a.clip_id, CAST(a.visibility <> b.visibility AS INTEGER) + CAST(a.target <> b.target AS INTEGER) AS wrong FROM sub a JOIN sub b ON a.clip_id = b.clip_id AND a.reviewer = 1 AND b.reviewer = 2)
SELECT clip_id % 9 AS labeler, count(*) AS completed, CAST(sum(wrong) AS BIGINT) AS mismatches, CASE WHEN count(*) >= 50 THEN 'complete' WHEN count(*) > 0 THEN 'started' ELSE 'none' END AS status FROM d GROUP BY 1""")
def team_progress(spark, sf_dir):
    """Lessons a labeler has completed, and in how many compared fields they went wrong (counted inside a nested list)."""
    told = lambda f: F.struct(F.lit(f).alias("key"), F.when(F.col(f"s1.form.{f}") == F.col(f"s2.form.{f}"), "matched").otherwise("review").alias("group"))
    rows = pairs(spark, sf_dir).select((F.col("clip_id") % 9).alias("labeler"), F.size(F.filter(F.array(told("visibility"), told("target")), lambda d: d["group"] == "review")).alias("wrong"))
    out = rows.groupBy("labeler").agg(F.count("*").alias("completed"), F.sum("wrong").alias("mismatches"))
    return out.withColumn("status", F.when(F.col("completed") >= 50, "complete").when(F.col("completed") > 0, "started").otherwise("none"))


@query(f"""WITH {JOBS} SELECT count(*) AS n, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'leased') AS leased, min(lease_us - created_us) AS least_us, max(lease_us - created_us) AS most_us FROM jobs""")
def ledger_aggregate(spark, sf_dir):
    took = F.col("lease_us") - F.col("created_us")
    return jobs(spark, sf_dir).agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "queued", "leased")], F.min(took).alias("least_us"), F.max(took).alias("most_us"))


@query(f"""WITH {CLIPS}, c AS (SELECT DISTINCT camera_id FROM clips) SELECT camera_id, coalesce(n_name, CAST(camera_id AS VARCHAR)) AS name FROM c LEFT JOIN nation ON n_nationkey = camera_id AND camera_id % 2 = 0""")
def filter_options(spark, sf_dir):
    """Cameras that occur, by name; one without a name goes by its id."""
    names = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("camera_id"), "n_name")
    out = clips(spark, sf_dir).select("camera_id").distinct().join(names, "camera_id", "left")
    return out.select("camera_id", F.coalesce("n_name", F.col("camera_id").cast("string")).alias("name")).orderBy(F.asc_nulls_last("name"), "camera_id")


@query(f"""WITH {CLIPS} SELECT count(*) FILTER (WHERE k < 30) AS pending, count(*) FILTER (WHERE k BETWEEN 30 AND 69) AS labeled, count(*) FILTER (WHERE k >= 70) AS skipped FROM clips WHERE camera_id IN (1, 2, 3) AND has_motion""")
def tab_counts(spark, sf_dir):
    k = F.col("k")
    return clips(spark, sf_dir).filter(F.col("camera_id").isin(1, 2, 3) & F.col("has_motion")).agg(F.count_if(k < 30).alias("pending"), F.count_if(k.between(30, 69)).alias("labeled"), F.count_if(k >= 70).alias("skipped"))


@query(f"""WITH {ROWS}, q AS (SELECT CASE WHEN brightness_std < 3 THEN 'dark' WHEN saturation > 0.8 THEN 'glare' ELSE 'clear' END || CASE WHEN clip_id % 4 = 0 THEN '+ir' ELSE '' END AS tag, event_type = 'view' AS hit FROM f0)
SELECT tag, count(*) AS n, count(*) FILTER (WHERE hit) AS n_right, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) / count(*) AS accuracy FROM q GROUP BY 1""")
def quality_tag_accuracy(spark, sf_dir):
    tag = F.concat(F.when(F.col("brightness_std") < 3, "dark").when(F.col("saturation") > 0.8, "glare").otherwise("clear"), F.when(F.col("clip_id") % 4 == 0, "+ir").otherwise(""))
    out = features(spark, sf_dir, missing=False).groupBy(tag.alias("tag")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("n_right"))
    return out.withColumn("accuracy", F.col("n_right").cast("double") / F.col("n"))


@query(f"""WITH {PREDICTIONS}, g AS (SELECT clip_id FROM predictions GROUP BY 1 HAVING count(*) <> 2), a AS (SELECT count(*) AS asked, count(*) FILTER (WHERE line = 1) AS a, (SELECT count(*) FROM g) AS off FROM predictions)
SELECT off AS groups_not_of_two, a > 0 AND a = asked AS complete FROM a""")
def completeness_gate(spark, sf_dir):
    """How many groups break an invariant, and one flag that everything behind it waits for; one pass each."""
    groups = predictions(spark, sf_dir).groupBy("clip_id").agg(F.count("*").alias("n"), F.count_if(F.col("line") == 1).alias("a"))
    return groups.agg(F.count_if(F.col("n") != 2).alias("groups_not_of_two"), ((F.sum("a") > 0) & (F.sum("a") == F.sum("n"))).alias("complete"))
