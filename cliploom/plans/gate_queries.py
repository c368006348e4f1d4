"""Queries on decisions: router ladders, filter switches, capacity, resources, variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates, queues, routing
from ..sources.tables import assessments, clips, features, predictions, table
from .metric_queries import TWO, two_models
from .registry import ASSESSMENTS, CLIPS, PREDICTIONS, query
from .routing_queries import CARE, GT, GUARDED

SUMS = f"""{GUARDED}, gg AS (SELECT event_type IN ('click', 'error') AS urgent, motion_mean, route, candidate_route FROM rich),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE route = 'cloud_later') AS later, count(*) FILTER (WHERE route = 'cloud_now') / count(*) AS now_rate, count(*) FILTER (WHERE route = 'activity_only') / count(*) AS only_rate,
  count(*) FILTER (WHERE urgent AND route = 'activity_only') / count(*) FILTER (WHERE urgent) AS leak, count(*) FILTER (WHERE candidate_route = 'cloud_now') / count(*) AS now1,
  count(*) FILTER (WHERE urgent AND candidate_route = 'activity_only') / count(*) FILTER (WHERE urgent) AS leak1, count(*) FILTER (WHERE urgent AND motion_mean < 0.005) / count(*) FILTER (WHERE motion_mean < 0.005) AS still FROM gg)"""


def sums(spark, sf_dir):
    rows = routing.enriched(features(spark, sf_dir)).withColumn("urgent", F.col("event_type").isin(CARE))
    still = rows.filter("motion_mean < 0.005").agg((F.count_if("urgent") / F.count("*")).alias("static_p0_rate"))
    return rows, gates.route_summary(rows, "baseline_route", F.col("urgent"), "l0"), gates.route_summary(rows, "candidate_route", F.col("urgent"), "l1"), still


@query(f"""WITH {SUMS} SELECT leak AS l0_leak_rate, now_rate AS l0_cloud_now_rate, only_rate AS l0_activity_only_rate, leak1 AS l1_leak_rate, now1 AS l1_cloud_now_rate, still AS static_p0_rate,
  CASE WHEN leak > 0.02 OR leak1 > 0.02 THEN 'reject-unsafe' WHEN still > 0.05 AND only_rate > 0 THEN 'hold-input-limited' WHEN now1 >= 0.9 AND now_rate <= 0.7411167512690355 AND later > 0 THEN 'hold-model-limited'
    WHEN now_rate > 0.55 THEN 'hold-policy-too-conservative' ELSE 'adopt-v1' END AS subtype FROM s""")
def router_decision(spark, sf_dir):
    """The ladder of reasons for a router and the guard behind it."""
    _, first, second, still = sums(spark, sf_dir)
    return gates.router_decision(first, second, still)


@query(f"""WITH {SUMS}, {CLIPS.replace("clips AS", "all_clips AS")}, m AS (SELECT CAST(sum(CAST(floor(duration_sec * 10) AS BIGINT)) AS DOUBLE) / count(*) AS avg_latency_ms, count(*) FILTER (WHERE duration_sec IS NULL) = 0 AS done FROM all_clips)
SELECT n AS l0_n, later AS l0_later, now_rate AS l0_cloud_now_rate, only_rate AS l0_activity_only_rate, leak AS l0_leak_rate, avg_latency_ms, done AS finished,
  CASE WHEN leak >= 0.05 THEN 'reject' WHEN now_rate <= 0.4 AND leak <= 0.02 AND avg_latency_ms <= 3000 AND done THEN 'adopt' ELSE 'hold' END AS label FROM s, m""")
def router_label(spark, sf_dir):
    """adopt, hold or reject by leaks, calls made at once and latency."""
    _, first, _, _ = sums(spark, sf_dir)
    latency = clips(spark, sf_dir).agg((F.sum(F.floor(F.col("duration_sec") * 10)).cast("double") / F.count("*")).alias("avg_latency_ms"), (F.count_if(F.col("duration_sec").isNull()) == 0).alias("finished"))
    return gates.router_label(first, latency, F.col("finished"))


JUDGED = f"""{CLIPS}, {ASSESSMENTS}, j AS (SELECT clip_id, CASE decision WHEN 'active' THEN 'active' ELSE 'exclude_' || decision END AS told,
  CASE WHEN k % 10 = 3 THEN NULL WHEN decision = 'static' AND k % 16 = 0 THEN 'active' WHEN decision = 'active' AND k % 6 = 0 THEN 'static' ELSE decision END AS human FROM clips JOIN assessments USING (clip_id))"""


@query(f"""WITH {JUDGED}, a AS (SELECT count(*) FILTER (WHERE human = 'active') AS active, count(*) FILTER (WHERE human = 'active' AND told = 'active') AS kept FROM j WHERE human IS NOT NULL),
e AS (SELECT switch, count(*) FILTER (WHERE told = switch) AS n_excluded, count(*) FILTER (WHERE told = switch AND human = 'active') AS false_exclusions, count(*) FILTER (WHERE told = switch AND human = meant) AS n_right
  FROM j, (VALUES ('exclude_absent', 'absent'), ('exclude_static', 'static')) s(switch, meant) WHERE human IS NOT NULL GROUP BY 1)
SELECT switch, n_excluded, false_exclusions, n_right / n_excluded AS "precision", kept / active AS active_recall, false_exclusions = 0 AND n_right / n_excluded >= 0.9 AS adopt FROM e, a""")
def filter_adoption(spark, sf_dir):
    """Whether each switch of the activity filter may be turned on."""
    k, decision = F.col("k"), F.col("decision")
    human = F.when(k % 10 == 3, None).when((decision == "static") & (k % 16 == 0), "active").when((decision == "active") & (k % 6 == 0), "static").otherwise(decision)
    told = F.when(decision == "active", "active").otherwise(F.concat(F.lit("exclude_"), decision))
    return gates.filter_adoption(clips(spark, sf_dir).join(assessments(spark, sf_dir), "clip_id").select(told.alias("told"), human.alias("human")), "told", "human")


@query(f"""WITH {CLIPS}, h AS (SELECT count(*) AS n FROM clips GROUP BY us // 3600000000), p AS (SELECT quantile_cont(n, 0.95) AS inflow FROM h),
c AS (SELECT 3600 / quantile_cont(duration_sec, 0.95) AS capacity, max(clip_id % 4000) * 1000 AS peak_rss, max(clip_id % 900) * 1000 AS peak_disk FROM clips)
SELECT capacity, inflow * 2 AS required, CASE WHEN inflow > 0 THEN capacity / inflow ELSE 'inf'::DOUBLE END AS throughput_ratio, capacity >= inflow * 2 AS throughput_pass, peak_rss, peak_rss <= 3000000 AS rss_pass, peak_disk, peak_disk <= 1000000 AS disk_pass,
  capacity >= inflow * 2 AND peak_rss <= 3000000 AND peak_disk <= 1000000 AS all_pass FROM c, p""")
def capacity_gates(spark, sf_dir):
    """Capacity from the 95th percentile against twice the inflow, memory and disk against their limits."""
    c = clips(spark, sf_dir)
    calls = c.select(F.col("duration_sec").alias("seconds"), (F.col("clip_id") % 4000 * 1000).alias("rss_bytes"), (F.col("clip_id") % 900 * 1000).alias("temp_bytes"))
    arrivals = c.groupBy(F.floor(F.col("us") / 3_600_000_000).alias("hour")).agg(F.count("*").alias("n"))
    return gates.capacity_gates(calls, arrivals, 3_000_000, 1_000_000)


@query(f"""WITH {CLIPS}, r AS (SELECT CAST(activity_day AS VARCHAR) AS run, us, k % 40 AS free_percent, clip_id * 7 % 5000 AS swap_bytes, CASE WHEN camera_id = 9 AND k > 60 THEN 2 ELSE 1 END AS pid, clip_id * 13 % 9000 AS rss_kib FROM clips),
i AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY us) - row_number() OVER (PARTITION BY run, free_percent <= 5 ORDER BY us) AS g FROM r), l AS (SELECT run, max(n) AS low_streak FROM (SELECT run, g, count(*) AS n FROM i WHERE free_percent <= 5 GROUP BY 1, 2) GROUP BY 1)
SELECT run, min(free_percent) AS free_min, max(swap_bytes) - arg_min(swap_bytes, us) AS swap_delta, max(rss_kib) AS rss_max, bool_or(pid <> p0) AS pid_drift, coalesce(max(low_streak), 0) AS low_streak, coalesce(max(low_streak), 0) >= 2 AS low_free_abort
FROM (SELECT *, first_value(pid) OVER (PARTITION BY run ORDER BY us) AS p0 FROM r) LEFT JOIN l USING (run) GROUP BY run""")
def resource_summary(spark, sf_dir):
    """Resources of each day's run: least free, growth of swap since the first sample, largest memory, change of process, streaks."""
    n, k = F.col("clip_id"), F.col("k")
    rows = clips(spark, sf_dir).select(
        F.col("activity_day").cast("string").alias("run"), "us", (k % 40).alias("free_percent"), (n * 7 % 5000).alias("swap_bytes"),
        F.when((F.col("camera_id") == 9) & (k > 60), 2).otherwise(1).alias("pid"), (n * 13 % 9000).alias("rss_kib"),
    )
    return gates.resource_summary(rows, "run", "us")


CALLS = f"""{PREDICTIONS}, calls AS (SELECT model, CASE WHEN model = 3 OR line % 2 = 0 THEN 'v41' ELSE 'v40' END AS prompt, ['frames-adaptive', 'contact-sheet', 'tiles'][clip_id % 3 + 1] AS shape, quantity > 2 AS ok, truth, pred,
  CASE WHEN quantity > 5 THEN CAST(quantity AS BIGINT) * (clip_id % 3 + 1) END AS tokens_in, CASE WHEN quantity > 8 THEN CAST(quantity AS BIGINT) END AS tokens_out, CAST(floor(price) AS BIGINT) AS wall_ms FROM predictions),
v AS (SELECT model, prompt, shape, count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE ok AND pred = truth) AS n_right, count(*) FILTER (WHERE ok AND replace(pred, 'N', 'A') = replace(truth, 'N', 'A')) AS merged_right,
  CAST(sum(tokens_in) FILTER (WHERE ok) AS BIGINT) / count(tokens_in) FILTER (WHERE ok) AS avg_tokens_in, CAST(sum(tokens_out) FILTER (WHERE ok) AS BIGINT) / count(tokens_out) FILTER (WHERE ok) AS avg_tokens_out,
  CAST(sum(wall_ms) FILTER (WHERE ok) AS BIGINT) / count(wall_ms) FILTER (WHERE ok) AS avg_wall_ms, quantile_cont(wall_ms, 0.5) FILTER (WHERE ok) AS median_wall_ms, count(*) FILTER (WHERE NOT ok) AS errors FROM calls GROUP BY 1, 2, 3)"""


def calls(spark, sf_dir):
    q, third = F.col("quantity").cast("long"), F.col("clip_id") % 3
    return predictions(spark, sf_dir).select(
        "model", F.when((F.col("model") == 3) | (F.col("line") % 2 == 0), "v41").otherwise("v40").alias("prompt"), F.get(F.array(*[F.lit(x) for x in ("frames-adaptive", "contact-sheet", "tiles")]), third.cast("int")).alias("shape"),
        (F.col("quantity") > 2).alias("ok"), "truth", "pred", F.when(F.col("quantity") > 5, q * (third + 1)).alias("tokens_in"), F.when(F.col("quantity") > 8, q).alias("tokens_out"), F.floor("price").alias("wall_ms"),
    )


@query(f"""WITH {CALLS} SELECT model, prompt, shape, n, n_right, n_right / n AS accuracy, merged_right / n AS merged_accuracy, avg_tokens_in, avg_tokens_out, avg_wall_ms, median_wall_ms, errors FROM v WHERE n > 0""")
def variant_costs(spark, sf_dir):
    """Accuracy, tokens and wall time of each model, prompt and representation."""
    return gates.variants(calls(spark, sf_dir), {"N": "A"})


@query(f"""WITH {CALLS}, b AS (SELECT model, prompt AS base_prompt, n_right / n AS acc, avg_tokens_in AS tok, avg_wall_ms AS wall FROM v WHERE shape = 'frames-adaptive' AND n > 0 QUALIFY row_number() OVER (PARTITION BY model ORDER BY prompt <> 'v40', prompt) = 1)
SELECT model, prompt, shape, base_prompt, CASE WHEN tok <> 0 THEN 1 - avg_tokens_in / tok END AS token_reduction, (acc - n_right / n) * 100 AS accuracy_drop_pp, avg_wall_ms - wall AS wall_delta_ms FROM v JOIN b USING (model) WHERE n > 0 AND NOT (prompt = base_prompt AND shape = 'frames-adaptive')""")
def variant_deltas(spark, sf_dir):
    """Each variant against its model's baseline."""
    return gates.against_baseline(gates.variants(calls(spark, sf_dir), {"N": "A"}), "v40", "frames-adaptive")


@query(f"""WITH {GUARDED} SELECT clip_id, {GT} AS gt, row_number() OVER (PARTITION BY {GT} ORDER BY clip_id) AS nth FROM rich WHERE {GT} IN ('click', 'error') AND route = 'cloud_now' AND candidate_route = 'cloud_later'""")
def lowered_clips(spark, sf_dir):
    """Clips of the care classes that the guard moved from now to later, in order."""
    gt = F.when(F.col("event_type") == "view", "moving").otherwise(F.col("event_type"))
    return routing.lowered(routing.enriched(features(spark, sf_dir)).withColumn("gt", gt), CARE)


@query(f"""WITH {GUARDED}, i AS (SELECT clip_id, clip_id % 3 = 0 AS inspect, route, candidate_route, clip_id % 97 = 5 AS known FROM rich),
s AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT inspect AND route = 'cloud_now') AS before, count(*) FILTER (WHERE NOT inspect AND candidate_route = 'cloud_now') AS after, count(*) FILTER (WHERE inspect) AS n_inspect,
  count(*) FILTER (WHERE inspect AND candidate_route = 'activity_only') AS inspect_activity_only, count(*) FILTER (WHERE inspect AND candidate_route = 'cloud_later') AS inspect_low, count(*) FILTER (WHERE known AND candidate_route NOT IN ('cloud_now', 'review_candidate')) AS n_regressed FROM i)
SELECT *, CASE WHEN before = 0 THEN 0.0 ELSE (before - after) / before END AS reduction_rate, n_regressed = 0 AS regression_pass FROM s""")
def inspection_summary(spark, sf_dir):
    """The guard on operational rows: calls saved where nobody inspects, what happens to those to inspect, and whether known
    regressions still get looked at."""
    rows = routing.enriched(features(spark, sf_dir))
    return routing.inspection_summary(rows, F.col("clip_id") % 3 == 0, F.col("clip_id") % 97 == 5)


@query(f"""WITH {PREDICTIONS}, {TWO}, f AS (SELECT base AS before, strong AS after FROM two WHERE truth = 'N'), r AS (SELECT truth, CASE WHEN clip_id % 19 <> 0 THEN base END AS before, CASE WHEN clip_id % 23 <> 0 THEN strong END AS after FROM two WHERE truth <> 'N'),
x AS (SELECT count(*) FILTER (WHERE before = 'R') AS alarms_before, count(*) FILTER (WHERE after = 'R') AS alarms_after, count(*) FILTER (WHERE before = 'R' AND after = 'N') AS recovered, count(*) FILTER (WHERE before = 'N' AND after = 'R') AS broken, count(*) FILTER (WHERE after = 'A') AS new_errors FROM f),
g AS (SELECT *, CASE WHEN truth IN ('A', 'N') THEN before IN ('A', 'N') ELSE before = truth END AS rb, CASE WHEN truth IN ('A', 'N') THEN after IN ('A', 'N') ELSE after = truth END AS ra, before IS NOT NULL AND after IS NOT NULL AS told FROM r),
y AS (SELECT count(*) AS n, count(*) FILTER (WHERE before = truth) AS right_before, count(*) FILTER (WHERE after = truth) AS right_after, count(*) FILTER (WHERE truth = 'R' AND before = 'R' AND after IS DISTINCT FROM 'R') AS lost,
  count(*) FILTER (WHERE told AND NOT rb AND ra) AS merged_recovered, count(*) FILTER (WHERE told AND rb AND NOT ra) AS merged_broken, count(*) FILTER (WHERE told AND after <> before AND rb AND ra AND truth IN ('A', 'N')) AS harmless FROM g),
z AS (SELECT *, (alarms_before - alarms_after) / alarms_before AS suppression, (right_after - right_before) * 100 / n AS change_pp FROM x, y),
d AS (SELECT *, suppression >= 0.6 AND broken = 0 AND new_errors <= 2 AS ok_a, lost <= 2 AND merged_recovered >= merged_broken AND change_pp >= -3 AS ok_b FROM z)
SELECT *, CASE WHEN ok_a AND ok_b THEN 'adopt' WHEN suppression < 0.3 OR broken > 0 OR lost >= 5 OR change_pp < -3 THEN 'reject' ELSE 'hold' END AS decision FROM d""")
def prompt_decision(spark, sf_dir):
    """A prompt that is to stop false alarms: what it stops, what it costs elsewhere, and the decision."""
    two = two_models(spark, sf_dir)
    false_rows = two.filter("truth = 'N'").select(F.col("base").alias("before"), F.col("strong").alias("after"))
    n = F.col("clip_id")
    regression = two.filter("truth <> 'N'").select("truth", F.when(n % 19 != 0, F.col("base")).alias("before"), F.when(n % 23 != 0, F.col("strong")).alias("after"))
    return gates.prompt_decision(false_rows, regression, "R", "N", ["A"], ["A", "N"])


@query("""WITH e AS (SELECT lang AS class, count(*) AS expected FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), n AS (SELECT lang AS class, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) GROUP BY 1)
SELECT coalesce(n.class, e.class) AS class, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(n, 0) = coalesce(expected, 0) AS agrees FROM n FULL JOIN e ON n.class IS NOT DISTINCT FROM e.class""")
def class_distribution(spark, sf_dir):
    """Languages of the labelled documents against those of every second document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    expected = docs.filter("doc_id % 2 = 0").groupBy(F.col("lang").alias("class")).agg(F.count("*").alias("expected"))
    return gates.class_distribution(docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), expected, "lang")


@query(f"""WITH {PREDICTIONS}, r AS (SELECT clip_id, CAST(floor(price / 20000) AS BIGINT) AS created, sample_id * 4 + model AS seen, pred, quantity FROM predictions)
SELECT clip_id, created, seen FROM r QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY created DESC, seen) = 1""")
def latest_runs(spark, sf_dir):
    """The latest run of each clip; of runs with one time the one that was seen first."""
    runs = predictions(spark, sf_dir).select("clip_id", F.floor(F.col("price") / 20000).alias("created"), (F.col("sample_id") * 4 + F.col("model")).alias("seen"))
    return queues.latest_seen(runs, "clip_id", "created", "seen")
