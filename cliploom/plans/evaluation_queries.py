"""Queries on scores, reviews, series and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ratios import ratio
from ..operators import evaluation, features, shapes
from ..sources.tables import assessments, clips, jobs, predictions, table
from .registry import ASSESSMENTS, CLIPS, JOBS, PREDICTIONS, query


def right():
    return F.col("pred") == F.col("truth")


@query(f"""WITH {PREDICTIONS}, t AS (SELECT s, s / 10.0::DOUBLE AS threshold FROM range(11) r(s)),
c AS (SELECT threshold, CAST(count(*) FILTER (WHERE conf >= threshold AND truth = 'R') AS BIGINT) AS tp, count(*) FILTER (WHERE conf >= threshold AND truth <> 'R') AS fp, count(*) FILTER (WHERE conf < threshold AND truth = 'R') AS fn FROM t, predictions GROUP BY 1)
SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / (tp + fn) END AS recall FROM c""")
def threshold_audit_curve(spark, sf_dir):
    return evaluation.threshold_curve(predictions(spark, sf_dir), F.col("truth") == "R", F.col("conf"))


@query(f"""WITH {PREDICTIONS}, c AS (SELECT model, truth, count(*) AS n, count(*) FILTER (WHERE pred = truth) AS r FROM predictions GROUP BY 1, 2)
SELECT m.model, k.class, coalesce(n, 0) AS n, CASE WHEN n IS NOT NULL THEN r / n::DOUBLE END AS recall FROM (SELECT DISTINCT model FROM c) m CROSS JOIN (VALUES ('A'), ('N'), ('R'), ('X')) k(class) LEFT JOIN c ON c.model = m.model AND c.truth = k.class""")
def version_class_recall(spark, sf_dir):
    return evaluation.recall_matrix(predictions(spark, sf_dir), "model", "truth", right(), ["A", "N", "R", "X"])


@query(f"""WITH {PREDICTIONS}, d AS (SELECT 'all' AS name, truth, pred FROM predictions UNION ALL SELECT 'without_a', truth, pred FROM predictions WHERE truth <> 'A' UNION ALL SELECT 'only_n', truth, pred FROM predictions WHERE truth NOT IN ('A', 'R'))
SELECT name, count(*) AS n, count(*) FILTER (WHERE truth = pred) AS n_right, count(*) FILTER (WHERE truth = pred)::DOUBLE / count(*) AS accuracy FROM d GROUP BY 1""")
def changing_denominators(spark, sf_dir):
    return evaluation.accuracy_without(predictions(spark, sf_dir), "truth", right(), {"all": [], "without_a": ["A"], "only_n": ["A", "R"]})


@query(f"""WITH {PREDICTIONS}, v AS (SELECT clip_id, pred, count(*) AS n, min(line) AS first FROM predictions GROUP BY 1, 2),
w AS (SELECT clip_id, pred, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, first, pred) AS r, sum(n) OVER (PARTITION BY clip_id) AS total, count(*) OVER (PARTITION BY clip_id) AS kinds FROM v),
t AS (SELECT clip_id, truth FROM predictions QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY line, truth) = 1)
SELECT count(*) AS n, count(*) FILTER (WHERE kinds = 1) AS n_unanimous, count(*) FILTER (WHERE kinds = 1 AND pred = truth) AS unanimous_right, count(*) FILTER (WHERE pred = truth) AS majority_right FROM w JOIN t USING (clip_id) WHERE r = 1 AND total >= 3""")
def unanimity_majority(spark, sf_dir):
    return evaluation.unanimity(predictions(spark, sf_dir), "clip_id", "line", "pred", "truth")


@query(f"""WITH {PREDICTIONS}, o AS (SELECT clip_id, line, max(truth) AS truth, max(pred) AS pred FROM predictions GROUP BY 1, 2),
p AS (SELECT a.truth AS t1, b.truth AS t2, a.pred AS p1, b.pred AS p2 FROM o a JOIN o b USING (clip_id) WHERE a.line = 1 AND b.line = 2),
d AS (SELECT 'truth' AS dimension, t1 AS a, t2 AS b FROM p UNION ALL SELECT 'pred', p1, p2 FROM p),
c AS (SELECT dimension, count(*) AS pairs, count(*) FILTER (WHERE a <> 'N' AND b <> 'N') AS evaluable, count(*) FILTER (WHERE a <> 'N' AND b <> 'N' AND a = b) AS agreements FROM d GROUP BY 1)
SELECT *, CASE WHEN evaluable = 0 THEN 0.0::DOUBLE ELSE agreements::DOUBLE / evaluable END AS rate FROM c""")
def agreement_by_dimension(spark, sf_dir):
    return evaluation.agreement(predictions(spark, sf_dir), "clip_id", "line", (1, 2), ["truth", "pred"], "N")


SETTLED = f"""{PREDICTIONS}, s AS (SELECT clip_id, max(pred) FILTER (WHERE line = 1) AS a, max(pred) FILTER (WHERE line = 2) AS b, max(pred) FILTER (WHERE line = 3) AS o FROM predictions GROUP BY 1),
settled AS (SELECT clip_id, CASE WHEN a IS NULL OR b IS NULL THEN 'awaiting' WHEN a = b AND a <> 'N' THEN 'agreed' WHEN o IS NULL THEN 'conflict' ELSE 'resolved' END AS state,
  CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b AND a <> 'N' THEN a ELSE o END AS final FROM s)"""


def settled(spark, sf_dir):
    return evaluation.settled(predictions(spark, sf_dir), "clip_id", "line", "pred", "N")


@query(f"WITH {SETTLED} SELECT state, final, count(*) AS n FROM settled GROUP BY 1, 2")
def consensus_states(spark, sf_dir):
    return settled(spark, sf_dir).groupBy("state", "final").agg(F.count("*").alias("n"))


@query(f"""WITH {SETTLED}, q AS (SELECT final = 'A' AS t, p.truth = 'A' AS y FROM settled JOIN (SELECT clip_id, truth FROM predictions WHERE line = 1) p USING (clip_id) WHERE final IS NOT NULL),
n AS (SELECT count(*) FILTER (WHERE t AND y) AS tp, count(*) FILTER (WHERE NOT t AND y) AS fp, count(*) FILTER (WHERE t AND NOT y) AS fn, count(*) FILTER (WHERE NOT t AND NOT y) AS tn FROM q),
w AS (SELECT *, (tp + fn)::DOUBLE AS m, tp::DOUBLE / (tp + fn) AS recall, 1.959963984540054::DOUBLE AS z FROM n)
SELECT tp, fp, fn, tn, recall, greatest(0.0::DOUBLE, (recall + z * z / (2 * m)) / (1 + z * z / m) - z * sqrt(recall * (1 - recall) / m + z * z / (4 * m * m)) / (1 + z * z / m)) AS recall_low,
  least(1.0::DOUBLE, (recall + z * z / (2 * m)) / (1 + z * z / m) + z * sqrt(recall * (1 - recall) / m + z * z / (4 * m * m)) / (1 + z * z / m)) AS recall_high FROM w""")
def boundary_scores(spark, sf_dir):
    first = predictions(spark, sf_dir).filter("line = 1").select("clip_id", "truth")
    rows = settled(spark, sf_dir).filter(F.col("final").isNotNull()).join(first, "clip_id")
    return evaluation.binary_score(rows, F.col("final") == "A", F.col("truth") == "A")


@query(f"""WITH {CLIPS}, {ASSESSMENTS}, c AS (SELECT decision, count(*) AS n, count(*) FILTER (WHERE has_motion) AS n_active FROM clips JOIN assessments USING (clip_id) GROUP BY 1)
SELECT *, (n - n_active)::DOUBLE / n AS "precision" FROM c""")
def filter_precision(spark, sf_dir):
    rows = clips(spark, sf_dir).select("clip_id", "has_motion").join(assessments(spark, sf_dir), "clip_id")
    return evaluation.exclusion_precision(rows, "decision", F.col("has_motion"))


@query(f"""WITH {PREDICTIONS} SELECT truth || ' -> ' || pred AS mistake, CASE WHEN conf >= 0.7::DOUBLE THEN 'label_suspect' WHEN quantity < 10 AND conf < 0.6::DOUBLE THEN 'sheet_limit' ELSE 'rest' END AS triage, count(*) AS n FROM predictions WHERE truth <> pred GROUP BY 1, 2""")
def error_triage(spark, sf_dir):
    triage = F.when(F.col("conf") >= 0.7, "label_suspect").when((F.col("quantity") < 10) & (F.col("conf") < 0.6), "sheet_limit").otherwise("rest")
    return predictions(spark, sf_dir).filter(~right()).groupBy(F.concat_ws(" -> ", "truth", "pred").alias("mistake"), triage.alias("triage")).agg(F.count("*").alias("n"))


@query(f"""WITH {CLIPS}, r AS (SELECT CASE WHEN k >= 60 THEN 'cloud_now' WHEN k >= 30 THEN 'review' ELSE 'cloud_later' END AS route, event_type FROM clips),
c AS (SELECT route, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_urgent FROM r GROUP BY 1)
SELECT *, n_urgent::DOUBLE / n AS urgent_rate, route = 'cloud_later' AND n_urgent > 0 AS leaks FROM c""")
def route_leakage(spark, sf_dir):
    """Urgent clips by route; any on the late route is a leak."""
    route = F.when(F.col("k") >= 60, "cloud_now").when(F.col("k") >= 30, "review").otherwise("cloud_later")
    cells = clips(spark, sf_dir).groupBy(route.alias("route")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("n_urgent"))
    return cells.withColumns({"urgent_rate": ratio(F.col("n_urgent"), F.col("n")), "leaks": (F.col("route") == "cloud_later") & (F.col("n_urgent") > 0)})


@query(f"WITH {CLIPS} SELECT CAST(activity_day AS VARCHAR) AS activity_day, count(*) AS n, count(media_key) AS n_media FROM clips GROUP BY 1 ORDER BY n DESC, activity_day LIMIT 20")
def busiest_days(spark, sf_dir):
    """The twenty days with most clips."""
    days = clips(spark, sf_dir).groupBy(F.col("activity_day").cast("string").alias("activity_day")).agg(F.count("*").alias("n"), F.count("media_key").alias("n_media"))
    return days.orderBy(F.desc("n"), "activity_day").limit(20)


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i, list_max(embedding)::DOUBLE AS peak FROM embeddings),
f AS (SELECT vec_id, i, peak > 0 AND x / peak < 0.3::DOUBLE AS low FROM e), g AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM f WHERE low),
r AS (SELECT vec_id, min(i) AS start, count(*) AS n FROM g GROUP BY vec_id, g), b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, start) = 1)
SELECT vec_id, CAST(start AS INTEGER) AS start, CAST(coalesce(n, 0) AS INTEGER) AS length FROM embeddings LEFT JOIN b USING (vec_id)""")
def settle_run(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", shapes.longest_below(F.col("embedding"), 0.3).alias("r")).select("vec_id", "r.start", "r.length")


@query(f"""WITH {CLIPS} SELECT clip_id, CASE WHEN k <= 0 THEN '' WHEN k <= 5 THEN array_to_string(range(k), ',') ELSE array_to_string(list_transform(range(5), lambda i: CASE WHEN i = 4 THEN k - 1 ELSE CAST(trunc(i * ((k - 1) / 4.0::DOUBLE)) AS BIGINT) END), ',') END AS places FROM clips WHERE k IS NOT NULL""")
def even_frames(spark, sf_dir):
    rows = clips(spark, sf_dir).filter(F.col("k").isNotNull())
    return rows.select("clip_id", F.array_join(shapes.even_indices(F.col("k"), 5).cast("array<string>"), ",").alias("places"))


@query("""WITH t AS (SELECT vec_id, list_transform(range(16), lambda i: list_max(embedding[i * 4 + 1:i * 4 + 4])::DOUBLE) AS t FROM embeddings)
SELECT vec_id, array_to_string(list_transform(t, lambda x: CASE WHEN list_max(t) = list_min(t) THEN 0 ELSE CAST(floor((x - list_min(t)) / (list_max(t) - list_min(t)) * 7) AS BIGINT) END), '') AS line FROM t""")
def spark_line(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", shapes.levels(F.col("embedding"), 4).alias("line"))


@query(f"""WITH {CLIPS}, r AS (SELECT clip_id, row_number() OVER (PARTITION BY camera_id, activity_day ORDER BY k, clip_id) AS nth, count(*) OVER (PARTITION BY camera_id, activity_day) AS n FROM clips WHERE k IS NOT NULL)
SELECT clip_id, CASE WHEN 2 * nth <= n + 1 THEN 2 * nth - 1 ELSE 2 * (n - nth + 1) END AS place FROM r""")
def low_high_interleave(spark, sf_dir):
    rows = clips(spark, sf_dir).filter(F.col("k").isNotNull()).select("clip_id", "camera_id", "activity_day", "k")
    return shapes.low_high(rows, ["camera_id", "activity_day"], "k", "clip_id").select("clip_id", "place")


@query(f"WITH {JOBS} SELECT job_id, lease_us FROM jobs WHERE status = 'done' AND attempt <> 3 AND lease_us <= 820454400000000 ORDER BY lease_us, job_id LIMIT 50")
def retention_due(spark, sf_dir):
    """The next batch of finished jobs past their date, oldest first; those with a holder (attempt 3) are left."""
    due = (F.col("status") == "done") & (F.col("attempt") != 3) & (F.col("lease_us") <= 820_454_400_000_000)
    return jobs(spark, sf_dir).filter(due).orderBy("lease_us", "job_id").limit(50).select("job_id", "lease_us")


def _rank_sql(value: str) -> str:
    part = f"PARTITION BY camera_id, activity_day, {value} IS NOT NULL"
    n = f"count(*) OVER ({part})"
    return f"CASE WHEN {value} IS NULL THEN 0.0::DOUBLE WHEN {n} = 1 THEN 0.5::DOUBLE ELSE (rank() OVER ({part} ORDER BY {value}) - 1 + (count(*) OVER ({part}, {value}) - 1) / 2.0::DOUBLE) / ({n} - 1) END"


@query(f"""WITH {CLIPS}, v AS (SELECT clip_id, camera_id, activity_day, k, CASE WHEN has_motion THEN duration_sec END AS d, us % 1000 AS f FROM clips),
r AS (SELECT clip_id, {_rank_sql('k')} AS a, {_rank_sql('d')} AS b, {_rank_sql('f')} AS c FROM v) SELECT clip_id, (a + b + c) / 3 AS score FROM r""")
def composite_score(spark, sf_dir):
    """Mean of three ranks in a camera's day; a missing part counts as 0."""
    rows = clips(spark, sf_dir).select("clip_id", "camera_id", "activity_day", "k", F.when(F.col("has_motion"), F.col("duration_sec")).alias("d"), (F.col("us") % 1000).alias("f"))
    parts = {name: F.coalesce(features.average_rank(F.col(v), ["camera_id", "activity_day"]), F.lit(0.0)) for name, v in {"a": "k", "b": "d", "c": "f"}.items()}
    return rows.withColumns(parts).select("clip_id", ((F.col("a") + F.col("b") + F.col("c")) / 3).alias("score"))
