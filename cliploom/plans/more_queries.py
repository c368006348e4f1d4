"""Queries on summaries, quotas, arrays and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, times
from ..operators import routing, selection, summaries
from ..sources.tables import clips, predictions, table
from .registry import CLIPS, PREDICTIONS, query


@query(f"""WITH {PREDICTIONS}, v AS (SELECT model, list_sort(list(price)) AS v FROM predictions GROUP BY 1)
SELECT model, len(v) AS n, v[CAST(floor((len(v) - 1) * 0.5) AS BIGINT) + 1] AS p50_low, v[CAST(floor((len(v) - 1) * 0.95) AS BIGINT) + 1] AS p95_low,
       v[CAST(round_even((len(v) - 1) * 0.95::DOUBLE, 0) AS BIGINT) + 1] AS p95_even FROM v""")
def index_percentiles(spark, sf_dir):
    return summaries.index_percentiles(predictions(spark, sf_dir), "price", "model")


@query(f"""WITH {CLIPS}, v AS (SELECT camera_id, list_sort(list(k)) AS v, count(*) AS n FROM clips GROUP BY 1),
q AS (SELECT *, greatest(1, least(1 * (n + 1) // 4, n - 1)) AS a, greatest(1, least(2 * (n + 1) // 4, n - 1)) AS b, greatest(1, least(3 * (n + 1) // 4, n - 1)) AS c FROM v)
SELECT camera_id, n, v[a] + (v[a + 1] - v[a]) * ((n + 1 - a * 4) / 4.0::DOUBLE) AS q1, v[b] + (v[b + 1] - v[b]) * ((2 * (n + 1) - b * 4) / 4.0::DOUBLE) AS q2, v[c] + (v[c + 1] - v[c]) * ((3 * (n + 1) - c * 4) / 4.0::DOUBLE) AS q3 FROM q""")
def exclusive_quartiles(spark, sf_dir):
    return summaries.exclusive_quartiles(clips(spark, sf_dir), "k", "camera_id")


@query(f"""WITH {CLIPS}, f AS (SELECT activity_day, us, k < 40 AS low FROM clips), i AS (SELECT *, row_number() OVER (PARTITION BY activity_day ORDER BY us) - row_number() OVER (PARTITION BY activity_day, low ORDER BY us) AS g FROM f),
r AS (SELECT activity_day, low, g, count(*) AS n FROM i GROUP BY 1, 2, 3)
SELECT CAST(activity_day AS VARCHAR) AS activity_day, coalesce(max(n) FILTER (WHERE low), 0) AS longest, coalesce(max(n) FILTER (WHERE low), 0) >= 8 AS stop FROM r GROUP BY activity_day""")
def resource_streaks(spark, sf_dir):
    rows = clips(spark, sf_dir).select(F.col("activity_day").cast("string").alias("activity_day"), "us", "k")
    return summaries.low_streaks(rows, "activity_day", "us", F.col("k") < 40, 8)


@query(f"""WITH {CLIPS} SELECT clip_id, count(*) OVER (PARTITION BY camera_id, activity_day ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND 1 PRECEDING) >= 1
  OR count(*) OVER (PARTITION BY camera_id, activity_day ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) >= 3 AS rejected FROM clips""")
def rate_limiter(spark, sf_dir):
    rows = clips(spark, sf_dir).select("clip_id", "us", F.struct("camera_id", "activity_day").alias("who"))
    return summaries.rate_limited(rows, "who", "us", {60: 1, 3600: 3}).select("clip_id", "rejected")


@query(f"""WITH {PREDICTIONS}, s AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE pred = truth) AS n_right, median(price) AS median_price, CAST(count(*) FILTER (WHERE pred = truth) AS DOUBLE) / count(*) AS accuracy FROM predictions GROUP BY 1)
SELECT *, accuracy - (SELECT accuracy FROM s WHERE model = 0) AS delta FROM s""")
def model_summary(spark, sf_dir):
    return summaries.model_summary(predictions(spark, sf_dir), 0)


@query(f"""WITH {CLIPS}, p AS (SELECT event_type, camera_id, count(*) AS c, count(DISTINCT us // 1800000000) AS e FROM clips GROUP BY 1, 2)
SELECT event_type, CAST(sum(c) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS episodes, max(c) AS largest, CAST(max(c) AS DOUBLE) / sum(c) AS top_share FROM p GROUP BY 1""")
def camera_diversity(spark, sf_dir):
    rows = clips(spark, sf_dir).select("event_type", "camera_id", F.floor(F.col("us") / (30 * times.MINUTE)).alias("slot"))
    return summaries.diversity(rows, "event_type", ["slot"], "camera_id")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN md5(text) END AS key FROM documents)
SELECT doc_id, key, CASE WHEN key IS NULL THEN 'missing' WHEN count(*) OVER (PARTITION BY key) = 1 THEN 'unique' ELSE 'duplicate' END AS kind FROM d""")
def unique_key_index(spark, sf_dir):
    return summaries.isolated_duplicates(table(spark, sf_dir, "documents"), F.when(F.col("doc_id") % 9 != 0, F.md5("text")), "doc_id")


@query(f"""WITH {PREDICTIONS} SELECT clip_id, count(*) AS n, CAST(count(DISTINCT (truth, pred)) AS INTEGER) AS kinds, count(DISTINCT (truth, pred)) = 1 AS consistent FROM predictions GROUP BY 1 HAVING count(*) >= 3""")
def repeat_consistency(spark, sf_dir):
    return summaries.repeat_consistency(predictions(spark, sf_dir), "clip_id", ["truth", "pred"], 3)


@query("SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS first, (SELECT count(DISTINCT doc_id) FROM labels) AS second, (SELECT count(DISTINCT doc_id) FROM documents JOIN labels USING (doc_id)) AS both")
def set_size_dashboard(spark, sf_dir):
    return summaries.set_sizes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


QUOTAS = f"""{CLIPS}, z AS (SELECT event_type, count(*) AS n FROM clips GROUP BY 1), w AS (SELECT sum(n) AS whole FROM z),
b AS (SELECT event_type, n, greatest(1, floor(n * 97 / whole)) AS f, n * 97 / whole - floor(n * 97 / whole) AS rest FROM z, w),
quotas AS (SELECT event_type, n, CAST(least(n, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, event_type) <= 97 - (SELECT sum(f) FROM b) THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM b)"""


def quotas_of(spark, sf_dir):
    sizes = clips(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    return selection.proportional_quota(sizes, "event_type", 97)


@query(f"WITH {QUOTAS} SELECT event_type, n, quota FROM quotas")
def proportional_quota(spark, sf_dir):
    return quotas_of(spark, sf_dir)


@query(f"""WITH {QUOTAS}, d AS (SELECT clip_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY sha256('quota|' || clip_id), clip_id) AS nth FROM clips)
SELECT clip_id, event_type, CAST(nth AS INTEGER) AS nth FROM d JOIN quotas USING (event_type) WHERE nth <= quota""")
def proportional_sample(spark, sf_dir):
    return selection.by_quota(clips(spark, sf_dir).select("clip_id", "event_type"), quotas_of(spark, sf_dir), "quota", "clip_id", "event_type").select("clip_id", "event_type", "nth")


@query(f"""WITH {CLIPS}, a AS (SELECT clip_id, 'error' AS "group" FROM clips WHERE event_type = 'error' ORDER BY us, clip_id LIMIT 20),
b AS (SELECT clip_id, 'high' AS "group" FROM clips WHERE k >= 90 AND clip_id NOT IN (SELECT clip_id FROM a) ORDER BY us, clip_id LIMIT 30),
c AS (SELECT clip_id, 'fill' AS "group" FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM a) AND clip_id NOT IN (SELECT clip_id FROM b) ORDER BY us, clip_id LIMIT 50)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def quota_cascade(spark, sf_dir):
    groups = [("error", F.col("event_type") == "error", 20), ("high", F.col("k") >= 90, 30), ("fill", F.lit(True), 50)]
    return selection.cascade(clips(spark, sf_dir).select("clip_id", "us", "event_type", "k"), groups, "us", "clip_id").select("clip_id", "group")


@query(f"""WITH {CLIPS}, n AS (SELECT DISTINCT CAST(activity_day AS VARCHAR) AS night, camera_id FROM clips), a AS (SELECT DISTINCT night, attempt FROM n, range(8) r(attempt)),
p AS (SELECT night, attempt, row_number() OVER (PARTITION BY attempt ORDER BY sha256('night|' || attempt || '|' || night), night) AS nth FROM a),
s AS (SELECT *, CASE WHEN nth <= 6 THEN 'dev' WHEN nth <= 12 THEN 'holdout' END AS side FROM p WHERE nth <= 12),
g AS (SELECT attempt FROM (SELECT attempt, side, count(DISTINCT s.night) AS c, count(DISTINCT camera_id) AS cams FROM s JOIN n USING (night) GROUP BY 1, 2) WHERE c = 6 AND cams >= 2 GROUP BY 1 HAVING count(*) = 2)
SELECT night, side, CAST(attempt AS INTEGER) AS attempt FROM s WHERE attempt = (SELECT min(attempt) FROM g)""")
def night_partition(spark, sf_dir):
    rows = clips(spark, sf_dir).select(F.col("activity_day").cast("string").alias("night"), "camera_id")
    return selection.night_split(rows, "night", "camera_id", 8, 6)


@query(f"""WITH RECURSIVE {CLIPS}, p AS (SELECT camera_id, activity_day, list({{'at': us, 'k': k}} ORDER BY k DESC, us) AS peaks FROM clips GROUP BY 1, 2),
g AS (SELECT camera_id, activity_day, peaks, 0 AS i, peaks[1:0] AS kept FROM p UNION ALL
  SELECT camera_id, activity_day, peaks, i + 1, CASE WHEN len(kept) < 5 AND len(list_filter(kept, lambda x: abs(x.at - peaks[i + 1].at) < 3600000000)) = 0 THEN list_append(kept, peaks[i + 1]) ELSE kept END FROM g WHERE i < len(peaks)),
d AS (SELECT camera_id, CAST(activity_day AS VARCHAR) AS activity_day, unnest(kept) AS x FROM g WHERE i = len(peaks))
SELECT camera_id, activity_day, x.at AS us, x.k AS k FROM d""")
def temporal_nms(spark, sf_dir):
    """Highest clips of a camera's day that lie an hour apart, five at most."""
    rows = clips(spark, sf_dir).select("camera_id", F.col("activity_day").cast("string").alias("activity_day"), "us", "k")
    return selection.thinned(rows, ["camera_id", "activity_day"], "us", "k", times.HOUR, 5)


@query("""WITH RECURSIVE t AS (SELECT conv_id, list({'at': CAST(turn AS DOUBLE), 'action': role} ORDER BY turn, role) AS mine,
  list({'at': CASE WHEN turn % 3 = 0 THEN turn + 1.5 ELSE turn + 0.5 END::DOUBLE, 'action': role} ORDER BY CASE WHEN turn % 3 = 0 THEN turn + 1.5 ELSE turn + 0.5 END, role) AS free FROM conversations GROUP BY 1),
g AS (SELECT conv_id, mine, free, 0 AS i, 0 AS hits FROM t UNION ALL
  SELECT conv_id, mine, CASE WHEN spot > 0 THEN free[:spot - 1] || free[spot + 1:] ELSE free END, i + 1, hits + CAST(spot > 0 AS INTEGER)
  FROM (SELECT *, coalesce(list_position(list_transform(free, lambda f: f.action = mine[i + 1].action AND abs(f.at - mine[i + 1].at) <= 1), true), 0) AS spot FROM g WHERE i < len(mine)))
SELECT conv_id, max(hits) AS hits, CAST(max(len(mine)) - max(hits) AS INTEGER) AS only_left, CAST(min(len(free)) AS INTEGER) AS only_right FROM g GROUP BY 1""")
def segment_matching(spark, sf_dir):
    """Turns of a conversation against the same with every third moved further."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("action"), F.col("turn").cast("double").alias("at"))
    moved = turns.withColumn("at", F.when(F.col("at") % 3 == 0, F.col("at") + 1.5).otherwise(F.col("at") + 0.5))
    return selection.matched(turns, moved, "conv_id", 1.0)


@query("""SELECT vec_id, array_to_string(list_filter([CASE WHEN label IS NULL THEN 'label' END, CASE WHEN len(embedding) <> 64 THEN 'length' END, CASE WHEN embedding[1] < 0 THEN 'first' END, CASE WHEN vec_id % 7 = 0 THEN 'id' END], lambda x: x IS NOT NULL), ',') AS issues FROM embeddings""")
def evidence_issues(spark, sf_dir):
    """Names of the checks that a row fails, in order."""
    bad = {"label": F.col("label").isNull(), "length": F.size("embedding") != 64, "first": F.get("embedding", 0) < 0, "id": F.col("vec_id") % 7 == 0}
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in bad.items()])), ",").alias("issues"))


@query("""WITH t AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY 1)
SELECT conv_id, CAST(len(r) AS INTEGER) AS n, CAST(len(list_distinct(r)) AS INTEGER) AS kinds, list_contains(r, 'system') AS has_system, array_to_string(list_sort(list_distinct(r)), ',') AS roles FROM t""")
def role_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    return rows.select("conv_id", F.size("r").alias("n"), F.size(F.array_distinct("r")).alias("kinds"), F.array_contains("r", "system").alias("has_system"), F.array_join(F.array_sort(F.array_distinct("r")), ",").alias("roles"))


@query(f"""WITH {CLIPS} SELECT clip_id, CASE WHEN k < 20 AND duration_sec < 10 THEN 'low_short' WHEN k >= 80 AND event_type = 'error' THEN 'high_error' WHEN media_key IS NULL THEN 'no_media' ELSE NULL END AS drop_reason,
  CAST(greatest(4, least(24, round_even(duration_sec / 5, 0))) AS INTEGER) AS frames, CAST(ceil(640.0 * (100 + k) / 750) AS INTEGER) AS tokens FROM clips""")
def drop_reasons(spark, sf_dir):
    """First reason to drop a clip, frames to sample and tokens of one."""
    reasons = {"low_short": (F.col("k") < 20) & (F.col("duration_sec") < 10), "high_error": (F.col("k") >= 80) & (F.col("event_type") == "error"), "no_media": F.col("media_key").isNull()}
    frames = F.greatest(F.lit(4), F.least(F.lit(24), F.bround(F.col("duration_sec") / 5))).cast("int")
    return clips(spark, sf_dir).select("clip_id", arrays.first_issue(reasons).alias("drop_reason"), frames.alias("frames"), F.ceil(F.lit(640.0) * (100 + F.col("k")) / 750).cast("int").alias("tokens"))


@query("""WITH b AS (SELECT vec_id, label, embedding[1] AS x, embedding[2] AS y FROM embeddings)
SELECT label, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM b WHERE x > -10 GROUP BY 1""")
def union_boxes(spark, sf_dir):
    x, y = F.get("embedding", 0), F.get("embedding", 1)
    rows = table(spark, sf_dir, "embeddings").select("label", x.alias("x"), y.alias("y")).filter("x > -10")
    return rows.groupBy("label").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT p_partkey AS part, c, r FROM part, (VALUES ('warm'), ('cold')) x(c), range(1, 4) y(r)), a AS (SELECT l_partkey AS part, CASE WHEN l_linestatus = 'O' THEN 'warm' ELSE 'cold' END AS c, l_linenumber AS r FROM lineitem)
SELECT count(*) AS expected, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.part = e.part AND a.c = e.c AND a.r = e.r)) AS missing FROM e""")
def expected_keys(spark, sf_dir):
    """Keys that a plan of runs asks for, and those without a result."""
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.explode(F.array(F.lit("warm"), F.lit("cold"))).alias("c")).withColumn("r", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    got = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), F.when(F.col("l_linestatus") == "O", "warm").otherwise("cold").alias("c"), F.col("l_linenumber").alias("r"), F.lit(1).alias("hit")).distinct()
    return asked.join(got, ["part", "c", "r"], "left").agg(F.count("*").alias("expected"), F.count_if(F.col("hit").isNull()).alias("missing"))
