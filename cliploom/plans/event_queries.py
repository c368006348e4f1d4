"""Queries on clips, events and their neighbourhoods."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..functions.hashing import digest
from ..operators import audit, events, features, graph, queues, summaries
from ..sources.tables import assessments, clips, exclusions, settings, table
from .registry import ACCOUNTED, ASSESSMENTS, CLIPS, EXCLUSIONS, SETTINGS, query

GAP = 300.0  # seconds between clips of one event, for ten dense cameras

def day():
    return F.col("activity_day").cast("string").alias("activity_day")



def accounted(spark, sf_dir):
    return events.account(clips(spark, sf_dir), exclusions(spark, sf_dir))


NUMBERED = f"""{ACCOUNTED}, num AS (
  SELECT *, sum(CASE WHEN kind = 'candidate' AND NOT coalesce(prev_kind = 'candidate' AND gap_us <= {int(GAP * 1e6)}, false) THEN 1 ELSE 0 END)
    OVER (PARTITION BY camera_id, activity_day ORDER BY us, clip_id) AS event_no FROM seq),
ev AS (
  SELECT camera_id, activity_day, event_no, count(*) AS n_clips, min(us) AS started_us, max(end_us) AS ended_us,
         string_agg(CAST(clip_id AS VARCHAR), chr(0) ORDER BY us, clip_id) AS members
  FROM num WHERE kind = 'candidate' GROUP BY 1, 2, 3)"""


@query(f"""WITH {NUMBERED}
SELECT camera_id, CAST(activity_day AS VARCHAR) AS activity_day, sha256(concat_ws(chr(0), 'events-v1', camera_id, activity_day, members)) AS event_id,
       n_clips, started_us, ended_us FROM ev""")
def event_groups(spark, sf_dir):
    return events.events(accounted(spark, sf_dir), GAP).select("camera_id", day(), "event_id", "n_clips", "started_us", "ended_us")


@query(f"""WITH {ACCOUNTED} SELECT CASE WHEN clip_id % 97 = 0 THEN 'blocked' ELSE kind END AS kind,
  CASE WHEN clip_id % 97 = 0 THEN 'formal_or_frozen_manifest' ELSE reason END AS reason, count(*) AS n FROM acc GROUP BY 1, 2""")
def accounting_kinds(spark, sf_dir):
    told = events.account(clips(spark, sf_dir), exclusions(spark, sf_dir), blocked=F.col("clip_id") % 97 == 0)
    return told.groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {NUMBERED}, m AS (SELECT camera_id, activity_day, event_no, clip_id FROM num WHERE kind = 'candidate')
SELECT 'duplicate' AS code, (SELECT count(*) FROM (SELECT clip_id FROM clips GROUP BY 1 HAVING count(*) > 1 UNION SELECT clip_id FROM acc GROUP BY 1 HAVING count(*) > 1)) AS n
UNION ALL SELECT 'source_mismatch', (SELECT count(*) FROM (SELECT clip_id FROM clips) c FULL JOIN (SELECT clip_id FROM acc) a ON c.clip_id = a.clip_id WHERE c.clip_id IS NULL OR a.clip_id IS NULL)
UNION ALL SELECT 'protected_in_event', (SELECT count(DISTINCT m.clip_id) FROM m JOIN acc USING (clip_id) WHERE kind <> 'candidate')
UNION ALL SELECT 'crosses_camera_or_day', (SELECT count(DISTINCT m.clip_id) FROM m JOIN acc a USING (clip_id) WHERE a.camera_id <> m.camera_id OR a.activity_day <> m.activity_day)
UNION ALL SELECT 'event_coverage', (SELECT count(*) FROM acc WHERE kind = 'candidate' AND (SELECT count(*) FROM m WHERE m.clip_id = acc.clip_id) <> 1)""")
def accounting_integrity(spark, sf_dir):
    told = accounted(spark, sf_dir)
    return events.accounting_issues(clips(spark, sf_dir), told, events.numbered_events(told, GAP))


PAIRS = f"""{ACCOUNTED}, pairs AS (
  SELECT camera_id, activity_day, prev_clip AS left_clip, clip_id AS right_clip, us AS right_us, gap_us,
         CASE WHEN gap_us / 1e6 <= 30 THEN 'short' WHEN gap_us / 1e6 <= 60 THEN 'medium' ELSE 'long' END AS gap_bin,
         sha256('pair-v1|' || prev_clip || '|' || clip_id) AS pair_id
  FROM seq WHERE kind = 'candidate' AND prev_kind = 'candidate' AND gap_us <= 300000000)"""


@query(f"WITH {PAIRS} SELECT camera_id, CAST(activity_day AS VARCHAR) AS activity_day, left_clip, right_clip, gap_us, gap_bin, pair_id FROM pairs")
def adjacent_pairs(spark, sf_dir):
    return events.adjacent_pairs(accounted(spark, sf_dir)).select("camera_id", day(), "left_clip", "right_clip", "gap_us", "gap_bin", "pair_id")


@query(f"""WITH {PAIRS}, u AS (
  SELECT *, CASE WHEN lag(right_clip) OVER (PARTITION BY camera_id, activity_day ORDER BY right_us, right_clip) = left_clip THEN 0 ELSE 1 END AS s
  FROM pairs WHERE gap_us >= 0),
n AS (SELECT *, sum(s) OVER (PARTITION BY camera_id, activity_day ORDER BY right_us, right_clip) AS chain_no FROM u)
SELECT camera_id, CAST(activity_day AS VARCHAR) AS activity_day, CAST(chain_no AS BIGINT) AS chain_no, count(*) AS n_pairs, min(gap_us) AS least_gap_us, max(gap_us) AS most_gap_us
FROM n GROUP BY ALL""")
def pair_runs(spark, sf_dir):
    return events.chains(events.adjacent_pairs(accounted(spark, sf_dir))).select("camera_id", day(), "chain_no", "n_pairs", "least_gap_us", "most_gap_us")


THRESHOLDS = [-600.0, 0.0, 30.0, 60.0, 120.0, 240.0]


@query(f"""WITH {PAIRS}, j AS (
  SELECT gap_us / 1e6 AS gap_sec, CASE WHEN right_clip % 5 = 0 THEN 'uncertain' WHEN gap_us < (right_clip % 7) * 40000000 THEN 'same' ELSE 'different' END AS decision FROM pairs)
SELECT threshold, count(*) FILTER (WHERE gap_sec <= threshold AND decision = 'different') AS over_merge, count(*) FILTER (WHERE decision = 'different') AS n_different,
       count(*) FILTER (WHERE gap_sec > threshold AND decision = 'same') AS over_split, count(*) FILTER (WHERE decision = 'same') AS n_same,
       coalesce(threshold = arg_min(threshold, CASE WHEN count(*) FILTER (WHERE gap_sec <= threshold AND decision = 'different') = 0
         THEN [count(*) FILTER (WHERE gap_sec > threshold AND decision = 'same'), threshold] END) OVER (), false) AS chosen
FROM j, (VALUES (-600.0::DOUBLE), (0.0), (30.0), (60.0), (120.0), (240.0)) t(threshold) WHERE decision <> 'uncertain' GROUP BY threshold""")
def event_group_threshold_sweep(spark, sf_dir):
    decision = F.when(F.col("right_clip") % 5 == 0, "uncertain").when(F.col("gap_us") < (F.col("right_clip") % 7) * 40_000_000, "same").otherwise("different")
    judged = events.adjacent_pairs(accounted(spark, sf_dir)).select((F.col("gap_us") / 1e6).alias("gap_sec"), decision.alias("decision"))
    return events.threshold_sweep(judged, THRESHOLDS)


EFFECTIVE = f"""{CLIPS}, {ASSESSMENTS}, {SETTINGS}, eff AS (
  SELECT c.clip_id, c.camera_id, c.us, c.duration_sec, coalesce(a.decision, 'pending') AS decision,
         CASE WHEN coalesce(s.enabled AND ((a.decision = 'absent' AND s.exclude_absent) OR (a.decision = 'static' AND s.exclude_static)), false) THEN 0.0::DOUBLE
              ELSE c.duration_sec END AS effective_sec
  FROM clips c LEFT JOIN settings s USING (camera_id) LEFT JOIN assessments a ON a.clip_id = c.clip_id AND a.policy_version = s.active_policy)"""


@query(f"WITH {EFFECTIVE} SELECT * FROM eff")
def effective_activity(spark, sf_dir):
    return queues.effective_activity(clips(spark, sf_dir), assessments(spark, sf_dir), settings(spark, sf_dir))


@query(f"""WITH {EFFECTIVE} SELECT camera_id, us // 3600000000 AS hour_no, count(*) AS n, CAST(sum(CAST(effective_sec AS DECIMAL(18, 4))) AS DOUBLE) AS seconds
FROM eff GROUP BY 1, 2""")
def effective_activity_hourly(spark, sf_dir):
    out = queues.effective_activity(clips(spark, sf_dir), assessments(spark, sf_dir), settings(spark, sf_dir))
    hour = F.floor(F.col("us") / times.HOUR).alias("hour_no")
    return out.groupBy("camera_id", hour).agg(F.count("*").alias("n"), F.sum(F.col("effective_sec").cast("decimal(18,4)")).cast("double").alias("seconds"))


@query(f"""WITH {CLIPS} SELECT clip_id, camera_id, count(*) OVER (PARTITION BY camera_id ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND 1 PRECEDING) AS n_10m,
  count(*) OVER (PARTITION BY camera_id ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND 1 PRECEDING) AS n_30m,
  count(*) OVER (PARTITION BY camera_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS n_60m FROM clips""")
def range_window_counts(spark, sf_dir):
    return features.trailing_counts(clips(spark, sf_dir))


@query(f"""WITH {CLIPS}, d AS (SELECT clip_id, camera_id, us - lag(us) OVER w AS s, lead(us) OVER w - us AS u FROM clips WINDOW w AS (PARTITION BY camera_id ORDER BY us, clip_id))
SELECT clip_id, camera_id, CASE WHEN s <= 3600000000 THEN s END AS since_us, CASE WHEN u <= 3600000000 THEN u END AS until_us FROM d""")
def neighbour_gaps(spark, sf_dir):
    return features.neighbour_seconds(clips(spark, sf_dir))


@query(f"""WITH {CLIPS}, p AS (
  SELECT a.clip_id, a.duration_sec, CAST(b.duration_sec AS DECIMAL(18, 4)) AS v, row_number() OVER (PARTITION BY a.clip_id ORDER BY b.us DESC, b.clip_id DESC) AS nth
  FROM clips a LEFT JOIN clips b ON a.camera_id = b.camera_id AND b.us BETWEEN a.us - 3600000000 AND a.us - 1),
m AS (SELECT clip_id, any_value(duration_sec) AS d, CASE WHEN count(v) > 0 THEN CAST(sum(v) AS DOUBLE) / count(v) ELSE 0.0::DOUBLE END AS baseline FROM p WHERE nth <= 20 GROUP BY clip_id)
SELECT clip_id, baseline, d - baseline AS delta FROM m""")
def trailing_baseline(spark, sf_dir):
    return features.trailing_baseline(clips(spark, sf_dir), "duration_sec")


@query(f"""WITH {CLIPS}, r AS (
  SELECT clip_id, activity_day, rank() OVER (PARTITION BY activity_day ORDER BY k) - 1 AS low, count(*) OVER (PARTITION BY activity_day, k) AS ties,
         count(*) OVER (PARTITION BY activity_day) AS n FROM clips)
SELECT clip_id, CASE WHEN n = 1 THEN 0.5::DOUBLE ELSE (low + (ties - 1) / 2) / (n - 1) END AS pct FROM r""")
def avg_rank_percentile(spark, sf_dir):
    return features.average_ranks(clips(spark, sf_dir).select("clip_id", "activity_day", "k"), "k", ["activity_day"]).select("clip_id", "pct")


@query(f"""WITH {CLIPS}, r AS (
  SELECT clip_id, camera_id, k, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, hour(ts + INTERVAL 9 HOUR) // 2 AS bucket FROM clips),
c AS (SELECT *, row_number() OVER (PARTITION BY camera_id, day, bucket ORDER BY k DESC, clip_id) AS nth FROM r)
SELECT clip_id, camera_id, k, day, bucket FROM c WHERE nth <= 4 ORDER BY k DESC, clip_id LIMIT 100""")
def topk_bucket_cap(spark, sf_dir):
    rows = clips(spark, sf_dir).select("clip_id", "camera_id", "k", times.seoul_day(F.col("started_at")).cast("string").alias("day"), times.two_hour_bucket(F.col("started_at")).alias("bucket"))
    return queues.capped_top(rows, ["camera_id", "day", "bucket"], 4, 100, F.desc("k"), F.col("clip_id")).drop("nth")


@query(f"""WITH {CLIPS}, t AS (SELECT clip_id, strftime(ts + INTERVAL 9 HOUR, '%H:%M') AS clock FROM clips) SELECT clip_id, clock FROM t WHERE clock >= '22:00' OR clock <= '06:00'""")
def time_of_day_wrap(spark, sf_dir):
    rows = clips(spark, sf_dir).withColumn("clock", times.seoul_clock(F.col("started_at")))
    return rows.filter(times.clock_between(F.col("clock"), "22:00", "06:00")).select("clip_id", "clock")


@query("SELECT count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08') AS half_open, count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-08') AS closed FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-08'")
def half_open_window(spark, sf_dir):
    lo, hi = (F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz") for d in (5, 8))
    rows = table(spark, sf_dir, "events").filter((F.col("ts") >= lo) & (F.col("ts") <= hi))
    return rows.agg(F.count_if((F.col("ts") >= lo) & (F.col("ts") < hi)).alias("half_open"), F.count_if(F.col("ts").between(lo, hi)).alias("closed"))


@query(f"""WITH {CLIPS}, {EXCLUSIONS} SELECT clip_id, CAST(floor(duration_sec + 0.5) AS INTEGER) AS shown FROM clips LEFT JOIN exclusions USING (clip_id)
WHERE duration_sec < 20 AND (state IS NULL OR state = 'candidate') ORDER BY us, clip_id LIMIT 50""")
def short_clip_candidates(spark, sf_dir):
    rows = clips(spark, sf_dir).filter(F.col("duration_sec") < 20).join(exclusions(spark, sf_dir), "clip_id", "left").filter("state IS NULL OR state = 'candidate'")
    return rows.orderBy("us", "clip_id").limit(50).select("clip_id", times.displayed_seconds(F.col("duration_sec")).alias("shown"))


@query(f"""WITH {CLIPS}, h AS (SELECT camera_id, us // 3600000000 AS hour_no, count(*) AS n FROM clips GROUP BY 1, 2)
SELECT camera_id, count(*) AS hours, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.95) AS p95, max(n) AS most FROM h GROUP BY 1""")
def active_hour_influx(spark, sf_dir):
    hours = clips(spark, sf_dir).groupBy("camera_id", F.floor(F.col("us") / times.HOUR).alias("hour_no")).agg(F.count("*").alias("n"))
    told = summaries.interpolated(hours, "n", ["camera_id"], {"p50": 0.5, "p95": 0.95}).withColumnRenamed("n", "hours")
    return told.join(hours.groupBy("camera_id").agg(F.max("n").alias("most")), "camera_id")


@query(f"""WITH {CLIPS}, {ASSESSMENTS}, o AS (
  SELECT c.camera_id, c.activity_day, c.clip_id, CAST(a.clip_id IS NOT NULL AS INTEGER) AS e, CAST(a.clip_id IS NOT NULL AND media_key IS NOT NULL AS INTEGER) AS c FROM clips c LEFT JOIN assessments a USING (clip_id))
SELECT camera_id, CAST(activity_day AS VARCHAR) AS activity_day, CAST(grouping(camera_id, activity_day) AS BIGINT) AS level, count(*) AS eligible, CAST(sum(e) AS BIGINT) AS with_evidence, CAST(sum(c) AS BIGINT) AS n_complete,
       CAST(sum(c) AS DOUBLE) / count(*) AS complete_ratio
FROM o GROUP BY GROUPING SETS ((camera_id, activity_day), (camera_id), ())""")
def coverage_grouping_sets(spark, sf_dir):
    a = assessments(spark, sf_dir).select("clip_id", F.lit(True).alias("assessed"))
    rows = clips(spark, sf_dir).join(a, "clip_id", "left")
    rows = rows.withColumn("evidence", F.col("assessed").isNotNull()).withColumn("complete", F.col("assessed").isNotNull() & F.col("media_key").isNotNull())
    return audit.coverage(rows).withColumn("activity_day", F.col("activity_day").cast("string"))


@query(f"""WITH {CLIPS}, p AS (SELECT *, row_number() OVER (PARTITION BY camera_id, activity_day, us // 300000000 ORDER BY sha256('near|' || clip_id), clip_id) AS nth FROM clips)
SELECT camera_id, CAST(activity_day AS VARCHAR) AS activity_day, clip_id, us // 300000000 AS slot FROM p WHERE nth = 1""")
def near_dup_bucket_winner(spark, sf_dir):
    from ..operators.sampling import bucket_winner

    rows = clips(spark, sf_dir).select("camera_id", "activity_day", "clip_id", F.floor(F.col("us") / (5 * times.MINUTE)).alias("slot"))
    return bucket_winner(rows, "near", "clip_id", ["camera_id", "activity_day", "slot"]).select("camera_id", day(), "clip_id", "slot")


@query(f"""WITH {CLIPS}, o AS (SELECT o_orderkey AS object_id, epoch_us(TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 97 % 2592000)) AS at_us FROM orders)
SELECT object_id, CAST(least(count(*), 20) AS INTEGER) AS n_near FROM o JOIN clips ON us BETWEEN at_us - 600000000 AND at_us + 600000000 GROUP BY object_id""")
def band_join_counts(spark, sf_dir):
    """Clips within ten minutes of an object, 20 at most, by running counts along ten-minute buckets."""
    start = F.lit(1_704_067_200_000_000)
    objects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("object_id"), (start + F.col("o_orderkey") * 97 % 2_592_000 * 1_000_000).alias("us"))
    near = features.near_counts(objects, clips(spark, sf_dir).select("us"), "us", 10 * times.MINUTE)
    return near.groupBy("object_id").agg(F.least(F.sum("n_near"), F.lit(20)).cast("int").alias("n_near"))


@query(f"""WITH {CLIPS}, r AS (SELECT o_orderkey AS run_id, o_orderkey % 10 AS camera_id, epoch_us(TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 97 % 2592000)) AS run_us FROM orders)
SELECT run_id, max(us) AS last_us, count(*) AS n_before FROM r JOIN clips c ON c.camera_id = r.camera_id AND us <= run_us GROUP BY run_id""")
def asof_availability(spark, sf_dir):
    """The last clip of the run's camera up to the run, and how many there are, however long before."""
    start = F.lit(1_704_067_200_000_000)
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 10).alias("camera_id"), (start + F.col("o_orderkey") * 97 % 2_592_000 * 1_000_000).alias("us"))
    return features.as_of(runs, clips(spark, sf_dir).select("camera_id", "us"), "camera_id", "us").filter("n_before > 0").select("run_id", "last_us", "n_before")


@query("SELECT vec_id, CAST(sum(s) AS INTEGER) AS n_bursts, CAST(coalesce(max(len), 0) AS INTEGER) AS longest FROM (SELECT vec_id, len, CASE WHEN f THEN 1 ELSE 0 END AS s FROM (SELECT vec_id, f, CASE WHEN f THEN count(*) END AS len FROM (SELECT vec_id, f, i - row_number() OVER (PARTITION BY vec_id, f ORDER BY i) AS g FROM (SELECT vec_id, unnest(embedding) > 0.0 AS f, generate_subscripts(embedding, 1) AS i FROM embeddings)) GROUP BY vec_id, f, g)) GROUP BY vec_id")
def burst_stats(spark, sf_dir):
    return features.burst_stats(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.0)


@query("WITH f AS (SELECT vec_id, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0.1) AS p FROM embeddings) SELECT vec_id, CAST(p[1] AS INTEGER) AS first_at, CAST(p[-1] AS INTEGER) AS last_at FROM f")
def active_span(spark, sf_dir):
    return features.active_span(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.1)


@query("""WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT vec_id, len(v) AS n, len(v) - 2 * len(v) // 3 AS n_late, CAST(list_sum(v) AS DOUBLE) AS whole, CAST(list_sum(v[2 * len(v) // 3 + 1:]) AS DOUBLE) AS late FROM m)
SELECT vec_id, CAST(n AS INTEGER) AS n, CAST(n_late AS INTEGER) AS n_late, CASE WHEN whole = 0 THEN 0.0::DOUBLE ELSE (late / n_late) / (whole / n) END AS ratio FROM s""")
def late_third(spark, sf_dir):
    return features.late_ratio(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", "n", "n_late", "ratio")


@query(f"""WITH RECURSIVE {PAIRS}, same AS (SELECT left_clip AS a, right_clip AS b FROM pairs WHERE right_clip % 5 <> 0 AND gap_us < (right_clip % 7) * 40000000),
n AS (SELECT a AS x, b AS y FROM same UNION SELECT b, a FROM same), reach AS (SELECT x, x AS y FROM n UNION SELECT reach.x, n.y FROM reach JOIN n ON reach.y = n.x),
c AS (SELECT x AS clip_id, min(y) AS event FROM reach GROUP BY 1)
SELECT clip_id, event, count(*) OVER (PARTITION BY event) AS n_clips FROM c""")
def connected_events(spark, sf_dir):
    """Clips joined by pairs that reviewers call one event: components of any graph of such pairs."""
    judged = events.adjacent_pairs(accounted(spark, sf_dir)).filter((F.col("right_clip") % 5 != 0) & (F.col("gap_us") < (F.col("right_clip") % 7) * 40_000_000))
    found = graph.components(judged.select(F.col("left_clip").alias("a"), F.col("right_clip").alias("b"))).select(F.col("node").alias("clip_id"), F.col("component").alias("event"))
    return found.join(found.groupBy("event").agg(F.count("*").alias("n_clips")), "event")


@query(f"""WITH RECURSIVE {PAIRS}, same AS (SELECT left_clip AS a, right_clip AS b FROM pairs WHERE right_clip % 5 <> 0), n AS (SELECT a AS x, b AS y FROM same UNION SELECT b, a FROM same),
reach AS (SELECT x, x AS y FROM n UNION SELECT reach.x, n.y FROM reach JOIN n ON reach.y = n.x WHERE n.y < reach.x), d AS (SELECT clip, count(*) AS k FROM (SELECT left_clip AS clip FROM pairs UNION ALL SELECT right_clip FROM pairs) GROUP BY 1),
l AS (SELECT count(*) AS n_clips, max(k) AS most_pairs FROM d), s AS (SELECT count(*) AS saved FROM (SELECT x FROM reach GROUP BY 1 HAVING min(y) <> x))
SELECT n_clips, n_clips - saved AS n_events, saved / n_clips AS reduction, most_pairs, false AS branching FROM l, s""")
def event_reduction(spark, sf_dir):
    """How many clips, how many events once neighbours that are one event are joined, and the share saved."""
    pairs = events.adjacent_pairs(accounted(spark, sf_dir))
    return graph.event_summary(pairs.select("left_clip", "right_clip", (F.col("right_clip") % 5 != 0).alias("same")))


@query(f"""WITH {CLIPS} SELECT clip_id, sha256('clip|' || camera_id || '|' || activity_day || '|' || coalesce(media_key, '-')) AS fingerprint, substr(sha256('clip|' || clip_id), 1, 8) AS short FROM clips""")
def clip_fingerprints(spark, sf_dir):
    key = F.coalesce("media_key", F.lit("-"))
    return clips(spark, sf_dir).select("clip_id", digest("clip", F.col("camera_id"), F.col("activity_day"), key).alias("fingerprint"), F.substring(digest("clip", F.col("clip_id")), 1, 8).alias("short"))
