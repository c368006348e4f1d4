"""Queries on sinks, sources and scans, and on filters of listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, evaluation, queues, selection
from ..sources import files
from ..sources.reviews import SUBMISSIONS
from ..sources.tables import assessments, clips, exclusions, predictions, settings, table
from .event_queries import PAIRS, accounted
from .queue_queries import LOGS, logs
from ..sources.paged import PagedSource
from .registry import ASSESSMENTS, CLIPS, EXCLUSIONS, PREDICTIONS, SETTINGS, query
from .review_queries import pairs as review_pairs


@query(f"""WITH {CLIPS}, m AS (SELECT s_nationkey % 10 AS source_camera_id, 1000 + s_suppkey AS mirror_camera_id, s_suppkey % 6 AS mirror_user_id FROM supplier), p AS (SELECT 1000 + c_custkey AS camera_id, c_nationkey AS pet_id FROM customer WHERE c_custkey % 2 = 0)
SELECT m.mirror_camera_id AS camera_id, m.mirror_user_id AS user_id, p.pet_id, us, media_key FROM clips c JOIN m ON c.camera_id = source_camera_id LEFT JOIN p ON p.camera_id = mirror_camera_id""")
def mirrored_clips(spark, sf_dir):
    mirrors = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 10).alias("source_camera_id"), (F.col("s_suppkey") + 1000).alias("mirror_camera_id"), (F.col("s_suppkey") % 6).alias("mirror_user_id"))
    cameras = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select((F.col("c_custkey") + 1000).alias("camera_id"), F.col("c_nationkey").alias("pet_id"))
    return files.mirrored(clips(spark, sf_dir).select("clip_id", "camera_id", "us", "media_key"), mirrors, cameras)


@query(f"""WITH {CLIPS}, {PREDICTIONS}, p AS (SELECT clip_id, max(truth) AS truth, max(pred) AS pred FROM predictions GROUP BY 1),
n AS (SELECT c.clip_id // 3 AS clip_id, truth || '__' || pred || '__' || substr(CAST(c.clip_id // 3 AS VARCHAR), 1, 8) || '.mp4' AS name FROM clips c JOIN p USING (clip_id) WHERE media_key IS NOT NULL)
SELECT clip_id, name, count(*) OVER (PARTITION BY name) > 1 AS collides FROM n""")
def dataset_names(spark, sf_dir):
    told = predictions(spark, sf_dir).groupBy("clip_id").agg(F.max("truth").alias("truth"), F.max("pred").alias("pred"))
    rows = clips(spark, sf_dir).filter("media_key IS NOT NULL").select("clip_id", "media_key").join(told, "clip_id").withColumn("clip_id", F.floor(F.col("clip_id") / 3))
    return files.dataset_names(rows)


@query(f"""WITH {CLIPS}, {LOGS}, {ASSESSMENTS}, m AS (SELECT o_orderkey AS clip_id, CASE WHEN o_custkey % 2 = 0 THEN 'moving' ELSE 'feeding' END AS truth FROM orders), l AS (SELECT clip_id, CASE WHEN decision = 'active' THEN 'moving' ELSE 'feeding' END AS action FROM assessments WHERE policy_version = 'v1')
SELECT m.clip_id, truth, CASE WHEN l.action = truth THEN 'labelled' WHEN l.action IS NOT NULL THEN 'labelled_otherwise' WHEN c.clip_id IS NULL THEN 'missing_clip' ELSE 'insertable' END AS plan, coalesce(logs.action <> truth, false) AS old_differs
FROM m LEFT JOIN l USING (clip_id) LEFT JOIN clips c USING (clip_id) LEFT JOIN logs USING (clip_id)""")
def backfill_plan(spark, sf_dir):
    manifest = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), F.when(F.col("o_custkey") % 2 == 0, "moving").otherwise("feeding").alias("truth"))
    labels = assessments(spark, sf_dir).filter("policy_version = 'v1'").select("clip_id", F.when(F.col("decision") == "active", "moving").otherwise("feeding").alias("action"))
    return files.backfill_plan(manifest, labels, clips(spark, sf_dir), logs(spark, sf_dir), ["moving", "feeding"])


@query(f"""WITH {CLIPS} SELECT CAST(clip_id AS VARCHAR) AS clip_id, CASE WHEN k % 4 = 0 THEN '' ELSE printf('%.3f', k / 128.0::DOUBLE) END AS motion_ratio FROM clips""")
def derived_columns(spark, sf_dir):
    rows = clips(spark, sf_dir).select("clip_id", F.when(F.col("k") % 4 != 0, F.col("k") / 128.0).alias("motion_ratio"))
    return files.formatted(rows, {"clip_id": "", "motion_ratio": "%.3f"})


@query("""WITH r AS (SELECT event_id, ' c' || event_id || ' ' AS clip_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE CAST(event_id % 50 AS VARCHAR) END AS mean, CASE event_id % 5 WHEN 0 THEN ' ' ELSE CAST(event_id % 9 AS VARCHAR) END AS bursts, CASE event_id % 3 WHEN 0 THEN '' ELSE 'low' END AS reliability, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE '0.5' END AS priority FROM events)
SELECT trim(clip_id) AS clip_id, TRY_CAST(nullif(mean, '') AS DOUBLE) AS mean, TRY_CAST(nullif(trim(bursts), '') AS INTEGER) AS bursts, nullif(reliability, '') AS reliability, coalesce(TRY_CAST(nullif(priority, '') AS DOUBLE), 0.0) AS priority FROM r""")
def typed_payloads(spark, sf_dir):
    n = F.col("event_id")
    text = lambda c: c.cast("string")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit(" c"), text(n), F.lit(" ")).alias("clip_id"),
        F.when(n % 4 == 0, "").when(n % 4 == 1, "n/a").otherwise(text(n % 50)).alias("mean"),
        F.when(n % 5 == 0, " ").otherwise(text(n % 9)).alias("bursts"),
        F.when(n % 3 == 0, "").otherwise("low").alias("reliability"),
        F.when(n % 6 == 0, "").when(n % 6 == 1, "x").otherwise("0.5").alias("priority"),
    )
    return files.typed_payload(rows, ["clip_id"], ["mean"], ["bursts"], ["reliability"], "priority")


@query("SELECT event_id, user_id FROM events WHERE event_id IN (SELECT o_custkey * 3 FROM orders)")
def looked_up_rows(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).alias("event_id"))
    return files.looked_up(table(spark, sf_dir, "events"), ids, "event_id").select("event_id", "user_id")


def paged(spark, sf_dir, mode, name, columns, key, schema):
    """A table read in pages through an SQL client, as a remote database is."""
    spark.dataSource.register(PagedSource)
    options = {"client": "cliploom.sources.paged:SqlPages", "driver": "duckdb", "table": f"read_parquet('{sf_dir}/{name}.parquet')", "columns": columns, "key": key, "mode": mode, "page": 2000, "parts": 4}
    return spark.read.format("paged").schema(schema).options(**options).load()


@query("SELECT event_id, user_id FROM events")
def scanned_by_key(spark, sf_dir):
    """A table by ranges of its key, each in pages after the last key seen."""
    return paged(spark, sf_dir, "key", "events", "event_id, user_id", "event_id", "event_id long, user_id long")


@query("SELECT o_orderkey, o_custkey FROM orders")
def scanned_by_offset(spark, sf_dir):
    """A table by slices of its rows in order of the key, each in pages by offset."""
    return paged(spark, sf_dir, "offset", "orders", "o_orderkey, o_custkey", "o_orderkey", "o_orderkey long, o_custkey long")


@query("SELECT l_orderkey AS key, l_linenumber AS run FROM lineitem WHERE l_linenumber > 5 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey % 4 <> 0)")
def keys_to_run(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").filter("l_linenumber > 5").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("run"))
    c = F.col("o_custkey")
    ledger = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (c % 3 == 0).alias("warmup"), F.when(c % 4 == 0, "failed").alias("error"))
    return files.to_run(keys, ledger, ["key"])


@query(f"""WITH {CLIPS} SELECT clip_id, us FROM clips WHERE camera_id = 3 AND has_motion AND us >= 1704200000000000 AND us <= 1706200000000000 AND event_type IN ('view', 'click') ORDER BY us DESC, clip_id DESC LIMIT 41""")
def filtered_clips(spark, sf_dir):
    """All filters of a listing, each of which may be left out; a text of names, cut at commas."""
    return queues.listed(clips(spark, sf_dir), camera_id=3, has_motion=True, from_us=1_704_200_000_000_000, to_us=1_706_200_000_000_000, types=queues.names_of(" view, ,click,"), n=40).select("clip_id", "us")


@query(f"""WITH {CLIPS} SELECT clip_id, us FROM clips WHERE us < 1705500000000000 ORDER BY us DESC, clip_id DESC LIMIT 26""")
def seek_page(spark, sf_dir):
    return queues.listed(clips(spark, sf_dir), before_us=1_705_500_000_000_000, n=25).select("clip_id", "us")


@query(f"""WITH {CLIPS}, {EXCLUSIONS}, {LOGS}, p AS (SELECT clip_id, us, 0 AS class FROM clips WHERE k < 2 AND media_key IS NOT NULL AND clip_id NOT IN (SELECT clip_id FROM logs)), s AS (SELECT clip_id, us, 1 AS class FROM clips WHERE event_type = 'error' AND k > 50 AND clip_id NOT IN (SELECT clip_id FROM p))
SELECT clip_id, us, class FROM (SELECT * FROM p UNION ALL SELECT * FROM s) ORDER BY class, us, clip_id LIMIT 60""")
def pending_with_top_up(spark, sf_dir):
    """Oldest pending clips; where they are too few, stale ones that are being worked on."""
    c = clips(spark, sf_dir)
    fresh = c.filter("k < 2 AND media_key IS NOT NULL").join(logs(spark, sf_dir), "clip_id", "left_anti").select("clip_id", "us", F.lit(0).alias("class"))
    stale = c.filter("event_type = 'error' AND k > 50").join(fresh.select("clip_id"), "clip_id", "left_anti").select("clip_id", "us", F.lit(1).alias("class"))
    return fresh.unionByName(stale).orderBy("class", "us", "clip_id").limit(60)


@query(f"""WITH {CLIPS}, {EXCLUSIONS}, {LOGS} SELECT clip_id, us FROM clips WHERE camera_id % 3 = 1 AND clip_id NOT IN (SELECT clip_id FROM exclusions WHERE state IN ('quarantined', 'media_deleted')) AND clip_id NOT IN (SELECT clip_id FROM logs) ORDER BY us DESC, clip_id DESC LIMIT 31""")
def filled_page(spark, sf_dir):
    """A page that is full whatever the filters take away: they come before the limit. Owners see their own cameras only."""
    mine = clips(spark, sf_dir).filter("camera_id % 3 = 1")
    return queues.page(queues.visible(mine, exclusions(spark, sf_dir)).join(logs(spark, sf_dir), "clip_id", "left_anti"), "us", "clip_id", None, 30).select("clip_id", "us")


@query(f"""WITH {CLIPS}, {ASSESSMENTS}, {SETTINGS}, a AS (SELECT c.clip_id, c.camera_id % 3 AS owner_id, s.active_policy, a.decision, s.enabled, s.exclude_absent, s.exclude_static, c.duration_sec FROM clips c LEFT JOIN settings s USING (camera_id) LEFT JOIN assessments a ON a.clip_id = c.clip_id AND a.policy_version = s.active_policy)
SELECT clip_id, owner_id, active_policy AS policy_version, decision IS NULL AS analysis_pending, CASE WHEN coalesce(enabled AND ((decision = 'absent' AND exclude_absent) OR (decision = 'static' AND exclude_static)), false) THEN 0.0::DOUBLE ELSE duration_sec END AS effective_sec FROM a""")
def owner_activity(spark, sf_dir):
    out = queues.effective_activity(clips(spark, sf_dir), assessments(spark, sf_dir), settings(spark, sf_dir), carry=["active_policy"])
    return out.select("clip_id", (F.col("camera_id") % 3).alias("owner_id"), F.col("active_policy").alias("policy_version"), (F.col("decision") == "pending").alias("analysis_pending"), "effective_sec")


@query(f"""WITH {CLIPS}, {EXCLUSIONS}, {LOGS} SELECT clip_id, CAST(floor(duration_sec + 0.5) AS INTEGER) AS shown, state = 'candidate' AS known, clip_id IN (SELECT clip_id FROM logs) AS protected, 20.0::DOUBLE AS candidate_under FROM clips LEFT JOIN exclusions USING (clip_id)
WHERE duration_sec < 20 AND (state IS NULL OR state = 'candidate') AND (us, clip_id) > (1704400000000000, 0) ORDER BY us, clip_id LIMIT 50""")
def short_clips_after(spark, sf_dir):
    rows = clips(spark, sf_dir).filter((F.col("duration_sec") < 20) & (F.struct("us", "clip_id") > F.struct(F.lit(1_704_400_000_000_000), F.lit(0).cast("long"))))
    told = rows.join(exclusions(spark, sf_dir), "clip_id", "left").filter("state IS NULL OR state = 'candidate'").join(logs(spark, sf_dir).select("clip_id", F.lit(True).alias("logged")), "clip_id", "left")
    from ..functions.times import displayed_seconds

    return told.orderBy("us", "clip_id").limit(50).select("clip_id", displayed_seconds(F.col("duration_sec")).alias("shown"), (F.col("state") == "candidate").alias("known"), F.coalesce("logged", F.lit(False)).alias("protected"), F.lit(20.0).alias("candidate_under"))


@query(f"""WITH {PAIRS} SELECT p.pair_id, l.clip_id AS left_clip, r.clip_id AS right_clip, a.n_name AS left_camera, b.n_name AS right_camera, r.us - l.us AS apart_us FROM pairs p JOIN clips l ON l.clip_id = left_clip JOIN clips r ON r.clip_id = right_clip JOIN nation a ON a.n_nationkey = l.camera_id JOIN nation b ON b.n_nationkey = r.camera_id""")
def pair_sides(spark, sf_dir):
    """Both clips of a pair and both cameras: the same two tables joined twice."""
    from ..operators import events

    p = events.adjacent_pairs(accounted(spark, sf_dir)).select("pair_id", "left_clip", "right_clip")
    cameras = table(spark, sf_dir, "nation")
    for side in ("left", "right"):
        c = clips(spark, sf_dir).select(F.col("clip_id").alias(f"{side}_clip"), F.col("camera_id").alias(f"{side}_key"), F.col("us").alias(f"{side}_us"))
        p = p.join(c, f"{side}_clip").join(cameras.select(F.col("n_nationkey").alias(f"{side}_key"), F.col("n_name").alias(f"{side}_camera")), f"{side}_key")
    return p.select("pair_id", "left_clip", "right_clip", "left_camera", "right_camera", (F.col("right_us") - F.col("left_us")).alias("apart_us"))


@query(f"""WITH {CLIPS}, d AS (SELECT clip_id, camera_id, CAST(activity_day AS VARCHAR) AS day, us // 1800000000 AS episode, CASE WHEN clip_id % 3 = 0 THEN 'dev' ELSE 'test' END AS part FROM clips)
SELECT 'episode' AS axis, camera_id || ':' || episode AS key FROM d GROUP BY 2 HAVING count(DISTINCT part) > 1 UNION ALL SELECT 'camera', CAST(camera_id AS VARCHAR) FROM d GROUP BY 2 HAVING count(DISTINCT part) > 1 UNION ALL SELECT 'day', day FROM d GROUP BY 2 HAVING count(DISTINCT part) > 1""")
def leakage_axes(spark, sf_dir):
    """Episodes, cameras and days that two parts of a split share."""
    rows = clips(spark, sf_dir).select("camera_id", F.col("activity_day").cast("string").alias("day"), F.floor(F.col("us") / 1_800_000_000).alias("episode"), F.when(F.col("clip_id") % 3 == 0, "dev").otherwise("test").alias("part"))
    axes = {"episode": F.concat_ws(":", F.col("camera_id").cast("string"), F.col("episode").cast("string")), "camera": F.col("camera_id").cast("string"), "day": F.col("day")}
    return audit.shared_keys(rows, axes, "part")


@query(f"""WITH {CLIPS}, n AS (SELECT *, sha256('smoke|' || clip_id) AS draw FROM clips), f AS (SELECT clip_id, event_type FROM n QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY draw, clip_id) = 1),
r AS (SELECT clip_id, event_type FROM n WHERE clip_id NOT IN (SELECT clip_id FROM f) ORDER BY draw, clip_id LIMIT (SELECT greatest(0, 30 - count(*)) FROM f))
SELECT * FROM f UNION ALL SELECT * FROM r""")
def one_each_then_fill(spark, sf_dir):
    return selection.one_each_then_fill(clips(spark, sf_dir).select("clip_id", "event_type"), "smoke", "clip_id", ["event_type"], 30)


@query(f"""WITH {PAIRS}, p AS (SELECT CAST(activity_day AS VARCHAR) AS night, camera_id, gap_bin FROM pairs), n AS (SELECT DISTINCT night FROM p), a AS (SELECT night, attempt FROM n, range(40) r(attempt)),
o AS (SELECT night, attempt, row_number() OVER (PARTITION BY attempt ORDER BY sha256('night|' || attempt || '|' || night), night) AS nth FROM a), s AS (SELECT *, CASE WHEN nth <= 3 THEN 'dev' WHEN nth <= 6 THEN 'holdout' END AS side FROM o WHERE nth <= 6),
g AS (SELECT attempt FROM (SELECT attempt, side, count(DISTINCT s.night) AS c, count(DISTINCT camera_id) AS cams, count(DISTINCT gap_bin) AS bins FROM s JOIN p USING (night) GROUP BY 1, 2) WHERE c = 3 AND cams >= 2 AND bins >= 2 GROUP BY 1 HAVING count(*) = 2)
SELECT night, side, CAST(attempt AS INTEGER) AS attempt FROM s WHERE attempt = (SELECT min(attempt) FROM g)""")
def night_partition_by_bins(spark, sf_dir):
    """Nights of two sides that both see two cameras and two lengths of gap at least."""
    from ..operators import events

    rows = events.adjacent_pairs(accounted(spark, sf_dir)).select(F.col("activity_day").cast("string").alias("night"), "camera_id", "gap_bin")
    return selection.night_split(rows, "night", "camera_id", 40, 3, bins="gap_bin", least_bins=2)


@query(f"""WITH {SUBMISSIONS}, d AS (SELECT a.clip_id, a.decision AS x, b.decision AS y, CASE WHEN a.clip_id % 4 <> 0 THEN a.decision END AS owner FROM sub a JOIN sub b ON a.clip_id = b.clip_id AND a.reviewer = 1 AND b.reviewer = 2), r AS (SELECT *, x <> y OR x = 'hold' OR y = 'hold' AS needs FROM d),
f AS (SELECT count(*) FILTER (WHERE needs AND owner IS NULL) AS missing, count(*) FILTER (WHERE NOT needs AND owner IS NOT NULL) AS unneeded, count(*) AS n, count(*) FILTER (WHERE x = y) AS agreed FROM r)
SELECT *, missing = 0 AND unneeded = 0 AS complete, CAST(agreed AS DOUBLE) / n AS raw_agreement FROM f""")
def finalisation_check(spark, sf_dir):
    """Whether the owner decided exactly what two reviewers left open."""
    rows = review_pairs(spark, sf_dir).select(F.col("s1.decision").alias("a"), F.col("s2.decision").alias("b"), F.when(F.col("clip_id") % 4 != 0, F.col("s1.decision")).alias("owner"))
    return evaluation.finalisation(rows, "hold")


@query(f"""WITH {PREDICTIONS}, h AS (SELECT clip_id, max(CASE WHEN truth = 'R' THEN 'same' ELSE 'different' END) AS human, max(CASE WHEN pred = 'R' THEN 'same' WHEN pred = 'A' THEN 'different' ELSE 'uncertain' END) AS told FROM predictions WHERE line = 1 GROUP BY 1),
c AS (SELECT count(*) AS n, count(told) AS valid, count(*) FILTER (WHERE human = 'different' AND told = 'same') AS over_merge, count(*) FILTER (WHERE human = 'same' AND told = 'different') AS over_split, count(*) FILTER (WHERE told = 'uncertain') AS uncertain,
  count(*) FILTER (WHERE human = 'same') AS n_same, count(*) FILTER (WHERE human = 'same' AND told = 'same') AS same_right FROM h)
SELECT *, CASE WHEN valid <> n THEN 'REJECT_RELIABILITY' WHEN over_merge > 0 THEN 'REJECT_SAFETY' WHEN same_right < ceil(n_same / 2) THEN 'REJECT_UTILITY' ELSE 'DEVELOPMENT_CANDIDATE' END AS verdict FROM c""")
def boundary_verdict(spark, sf_dir):
    human = F.when(F.col("truth") == "R", "same").otherwise("different")
    told = F.when(F.col("pred") == "R", "same").when(F.col("pred") == "A", "different").otherwise("uncertain")
    rows = predictions(spark, sf_dir).filter("line = 1").groupBy("clip_id").agg(F.max(human).alias("human"), F.max(told).alias("told"))
    return evaluation.boundary_verdict(rows)


@query(f"""WITH {PREDICTIONS}, p AS (SELECT a.clip_id, max(a.pred) AS a, max(b.pred) AS b FROM predictions a JOIN predictions b ON a.clip_id = b.clip_id AND a.line = 1 AND b.line = 2 GROUP BY 1),
c AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(n) FILTER (WHERE a = b) AS same, sum(n) FILTER (WHERE a <> b OR a = 'N') AS owner FROM c),
x AS (SELECT sum(u.x * v.y) AS chance FROM (SELECT a AS v, sum(n) AS x FROM c GROUP BY 1) u JOIN (SELECT b AS v, sum(n) AS y FROM c GROUP BY 1) v USING (v)), k AS (SELECT CAST(n AS BIGINT) AS n, CAST(same AS DOUBLE) / CAST(n AS DOUBLE) AS po, CAST(chance AS DOUBLE) / CAST(n * n AS DOUBLE) AS pe, CAST(owner AS DOUBLE) / CAST(n AS DOUBLE) AS owner_rate FROM t, x)
SELECT n, po AS agreement, (po - pe) / (1 - pe) AS kappa, owner_rate, CASE WHEN po < 0.6 THEN 'unreliable' WHEN owner_rate > 0.5 THEN 'costly' ELSE 'usable' END AS verdict FROM k""")
def study_bundle(spark, sf_dir):
    """Agreement, kappa, owner's share and verdict of a study in one row, from one table of cells."""
    rows = predictions(spark, sf_dir).filter("line <= 2").groupBy("clip_id").agg(*[F.max(F.when(F.col("line") == n, F.col("pred"))).alias(c) for n, c in ((1, "a"), (2, "b"))]).na.drop()
    return evaluation.study_bundle(rows, "a", "b", "N")


@query(f"""WITH {PREDICTIONS}, s AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE pred = truth) AS n_right, count(*) FILTER (WHERE replace(pred, 'N', 'A') = replace(truth, 'N', 'A')) AS merged_right,
  CAST(sum(CASE WHEN quantity > 5 THEN CAST(quantity AS BIGINT) ELSE CAST(floor(price) AS BIGINT) % 100 END) AS DOUBLE) / count(*) AS mean_tokens, count(*) FILTER (WHERE quantity <= 2) AS errors FROM predictions GROUP BY 1)
SELECT *, CAST(n_right AS DOUBLE) / n AS accuracy, CAST(merged_right AS DOUBLE) / n AS merged_accuracy FROM s""")
def model_costs(spark, sf_dir):
    """Accuracy (also with merged labels), mean tokens with an estimate where they are missing, and errors of each model."""
    tokens = F.when(F.col("quantity") > 5, F.col("quantity").cast("long"))
    merged = lambda c: F.replace(F.col(c), F.lit("N"), F.lit("A"))
    out = predictions(spark, sf_dir).groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("pred") == F.col("truth")).alias("n_right"),
        F.count_if(merged("pred") == merged("truth")).alias("merged_right"),
        (F.sum(F.coalesce(tokens, F.floor("price") % 100)).cast("double") / F.count("*")).alias("mean_tokens"),
        F.count_if(F.col("quantity") <= 2).alias("errors"),
    )
    return out.withColumns({"accuracy": F.col("n_right").cast("double") / F.col("n"), "merged_accuracy": F.col("merged_right").cast("double") / F.col("n")})


CHECKS = ["provenance", "checkpoint_sha256", "threshold", "frames_sampled", "gecko_visible", "motion_metrics.area", "motion_metrics.drift"]


@query(f"""WITH e AS (SELECT event_id AS id, event_id % 9 <> 0 AS prov, event_id % 7 <> 0 AS cp, event_id % 5 <> 0 AS thr, event_id % 8 <> 0 AS fr, event_id % 6 <> 0 AS vis, event_id % 11 <> 0 AS area, event_id % 13 <> 0 AS drift FROM events)
SELECT id, array_to_string(list_filter([CASE WHEN NOT prov THEN 'provenance' END, CASE WHEN NOT cp THEN 'checkpoint_sha256' END, CASE WHEN NOT thr THEN 'threshold' END, CASE WHEN NOT fr THEN 'frames_sampled' END, CASE WHEN NOT vis THEN 'gecko_visible' END,
  CASE WHEN NOT area THEN 'motion_metrics.area' END, CASE WHEN NOT drift THEN 'motion_metrics.drift' END], lambda x: x IS NOT NULL), ',') AS issues FROM e""")
def evidence_completeness(spark, sf_dir):
    """Fields of an evidence document (JSON) that are missing or no value of their kind: a boolean is no number, nor is a text."""
    n = F.col("event_id")
    sha = F.sha2(n.cast("string"), 256)
    body = F.concat(
        F.lit('{"provenance":'), F.when(n % 9 == 0, '"  "').otherwise('"run"'), F.lit(',"checkpoint_sha256":"'), F.when(n % 7 == 0, F.upper(sha)).otherwise(sha),
        F.lit('","threshold":'), F.when(n % 5 == 0, "true").otherwise("0.25"), F.lit(',"frames_sampled":'), F.when(n % 8 == 0, "0").otherwise("12"),
        F.lit(',"gecko_visible":'), F.when(n % 6 == 0, "1").otherwise("false"), F.lit(',"motion_metrics":{"area":'), F.when(n % 11 == 0, '"big"').otherwise("3"), F.when(n % 13 == 0, "").otherwise(',"drift":0.5'), F.lit("}}"),
    )
    told = table(spark, sf_dir, "events").select(n.alias("id"), F.parse_json(body).alias("d"))
    return told.select("id", F.array_join(evaluation.evidence_issues(F.col("d"), ["provenance"], ["area", "drift"]), ",").alias("issues"))


@query("""WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 40 + 20) AS v FROM embeddings), s AS (SELECT vec_id, list_avg(v) AS m, list_stddev_pop(v) AS s FROM r)
SELECT vec_id, CASE WHEN m < 18 OR s < 2 THEN 'low' WHEN s >= 8 THEN 'high' ELSE 'medium' END AS reliability FROM s""")
def evidence_reliability(spark, sf_dir):
    from ..operators.features import reliability_of

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 40 + 20).alias("v"))
    return rows.select("vec_id", reliability_of(F.col("v")).alias("reliability"))
