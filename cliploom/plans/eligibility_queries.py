"""Queries on predicates, object keys, times and token counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, ratios, times
from ..operators import eligibility
from ..sources.tables import assessments, clips, exclusions, features, table
from .queue_queries import LOGS, logs
from .registry import ASSESSMENTS, CLIPS, EXCLUSIONS, query
from .routing_queries import ROWS

GONE = "clip_id NOT IN (SELECT clip_id FROM exclusions WHERE state IN ('quarantined', 'media_deleted'))"


@query(f"WITH {CLIPS}, {EXCLUSIONS} SELECT clip_id, camera_id FROM clips WHERE (camera_id NOT IN (2, 3) OR duration_sec >= 50) AND {GONE}")
def labelable_clips(spark, sf_dir):
    return eligibility.labelable(clips(spark, sf_dir), exclusions(spark, sf_dir), [2, 3]).select("clip_id", "camera_id")


@query(f"WITH {CLIPS}, {EXCLUSIONS} SELECT clip_id, media_key FROM clips WHERE event_type <> 'view' AND media_key LIKE 'clips/cam1%' AND {GONE}")
def production_eligible(spark, sf_dir):
    rows = clips(spark, sf_dir).withColumn("purpose", F.when(F.col("event_type") == "view", "test").otherwise("production"))
    return eligibility.production(rows, exclusions(spark, sf_dir), "production", "clips/cam1").select("clip_id", "media_key")


REVIEW = "r AS (SELECT *, CASE k % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'review' ELSE 'final' END AS review_state FROM clips)"


@query(f"""WITH {CLIPS}, {EXCLUSIONS}, {LOGS}, {REVIEW}
SELECT 'owner' AS role, clip_id FROM r WHERE review_state = 'review'
UNION ALL SELECT 'labeler', clip_id FROM r WHERE review_state = 'label' AND media_key IS NOT NULL AND {GONE} AND clip_id NOT IN (SELECT clip_id FROM logs WHERE clip_id % 4 = 1)""")
def role_queues(spark, sf_dir):
    k = F.col("k") % 3
    rows = clips(spark, sf_dir).withColumn("review_state", F.when(k == 0, "label").when(k == 1, "review").otherwise("final"))
    done = logs(spark, sf_dir).select("clip_id", (F.col("clip_id") % 4).alias("reviewer"))
    told = lambda role, owner, state: eligibility.for_role(rows, exclusions(spark, sf_dir), done, 1, owner, state).select(F.lit(role).alias("role"), "clip_id")
    return told("owner", True, "review").unionByName(told("labeler", False, None))


@query(f"WITH {CLIPS}, {EXCLUSIONS} SELECT clip_id, CASE state WHEN 'quarantined' THEN 'not_found' WHEN 'media_deleted' THEN 'gone' ELSE 'ok' END AS status FROM clips LEFT JOIN exclusions USING (clip_id)")
def media_status(spark, sf_dir):
    return eligibility.media_status(clips(spark, sf_dir), exclusions(spark, sf_dir))


@query("""WITH s AS (SELECT event_id AS clip_id, event_id % 7 - 1 AS under, CASE WHEN event_id % 5 = 0 THEN CAST([] AS BIGINT[]) ELSE [event_id % 6, event_id % 4 - 1] END AS seconds FROM events)
SELECT clip_id, under > 0 AND len(list_filter(seconds, lambda x: NOT (x >= 0 AND x < under))) = 0 AS valid FROM s""")
def second_bounds(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(n.alias("clip_id"), (n % 7 - 1).alias("under"), F.when(n % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(n % 6, n % 4 - 1)).alias("seconds"))
    return rows.select("clip_id", eligibility.valid_seconds(F.col("under"), F.col("seconds")).alias("valid"))


RULE = {"motion_mean": 0.02, "motion_peak": 0.05, "active_ratio": 0.4, "brightness_std": 6.0, "saturation": 0.7}


@query(f"""WITH {ROWS} SELECT clip_id, CASE WHEN motion_mean >= 0.02 AND motion_peak >= 0.05 AND active_ratio >= 0.4 AND brightness_std >= 6 AND saturation <= 0.7 THEN 'auto_label' ELSE 'fallback_vlm' END AS route, 'fallback_vlm' AS without_rule FROM f0""")
def conservative_motion(spark, sf_dir):
    return features(spark, sf_dir, missing=False).select("clip_id", eligibility.conservative_rule(RULE).alias("route"), eligibility.conservative_rule(None).alias("without_rule"))


@query("""WITH e AS (SELECT event_id AS clip_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'failed' ELSE 'ok' END AS l0, CASE WHEN event_id % 5 <> 0 THEN 'ok' END AS l1, event_id % 6 <> 0 AS has,
  CASE WHEN event_id % 7 <> 0 THEN value END AS sec, CASE WHEN event_id % 8 <> 0 THEN event_id % 30 END AS seen FROM events)
SELECT clip_id FROM e WHERE l0 = 'ok' AND l1 = 'ok' AND has AND coalesce(sec, 0) >= 10 AND coalesce(seen, 0) >= 5""")
def eligible_evidence(spark, sf_dir):
    n = F.col("event_id")
    dwell = F.when(n % 6 != 0, F.struct(F.when(n % 7 != 0, F.col("value")).alias("observed_sec"), F.when(n % 8 != 0, n % 30).alias("n_seen")))
    rows = table(spark, sf_dir, "events").select(n.alias("clip_id"), F.when(n % 4 == 1, "failed").when(n % 4 != 0, "ok").alias("l0"), F.when(n % 5 != 0, "ok").alias("l1"), dwell.alias("dwell"))
    return rows.filter(eligibility.evidence(F.col("l0"), F.col("l1"), F.col("dwell"), 10.0, 5)).select("clip_id")


T0, NOT_BEFORE = 1_706_000_000_000_000, 1_704_500_000_000_000


@query(f"""WITH {CLIPS}, {EXCLUSIONS}, {LOGS}, {ASSESSMENTS} SELECT clip_id FROM clips WHERE us < {T0} AND us >= {NOT_BEFORE} AND epoch_us(CAST(activity_day AS TIMESTAMP) + INTERVAL 22 HOUR) <= {T0}
  AND media_key IS NOT NULL AND has_motion AND clip_id NOT IN (SELECT clip_id FROM exclusions) AND clip_id NOT IN (SELECT clip_id FROM logs) AND clip_id NOT IN (SELECT clip_id FROM assessments WHERE decision = 'absent')""")
def formal_eligible(spark, sf_dir):
    absent = assessments(spark, sf_dir).filter("decision = 'absent'")
    return eligibility.formal(clips(spark, sf_dir), T0, NOT_BEFORE, exclusions(spark, sf_dir), logs(spark, sf_dir), absent).select("clip_id")


@query(f"""WITH {CLIPS}, {ASSESSMENTS}, p AS (SELECT event_id AS prelabel_id, event_id % 40 AS frames, event_id % 3 = 0 AS has FROM events)
SELECT c.clip_id, camera_id, frames, CASE WHEN has THEN 'present' ELSE 'absent' END AS stratum FROM clips c JOIN assessments a ON a.clip_id = c.clip_id AND policy_version = 'v1' JOIN p ON prelabel_id = c.clip_id // 2
WHERE camera_id IN (0, 1, 2, 5) AND duration_sec > 0 AND media_key IS NOT NULL AND frames >= 12""")
def workload_eligible(spark, sf_dir):
    told = assessments(spark, sf_dir).withColumn("prelabel_id", F.floor(F.col("clip_id") / 2))
    n = F.col("event_id")
    prelabels = table(spark, sf_dir, "events").select(n.alias("prelabel_id"), (n % 40).alias("frames"), F.when(n % 3 == 0, F.array(n, n)).alias("box"))
    return eligibility.workload(clips(spark, sf_dir), told, prelabels, "v1", [0, 1, 2, 5], 12)


@query(f"""WITH {CLIPS}, {EXCLUSIONS}, {LOGS}, {ASSESSMENTS}, p AS (SELECT clip_id, 'exclusions' AS "by" FROM exclusions UNION SELECT clip_id, 'logs' FROM logs UNION SELECT clip_id, 'assessments' FROM assessments WHERE decision = 'active'),
g AS (SELECT clip_id, string_agg("by", ',' ORDER BY "by") AS "by" FROM p GROUP BY 1)
SELECT clip_id, g."by" IS NOT NULL AS protected, coalesce(g."by", '') AS "by" FROM clips LEFT JOIN g USING (clip_id)""")
def protection_check(spark, sf_dir):
    active = assessments(spark, sf_dir).filter("decision = 'active'")
    return eligibility.guard_reasons(clips(spark, sf_dir), {"exclusions": exclusions(spark, sf_dir), "logs": logs(spark, sf_dir), "assessments": active})


UUID = "substr(md5(CAST(event_id AS VARCHAR)), 1, 8) || '-' || substr(md5(CAST(event_id AS VARCHAR)), 9, 4) || '-4abc-8def-' || upper(substr(md5(CAST(event_id AS VARCHAR)), 13, 12))"
KEYS = f"""keys AS (SELECT event_id AS object_id, CASE event_id % 6 WHEN 0 THEN 'clips/cam' || user_id % 10 || '/' || strftime(ts, '%Y-%m-%d') || '/night_motion_' || {UUID} || '.mp4'
    WHEN 1 THEN 'clips/' || strftime(ts, '%Y/%m/%d') || '/slug' || user_id % 10 || '/' || {UUID} || '.mp4' WHEN 2 THEN 'Verify/run_idle' || event_id || '.mp4' WHEN 3 THEN 'other/thing' || event_id || '.mp4'
    WHEN 4 THEN 'clips/cam/2024-01-01/x_notanid.mp4' ELSE 'clips/cam' || user_id % 10 || '/' || strftime(ts, '%Y-%m-%d') || '/day_idle_' || {UUID} || '.mp4' END AS key FROM events)"""


def object_keys(spark, sf_dir):
    n, day = F.col("event_id"), lambda shape: F.date_format("ts", shape)
    hashed = F.md5(n.cast("string"))
    name = F.concat(F.substring(hashed, 1, 8), F.lit("-"), F.substring(hashed, 9, 4), F.lit("-4abc-8def-"), F.upper(F.substring(hashed, 13, 12)))
    cam = (F.col("user_id") % 10).cast("string")
    canonical = lambda stem: F.concat(F.lit("clips/cam"), cam, F.lit("/"), day("yyyy-MM-dd"), F.lit(f"/{stem}_"), name, F.lit(".mp4"))
    key = (
        F.when(n % 6 == 0, canonical("night_motion"))
        .when(n % 6 == 1, F.concat(F.lit("clips/"), day("yyyy/MM/dd"), F.lit("/slug"), cam, F.lit("/"), name, F.lit(".mp4")))
        .when(n % 6 == 2, F.concat(F.lit("Verify/run_idle"), n.cast("string"), F.lit(".mp4")))
        .when(n % 6 == 3, F.concat(F.lit("other/thing"), n.cast("string"), F.lit(".mp4")))
        .when(n % 6 == 4, F.lit("clips/cam/2024-01-01/x_notanid.mp4"))
        .otherwise(canonical("day_idle"))
    )
    return table(spark, sf_dir, "events").select(n.alias("object_id"), key.alias("key"))


SHAPE = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
PARSED = rf"""{KEYS}, parsed AS (SELECT *, CASE WHEN regexp_matches(key, '^clips/[^/]+/\d{{4}}-\d{{2}}-\d{{2}}/.+_{SHAPE}\.mp4$') THEN 'canonical_clip'
    WHEN regexp_matches(key, '^clips/\d{{4}}/\d{{2}}/\d{{2}}/[^/]+/{SHAPE}\.mp4$') THEN 'legacy_dated_clip' ELSE 'unknown' END AS pattern, string_split(key, '/') AS parts FROM keys)"""


@query(rf"""WITH {PARSED} SELECT object_id, pattern, CASE pattern WHEN 'canonical_clip' THEN parts[2] WHEN 'legacy_dated_clip' THEN parts[5] END AS camera,
  CASE pattern WHEN 'canonical_clip' THEN parts[3] WHEN 'legacy_dated_clip' THEN parts[2] || '-' || parts[3] || '-' || parts[4] END AS date,
  CASE WHEN pattern <> 'unknown' THEN lower(regexp_extract(key, '({SHAPE})\.mp4$', 1)) END AS clip,
  CASE WHEN contains(lower(parts[-1]), '_motion') THEN true WHEN contains(lower(parts[-1]), '_idle') THEN false END AS motion FROM parsed""")
def object_key_shapes(spark, sf_dir):
    from ..functions.text import motion_of

    name = F.lower(F.substring_index("key", "/", -1))
    return object_keys(spark, sf_dir).select("object_id", keys.parsed(F.col("key")).alias("p"), motion_of(name).alias("motion")).select("object_id", "p.*", "motion")


@query(f"""WITH {PARSED}, k AS (SELECT *, object_id % 9 = 0 AS known, len(list_filter(['verify/', 'experiment', 'eval', 'test', 'tmp', 'sample'], lambda t: contains(lower(key), t))) > 0 AS trial FROM parsed),
c AS (SELECT CASE WHEN known THEN 'known_camera_clip' WHEN pattern = 'canonical_clip' THEN 'likely_missing_camera_clip' WHEN pattern = 'legacy_dated_clip' THEN 'manual_review_clip' WHEN trial THEN 'experiment_artifact' ELSE 'unknown_pattern' END AS class, known FROM k)
SELECT class, CASE class WHEN 'likely_missing_camera_clip' THEN 'medium' WHEN 'manual_review_clip' THEN 'low' ELSE 'none' END AS confidence, count(*) AS n FROM c GROUP BY 1""")
def object_inventory(spark, sf_dir):
    """Objects of a listing by class; those the table of clips knows come from a join."""
    rows = object_keys(spark, sf_dir)
    known = rows.filter(F.col("object_id") % 9 == 0).select("object_id", F.lit(True).alias("known"))
    told = keys.classified(keys.parsed(F.col("key"))["pattern"], F.col("key"), F.coalesce("known", F.lit(False)))
    return rows.join(known, "object_id", "left").select(told.alias("c")).groupBy("c.class", "c.confidence").agg(F.count("*").alias("n"))


@query(f"""WITH {CLIPS} SELECT DISTINCT CAST(activity_day AS VARCHAR) AS activity_day, epoch_us(CAST(activity_day AS TIMESTAMP) - INTERVAL 2 HOUR) AS starts_us FROM clips""")
def day_starts(spark, sf_dir):
    days = clips(spark, sf_dir).select("activity_day").distinct()
    return days.select(F.col("activity_day").cast("string").alias("activity_day"), times.day_start_us(F.col("activity_day")).alias("starts_us"))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), d AS (SELECT CAST(now + INTERVAL 9 HOUR AS DATE) AS today, CAST(now + INTERVAL 2 HOUR AS DATE) - 1 AS closed FROM n)
SELECT p AS preset, CAST(today - a AS VARCHAR) AS "from", CAST(today - b AS VARCHAR) AS "to", CAST(closed AS VARCHAR) AS closed_day FROM d, (VALUES ('today', 0, 0), ('yesterday', 1, 1), ('last3', 2, 0), ('last7', 6, 0)) t(p, a, b)""")
def date_presets(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    rows = now.select(F.explode(times.preset_ranges(F.col("now"))).alias("p"), times.closed_day(F.col("now")).cast("string").alias("closed_day"))
    return rows.select("p.preset", F.col("p.from").cast("string").alias("from"), F.col("p.to").cast("string").alias("to"), "closed_day")


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S+09:00') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 3 THEN 'yesterday' END AS s, epoch_us(date_trunc('second', ts)) AS us FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN us WHEN 1 THEN us - 32400000000 END AS strict_us, CASE event_id % 5 WHEN 0 THEN us WHEN 1 THEN us - 32400000000 WHEN 2 THEN us END AS lenient_us FROM t""")
def parsed_times(spark, sf_dir):
    n, told = F.col("event_id"), lambda shape: F.date_format("ts", shape)
    text = F.when(n % 5 == 0, told("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(n % 5 == 1, told("yyyy-MM-dd HH:mm:ss'+09:00'")).when(n % 5 == 2, told("yyyy-MM-dd'T'HH:mm:ss")).when(n % 5 == 3, "yesterday")
    return table(spark, sf_dir, "events").select("event_id", text.alias("s")).select("event_id", times.aware_us(F.col("s")).alias("strict_us"), times.lenient_us(F.col("s")).alias("lenient_us"))


SECRET = b"a secret of the study"
BLOCK = SECRET.ljust(64, b"\0")
BLOB = lambda pad, more=b"": "'" + "".join(f"\\x{b:02X}" for b in bytes(x ^ pad for x in BLOCK) + more) + "'::BLOB"


@query(f"""SELECT c_custkey AS owner_id, substr(sha256({BLOB(0x5C)} || unhex(sha256({BLOB(0x36, b"owner" + bytes([0]))} || encode(c_name)))), 1, 16) AS token FROM customer""")
def owner_tokens(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner_id"), keys.keyed_token(SECRET, "owner", F.col("c_name")).alias("token"))


NUL = "chr(0)"


@query(f"""SELECT event_id AS clip_id, sha256('seed' || {NUL} || event_id || {NUL} || user_id) AS ordered_by FROM events""")
def separated_hashes(spark, sf_dir):
    """Seeded digests of parts with a zero byte between them."""
    from ..functions.hashing import digest

    return table(spark, sf_dir, "events").select(F.col("event_id").alias("clip_id"), digest("seed", F.col("event_id"), F.col("user_id"), separator="\0").alias("ordered_by"))


NAMES = ["Not-Drinking_1.mp4", "hand-feeding-2.mp4", "eating-paste.mp4", "eating-prey.mp4", "drinking_9.mp4", "basking.mp4"]
CODES = ["crested-gecko", "gargoyle-gecko", "leopard-gecko", "tortoise"]


@query(f"""WITH n AS (SELECT p_partkey AS id, {NAMES}[p_partkey % 6 + 1] AS name, CASE WHEN p_partkey % 5 <> 0 THEN {CODES}[p_partkey % 4 + 1] END AS code, p_size AS size FROM part)
SELECT id, CASE WHEN starts_with(lower(name), 'not-drinking') THEN 'moving' WHEN starts_with(lower(name), 'hand-feeding') THEN 'hand_feeding' WHEN starts_with(lower(name), 'eating-paste') THEN 'eating_paste'
    WHEN starts_with(lower(name), 'eating-prey') THEN 'eating_prey' WHEN starts_with(lower(name), 'drinking') THEN 'drinking' END AS class,
  CASE WHEN code IN ('crested-gecko', 'gargoyle-gecko', 'leopard-gecko') THEN replace(code, '-', '_') ELSE 'crested_gecko' END AS species,
  85 + 170 * CAST(ceil(size * 40 / 512) AS BIGINT) * CAST(ceil(size * 20 / 512) AS BIGINT) AS tile_tokens, CAST(ceil(size * 40 * size * 20 / 750) AS BIGINT) AS area_tokens,
  CASE WHEN id % 7 <> 0 AND id % 11 > 0 THEN CAST(size AS DOUBLE) / (id % 11) END AS frames_per_second FROM n""")
def name_codes(spark, sf_dir):
    n, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (n % len(names)).cast("int"))
    return table(spark, sf_dir, "part").select(
        n.alias("id"),
        keys.class_of_name(pick(NAMES)).alias("class"),
        keys.species(F.when(n % 5 != 0, pick(CODES))).alias("species"),
        ratios.tiles_tokens(size * 40, size * 20).alias("tile_tokens"),
        ratios.area_tokens(size * 40, size * 20).alias("area_tokens"),
        ratios.per_second(F.when(n % 7 != 0, size), n % 11).alias("frames_per_second"),
    )


@query("""WITH b AS (SELECT s_suppkey AS id, 4000.0::DOUBLE AS baseline, CAST(s_suppkey % 9 AS DOUBLE) * 100 AS prim, CAST(s_suppkey % 11 AS DOUBLE) / 10 AS rate, CAST(s_suppkey % 5 + 1 AS DOUBLE) * 1000 AS fb FROM supplier)
SELECT id, prim + rate * fb AS expected, 1 - (prim + rate * fb) / baseline AS reduction, CASE WHEN baseline * (1 - 0.8::DOUBLE) - prim <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (baseline * (1 - 0.8::DOUBLE) - prim) / fb)) END AS most_fallback FROM b""")
def token_plans(spark, sf_dir):
    n = F.col("s_suppkey")
    baseline, primary, rate, fallback = F.lit(4000.0), (n % 9).cast("double") * 100, (n % 11).cast("double") / 10, (n % 5 + 1).cast("double") * 1000
    expected = ratios.expected_tokens(primary, rate, fallback)
    return table(spark, sf_dir, "supplier").select(
        n.alias("id"), expected.alias("expected"), ratios.token_reduction(baseline, expected).alias("reduction"), ratios.most_fallback(baseline, primary, F.lit(0.8), fallback).alias("most_fallback")
    )
