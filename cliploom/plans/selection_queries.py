"""Queries on selections, runs, series, pages and JSON documents."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from ..functions import cursors
from ..functions.hashing import digest
from ..operators import documents, events, features, sampling, selection
from ..sources.tables import assessments, clips, predictions, table
from .event_queries import PAIRS, accounted
from .registry import ASSESSMENTS, CLIPS, PREDICTIONS, query

BINS = ["short", "medium", "long"]
DRAWN = f"""{PAIRS}, d AS (SELECT CAST(activity_day AS VARCHAR) AS night, camera_id, gap_bin, left_clip, right_clip, sha256('greedy|' || pair_id) AS draw, CASE gap_bin WHEN 'short' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS bin FROM pairs),
l AS (SELECT night % 4 AS scope, list({{'bin': bin, 'draw': draw, 'left_clip': left_clip, 'right_clip': right_clip, 'camera_id': camera_id, 'gap_bin': gap_bin}} ORDER BY bin, draw, left_clip) AS items FROM (SELECT *, CAST(substr(d.night, 9, 2) AS INTEGER) AS night FROM d) GROUP BY 1)"""


@query(f"""WITH RECURSIVE {DRAWN.replace("SELECT *, CAST(substr(d.night, 9, 2) AS INTEGER) AS night FROM d", "SELECT * EXCLUDE (night), CAST(substr(night, 9, 2) AS INTEGER) AS night FROM d")},
g AS (SELECT scope, items, 0 AS i, items[1:0] AS kept FROM l UNION ALL
  SELECT scope, items, i + 1, CASE WHEN len(list_filter(kept, lambda k: k.left_clip = items[i + 1].left_clip OR k.right_clip = items[i + 1].right_clip OR k.left_clip = items[i + 1].right_clip OR k.right_clip = items[i + 1].left_clip)) = 0
    AND len(list_filter(kept, lambda k: k.bin = items[i + 1].bin)) < 5 AND len(list_filter(kept, lambda k: k.bin = items[i + 1].bin AND k.camera_id = items[i + 1].camera_id)) < 2
    AND len(list_filter(kept, lambda k: k.camera_id = items[i + 1].camera_id)) < 3 THEN list_append(kept, items[i + 1]) ELSE kept END FROM g WHERE i < len(items)),
o AS (SELECT scope, unnest(arg_max(kept, i)) AS p FROM g GROUP BY 1)
SELECT scope, p.gap_bin AS gap_bin, p.camera_id AS camera_id, p.left_clip AS left_clip, p.right_clip AS right_clip FROM o""")
def capped_pairs(spark, sf_dir):
    scope = F.day("activity_day") % 4
    pairs = events.adjacent_pairs(accounted(spark, sf_dir)).select(scope.alias("scope"), "gap_bin", "camera_id", "left_clip", "right_clip", digest("greedy", F.col("pair_id")).alias("draw"))
    return selection.capped_pairs(pairs, ["scope"], BINS, 5, 2, 3)


@query(f"""WITH RECURSIVE {PAIRS}, d AS (SELECT CAST(day(activity_day) AS INTEGER) AS night, camera_id, gap_bin, left_clip, right_clip, sha256('greedy|' || pair_id) AS draw FROM pairs),
t AS (SELECT d.*, attempt, order_no, list_position(bins, gap_bin) AS bin FROM d, range(4) r(attempt), (VALUES {", ".join(f"({i}, {list(p)})" for i, p in enumerate(permutations(BINS)))}) o(order_no, bins) WHERE (night + attempt) % 3 = 0),
l AS (SELECT attempt, order_no, list({{'bin': bin, 'draw': draw, 'left_clip': left_clip, 'right_clip': right_clip, 'camera_id': camera_id, 'gap_bin': gap_bin}} ORDER BY bin, draw, left_clip) AS items FROM t GROUP BY 1, 2),
g AS (SELECT attempt, order_no, items, 0 AS i, items[1:0] AS kept FROM l UNION ALL
  SELECT attempt, order_no, items, i + 1, CASE WHEN len(list_filter(kept, lambda k: k.left_clip = items[i + 1].left_clip OR k.right_clip = items[i + 1].right_clip OR k.left_clip = items[i + 1].right_clip OR k.right_clip = items[i + 1].left_clip)) = 0
    AND len(list_filter(kept, lambda k: k.bin = items[i + 1].bin)) < 3 AND len(list_filter(kept, lambda k: k.bin = items[i + 1].bin AND k.camera_id = items[i + 1].camera_id)) < 1
    AND len(list_filter(kept, lambda k: k.camera_id = items[i + 1].camera_id)) < 2 THEN list_append(kept, items[i + 1]) ELSE kept END FROM g WHERE i < len(items)),
o AS (SELECT attempt, order_no, arg_max(kept, i) AS kept FROM g GROUP BY 1, 2), u AS (SELECT attempt, order_no, unnest(kept) AS p FROM o),
w AS (SELECT attempt, order_no, sha256(string_agg(p.left_clip || '-' || p.right_clip, '|' ORDER BY p.left_clip || '-' || p.right_clip)) AS digest FROM u GROUP BY 1, 2), b AS (SELECT * FROM w ORDER BY digest, attempt, order_no LIMIT 1)
SELECT CAST(attempt AS INTEGER) AS attempt, order_no, digest, p.left_clip AS left_clip, p.right_clip AS right_clip FROM u JOIN b USING (attempt, order_no)""")
def witness_search(spark, sf_dir):
    day = F.day("activity_day")
    pairs = events.adjacent_pairs(accounted(spark, sf_dir)).select(day.alias("night"), "gap_bin", "camera_id", "left_clip", "right_clip", digest("greedy", F.col("pair_id")).alias("draw"))
    days = spark.range(1, 32).select(F.col("id").cast("int").alias("night"))
    sides = days.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(3)))).filter((F.col("night") + F.col("attempt")) % 3 == 0)
    return selection.best_witness(pairs, sides, "night", BINS, 3, 1, 2).select("attempt", "order_no", "digest", "left_clip", "right_clip")


@query(f"""WITH {CLIPS}, n AS (SELECT camera_id, count(*) AS n FROM clips WHERE k < camera_id * 9 GROUP BY 1), l AS (SELECT unnest(range(1, n + 1)) AS level FROM n), u AS (SELECT level, sum(count(*)) OVER (ORDER BY level) AS given FROM l GROUP BY 1),
f AS (SELECT coalesce(max(level) FILTER (WHERE given <= 150), 0) AS fl, coalesce(max(given) FILTER (WHERE given <= 150), 0) AS given FROM u),
r AS (SELECT n.*, fl, given, row_number() OVER (PARTITION BY n > fl ORDER BY sha256('runs|quota|' || camera_id)) AS nth FROM n, f)
SELECT camera_id, n, CAST(least(n, fl) + CASE WHEN n > fl AND nth <= 150 - given THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def water_filled_quota(spark, sf_dir):
    return selection.water_filled(sizes(spark, sf_dir), "camera_id", 150, "runs")


def sizes(spark, sf_dir):
    return clips(spark, sf_dir).filter(F.col("k") < F.col("camera_id") * 9).groupBy("camera_id").agg(F.count("*").alias("n"))


@query(f"""WITH {CLIPS}, c AS (SELECT clip_id, camera_id, us, row_number() OVER (PARTITION BY camera_id ORDER BY us, clip_id) - 1 AS nth, count(*) OVER (PARTITION BY camera_id) AS n FROM clips WHERE k < 30),
w AS (SELECT *, least(n, 12) AS quota, CAST('0x' || substr(sha256('runs|window|' || camera_id), 1, 8) AS BIGINT) % (n - least(n, 12) + 1) AS start FROM c)
SELECT clip_id, camera_id, start > 0 AS left_cut, start + quota < n AS right_cut FROM w WHERE nth >= start AND nth < start + quota""")
def hash_windows(spark, sf_dir):
    rows = clips(spark, sf_dir).filter("k < 30").select("clip_id", "camera_id", "us")
    quotas = rows.groupBy("camera_id").agg(F.count("*").alias("n")).withColumn("quota", F.least(F.col("n"), F.lit(12)))
    return selection.hash_windows(rows, quotas, "camera_id", ("us", "clip_id"), "runs").select("clip_id", "camera_id", "left_cut", "right_cut")


CELLS = f"""{CLIPS}, p AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'unknown' WHEN duration_sec >= 40 THEN 'high' ELSE 'low' END AS intensity FROM clips WHERE event_type <> 'signup'), s AS (SELECT intensity, event_type, count(*) AS n FROM p GROUP BY 1, 2),
b AS (SELECT *, least(n, CASE WHEN event_type = 'error' THEN greatest(q, 1) ELSE q END) AS q0 FROM (SELECT *, CAST(round_even(n * 61.0::DOUBLE / (SELECT sum(n) FROM s), 0) AS BIGINT) AS q FROM s)),
o AS (SELECT CAST(61 - sum(q0) AS BIGINT) AS off FROM b), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, intensity, event_type) AS place, CASE WHEN off > 0 THEN n - q0 ELSE q0 END AS room FROM b, o),
t AS (SELECT intensity, event_type, place, unnest(range(1, least(room, abs(off)) + 1)) AS turn FROM r WHERE off <> 0), m AS (SELECT intensity, event_type, count(*) AS moved FROM (SELECT *, row_number() OVER (ORDER BY turn, place) AS made FROM t) WHERE made <= (SELECT abs(off) FROM o) GROUP BY 1, 2)
"""


@query(f"WITH {CELLS} SELECT intensity, event_type, n, CAST(q0 + coalesce(moved, 0) * sign(off) AS BIGINT) AS quota FROM r LEFT JOIN m USING (intensity, event_type)")
def cell_quotas(spark, sf_dir):
    intensity = F.when(F.col("k") % 10 == 0, "unknown").when(F.col("duration_sec") >= 40, "high").otherwise("low")
    rows = clips(spark, sf_dir).filter("event_type <> 'signup'").withColumn("intensity", intensity)
    return selection.cell_quota(rows, ["intensity", "event_type"], 61, F.col("event_type") == "error")


WANTED = [("A", True, 6), ("A", False, 6), ("N", True, 2000), ("N", False, 4), ("R", True, 3)]


@query(f"""WITH {PREDICTIONS}, r AS (SELECT sample_id, truth AS class, bool_or(pred = truth) AS "right" FROM predictions GROUP BY 1, 2), w(class, "right", k) AS (VALUES {", ".join(f"('{c}', {str(x).lower()}, {k})" for c, x, k in WANTED)}),
h AS (SELECT class, "right", count(*) AS have FROM r GROUP BY 1, 2), p AS (SELECT class, "right", k, greatest(k - coalesce(have, 0), 0) AS lacks FROM w LEFT JOIN h USING (class, "right")),
l AS (SELECT class, "right", coalesce(p.k, 0) + coalesce(s.more, 0) AS most FROM p FULL JOIN (SELECT class, NOT "right" AS "right", lacks AS more FROM p) s USING (class, "right")),
n AS (SELECT *, row_number() OVER (PARTITION BY class, "right" ORDER BY sample_id) AS nth FROM r)
SELECT sample_id, class, n."right" FROM n JOIN l USING (class, "right") WHERE nth <= most""")
def class_and_outcome(spark, sf_dir):
    rows = predictions(spark, sf_dir).groupBy("sample_id", F.col("truth").alias("class")).agg(F.bool_or(F.col("pred") == F.col("truth")).alias("right"))
    return selection.by_class_and_outcome(rows, WANTED, "sample_id")


@query(f"""WITH {CLIPS}, h AS (SELECT clip_id, camera_id, CASE WHEN hour(ts + INTERVAL 9 HOUR) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS part, row_number() OVER (PARTITION BY camera_id, CASE WHEN hour(ts + INTERVAL 9 HOUR) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END ORDER BY sha256('probe|' || clip_id), clip_id) AS nth FROM clips)
SELECT clip_id, camera_id, part FROM h WHERE nth <= 25""")
def stratified_probe(spark, sf_dir):
    hour = F.hour(F.col("started_at") + F.expr("INTERVAL 9 HOURS"))
    rows = clips(spark, sf_dir).select("clip_id", "camera_id", F.when(hour.between(6, 17), "day").otherwise("night").alias("part"))
    return sampling.per_stratum(rows, "probe", "clip_id", ["camera_id", "part"], 25).select("clip_id", "camera_id", "part")


@query(f"""WITH {CLIPS}, r AS (SELECT clip_id, duration_sec, row_number() OVER (ORDER BY duration_sec, clip_id) - 1 AS i, count(*) OVER () AS n FROM clips WHERE k < 80),
t AS (SELECT *, CASE WHEN i < n // 3 THEN 0 WHEN i < 2 * n // 3 THEN 1 ELSE 2 END AS third FROM r), p AS (SELECT *, i - CASE third WHEN 0 THEN 0 WHEN 1 THEN n // 3 ELSE 2 * n // 3 END AS place FROM t)
SELECT clip_id, CAST(third AS INTEGER) AS third, place FROM p ORDER BY place, third LIMIT 90""")
def round_robin_thirds(spark, sf_dir):
    rows = clips(spark, sf_dir).select("clip_id", F.when(F.col("k") < 80, F.col("duration_sec")).alias("v"))
    return selection.thirds(rows, "v", "clip_id", 90).select("clip_id", "third", "place")


@query("""WITH r AS (SELECT vec_id, f, count(*) AS n FROM (SELECT vec_id, f, i - row_number() OVER (PARTITION BY vec_id, f ORDER BY i) AS g FROM (SELECT vec_id, unnest(embedding) > 0.0 AS f, generate_subscripts(embedding, 1) AS i FROM embeddings)) GROUP BY vec_id, f, g)
SELECT vec_id, CAST(coalesce(sum(n) FILTER (WHERE f AND n >= 3), 0) AS INTEGER) AS n_motion FROM r GROUP BY 1""")
def long_runs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", features.long_runs(F.transform("embedding", lambda x: x > 0.0), 3).alias("n_motion"))


@query("""WITH p AS (SELECT o_custkey AS track, o_orderkey AS spot, o_orderkey % 5 <> 0 AS ok, CAST(o_orderkey % 97 AS DOUBLE) AS x, CAST(o_orderkey % 53 AS DOUBLE) AS y, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS w, CAST(o_orderkey % 11 + 1 AS DOUBLE) AS h FROM orders),
a AS (SELECT track, count(*) AS frames, count(*) FILTER (WHERE ok) AS n_ok, arg_min({'x': x + w / 2, 'y': y + h / 2, 'a': w * h}, spot) FILTER (WHERE ok) AS f, arg_max({'x': x + w / 2, 'y': y + h / 2, 'a': w * h}, spot) FILTER (WHERE ok) AS l,
  stddev_pop(x + w / 2) FILTER (WHERE ok) AS sx, stddev_pop(y + h / 2) FILTER (WHERE ok) AS sy FROM p GROUP BY 1)
SELECT track, frames, n_ok / CAST(frames AS DOUBLE) AS ok_rate, CASE WHEN n_ok >= 2 THEN sqrt((l.x - f.x) * (l.x - f.x) + (l.y - f.y) * (l.y - f.y)) / 115.0 END AS drift, CASE WHEN n_ok >= 2 THEN l.a / f.a END AS area_ratio,
  CASE WHEN n_ok >= 2 THEN CAST(round((sx + sy) / 115.0 * 1e6) AS BIGINT) END AS spread_e6 FROM a""")
def trajectories(spark, sf_dir):
    n = F.col("o_orderkey")
    real = lambda c: c.cast("double")
    points = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("track"), n.alias("at"), (n % 5 != 0).alias("ok"), real(n % 97).alias("x"), real(n % 53).alias("y"), real(n % 7 + 1).alias("w"), real(n % 11 + 1).alias("h"))
    out = features.trajectory(points, "track", "at", 69.0, 92.0)
    return out.withColumn("spread_e6", F.round(F.col("spread") * 1_000_000).cast("long")).drop("spread")


@query(f"""WITH {CLIPS}, c AS (SELECT max(activity_day) - 1 AS last FROM clips) SELECT camera_id, CAST(coalesce(max(activity_day) FILTER (WHERE k < 3 AND activity_day <= last AND activity_day >= last - 30), max(last) - 30) AS VARCHAR) AS day FROM clips, c GROUP BY 1""")
def dense_days(spark, sf_dir):
    rows = clips(spark, sf_dir)
    last = rows.agg(F.date_sub(F.max("activity_day"), 1).alias("last"))
    out = features.dense_day(rows.crossJoin(F.broadcast(last)), "camera_id", "activity_day", F.col("k") < 3, F.col("last"))  # one row
    return out.select("camera_id", F.col("day").cast("string").alias("day"))


@query(f"""WITH {CLIPS}, t AS (SELECT clip_id FROM clips ORDER BY k DESC, clip_id LIMIT 40), r AS (SELECT clip_id FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM t) ORDER BY sha256('rest|' || clip_id), clip_id LIMIT 20)
SELECT clip_id, 'top' AS part FROM t UNION ALL SELECT clip_id, 'rest' FROM r""")
def top_and_rest(spark, sf_dir):
    rows = clips(spark, sf_dir).select("clip_id", "k")
    top = rows.orderBy(F.desc("k"), "clip_id").limit(40).select("clip_id")
    rest = sampling.hashed(rows.join(top, "clip_id", "left_anti"), "rest", "clip_id").orderBy("draw", "clip_id").limit(20).select("clip_id")
    return top.withColumn("part", F.lit("top")).unionByName(rest.withColumn("part", F.lit("rest")))


@query(f"""WITH {CLIPS}, a AS (SELECT clip_id, us, 1 AS p FROM clips ORDER BY us DESC, clip_id DESC LIMIT 60), b AS (SELECT clip_id, us + CASE WHEN clip_id % 2 = 0 THEN 1 ELSE 0 END AS us, 0 AS p FROM clips WHERE camera_id < 5 ORDER BY us DESC, clip_id DESC LIMIT 60),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT clip_id, us FROM u QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY p) = 1""")
def merged_pages(spark, sf_dir):
    """Two pages in one list, newest first; of a clip in both the incoming row counts."""
    rows = clips(spark, sf_dir).select("clip_id", "us", "camera_id")
    page = lambda df: df.orderBy(F.desc("us"), F.desc("clip_id")).limit(60)
    base = page(rows.drop("camera_id")).withColumn("p", F.lit(1))
    incoming = page(rows.filter("camera_id < 5").select("clip_id", (F.col("us") + F.when(F.col("clip_id") % 2 == 0, 1).otherwise(0)).alias("us"))).withColumn("p", F.lit(0))
    return base.unionByName(incoming).groupBy("clip_id").agg(F.min_by("us", "p").alias("us")).orderBy(F.desc("us"), F.desc("clip_id"))


@query("""WITH c AS (SELECT event_id AS clip_id, epoch_us(ts) AS updated_us FROM events WHERE event_type = 'click') SELECT clip_id, updated_us FROM c WHERE (updated_us, clip_id) < (1706000000000000, 100) ORDER BY updated_us DESC, clip_id DESC LIMIT 26""")
def conflict_page(spark, sf_dir):
    from ..functions.times import micros
    from ..operators.queues import page

    rows = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("event_id").alias("clip_id"), micros(F.col("ts")).alias("updated_us"))
    return page(rows, "updated_us", "clip_id", (1_706_000_000_000_000, 100), 25)


@query(f"""WITH {CLIPS} SELECT clip_id, base64(encode('{{"v":1,"t":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","id":"' || clip_id || '"}}')) AS token, clip_id AS back_id, us AS back_us FROM clips""")
def cursor_codec(spark, sf_dir):
    """Opaque page cursors and what is read back from them; times keep their microseconds."""
    body = F.to_json(F.struct(F.lit(1).alias("v"), F.concat(F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("t"), F.col("clip_id").cast("string").alias("id")))
    told = clips(spark, sf_dir).select("clip_id", F.base64(F.encode(body, "UTF-8")).alias("token"))
    read = F.from_json(F.decode(F.unbase64("token"), "UTF-8"), "v int, t string, id string")
    return told.withColumn("r", read).select("clip_id", "token", F.col("r.id").cast("long").alias("back_id"), F.unix_micros(F.col("r.t").try_cast("timestamp")).alias("back_us"))


#: The cursor of a clip for the scope of its camera; ids look like UUIDs.
SCOPED = f"""{CLIPS}, c AS (SELECT clip_id, us, camera_id, 'owner:' || camera_id || '|label=é' AS scope, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS t, md5(CAST(clip_id AS VARCHAR)) AS m FROM clips),
h AS (SELECT scope, printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(scope, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda h, x: CAST((xor(h, x) * 16777619::BIGINT) % 4294967296::BIGINT AS BIGINT))) AS s FROM (SELECT DISTINCT scope FROM c)),
k AS (SELECT c.*, s, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21) AS id FROM c JOIN h USING (scope))"""


@query(f"""WITH {SCOPED} SELECT clip_id, rtrim(translate(base64(encode('{{"v":1,"t":"' || t || '","id":"' || id || '","s":"' || s || '"}}')), '+/', '-_'), '=') AS token, CASE WHEN camera_id % 3 <> 0 THEN id END AS back_id, CASE WHEN camera_id % 3 <> 0 THEN us END AS back_us FROM k""")
def scoped_cursors(spark, sf_dir):
    """Cursors that hold for one scope, and what is read from them: nothing where the scope is another (every third camera)."""
    m = F.md5(F.col("clip_id").cast("string"))
    key = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    at = F.concat(F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    scope = F.concat(F.lit("owner:"), F.col("camera_id").cast("string"), F.lit("|label=é"))
    told = clips(spark, sf_dir).select("clip_id", "camera_id", scope.alias("scope"), cursors.encoded(at, key, scope).alias("token"))
    asked = F.when(F.col("camera_id") % 3 != 0, F.col("scope")).otherwise(F.concat("scope", F.lit("!")))
    return told.withColumn("r", cursors.decoded(F.col("token"), asked)).select("clip_id", "token", F.col("r.id").alias("back_id"), F.unix_micros(F.col("r.t").try_cast("timestamp")).alias("back_us"))


@query("""SELECT doc_id, a.quality, b.toxic FROM (SELECT DISTINCT doc_id, quality FROM labels WHERE quality = 1) a JOIN (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic = 0) b USING (doc_id)""")
def paired_keys(spark, sf_dir):
    """Keys that both sides have."""
    rows = table(spark, sf_dir, "labels")
    return rows.filter("quality = 1").select("doc_id", "quality").distinct().join(rows.filter("toxic = 0").select("doc_id", "toxic").distinct(), "doc_id")


@query("""WITH k AS (SELECT p_partkey AS key, unnest(CASE WHEN p_partkey % 6 = 0 THEN [0, 1, 2] ELSE [0] END) AS run FROM part), d AS (SELECT key, run, sha256('runs|' || key || '|' || run) AS draw FROM k)
SELECT key || '#run' || run AS measured_key, key, run FROM d""")
def repeat_runs(spark, sf_dir):
    """One run of every key and two more of those to repeat; a run's place is its number first, so a key's runs are never
    neighbours as long as two keys are repeated."""
    key = F.col("p_partkey")
    runs = F.when(key % 6 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    out = table(spark, sf_dir, "part").select(key.alias("key"), F.explode(runs).alias("run")).withColumn("draw", digest("runs", F.col("key"), F.col("run")))
    return out.orderBy("run", "draw").select(F.concat(F.col("key").cast("string"), F.lit("#run"), F.col("run").cast("string")).alias("measured_key"), "key", "run")


@query("""WITH k AS (SELECT p_partkey AS key, unnest(CASE WHEN p_partkey % 6 = 0 THEN [0, 1, 2] ELSE [0] END) AS run FROM part), z AS (SELECT key, count(*) AS n, sha256('runs|spread|' || key) AS draw FROM k GROUP BY 1),
t AS (SELECT draw AS top FROM z ORDER BY n DESC, draw DESC LIMIT 1), r AS (SELECT k.key, run, row_number() OVER (ORDER BY CASE WHEN draw = top THEN 0 ELSE 1 END, draw, k.key, run) - 1 AS r, (count(*) OVER () + 1) // 2 AS half FROM k JOIN z USING (key), t)
SELECT key, run, CASE WHEN r < half THEN 2 * r ELSE 2 * (r - half) + 1 END AS place FROM r""")
def spread_runs(spark, sf_dir):
    """Runs in an order in which no key follows itself."""
    key = F.col("p_partkey")
    runs = F.when(key % 6 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    return selection.spread_runs(table(spark, sf_dir, "part").select(key.alias("key"), F.explode(runs).alias("run")), "key", "run", "runs")


@query(f"""WITH {CLIPS}, e AS (SELECT clip_id, CASE clip_id % 3 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'restored' ELSE 'candidate' END AS state, 'old' AS reason FROM clips WHERE k < 30),
n AS (SELECT clip_id, CASE WHEN media_key IS NULL THEN 'r2_key_missing' WHEN k % 11 = 0 THEN 'r2_object_absent' END AS reason FROM clips WHERE media_key IS NULL OR k % 11 = 0)
SELECT coalesce(e.clip_id, n.clip_id) AS clip_id, CASE WHEN e.state IN ('candidate', 'quarantined', 'media_deleted', 'deletion_blocked') OR n.reason IS NULL THEN e.state ELSE 'media_deleted' END AS state,
  CASE WHEN e.state IN ('candidate', 'quarantined', 'media_deleted', 'deletion_blocked') OR n.reason IS NULL THEN e.reason ELSE n.reason END AS reason FROM e FULL JOIN n ON e.clip_id = n.clip_id""")
def merged_exclusions(spark, sf_dir):
    from ..operators.state import merge_exclusions

    c = clips(spark, sf_dir)
    n = F.col("clip_id") % 3
    old = c.filter("k < 30").select("clip_id", F.when(n == 0, "quarantined").when(n == 1, "restored").otherwise("candidate").alias("state"), F.lit("old").alias("reason"))
    categories = {"r2_key_missing": c.filter("media_key IS NULL").select("clip_id"), "r2_object_absent": c.filter("media_key IS NOT NULL AND k % 11 = 0").select("clip_id")}
    return merge_exclusions(old, categories)


@query("""WITH a AS (SELECT doc_id, lang FROM documents), b AS (SELECT doc_id FROM labels), d AS (SELECT (SELECT count(*) FROM a) AS n_all, (SELECT count(*) FROM b) AS n_part, (SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a)) AS outside, (SELECT count(*) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS rest)
SELECT *, outside = 0 AS is_subset, n_all - n_part = rest AS difference_holds FROM d""")
def dataset_consistency(spark, sf_dir):
    """Sizes of a data set and its part, whether the part lies inside, and whether the rest is as large as it should be."""
    a = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.count("*").alias("a"))
    b = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    one = a.join(b, "doc_id", "full").agg(F.sum(zero("a")).alias("n_all"), F.sum(zero("b")).alias("n_part"), F.sum(F.when(zero("a") == 0, zero("b")).otherwise(0)).alias("outside"), F.sum(F.when(zero("b") == 0, zero("a")).otherwise(0)).alias("rest"))
    return one.withColumns({"is_subset": F.col("outside") == 0, "difference_holds": F.col("n_all") - F.col("n_part") == F.col("rest")})


TEXTS = """j AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '{"a": 1, "b": "x"}' WHEN 1 THEN '[1, 2]' WHEN 2 THEN '"s"' WHEN 3 THEN 'true' WHEN 4 THEN '3.5' WHEN 5 THEN '{"b": "x", "a": 1}' ELSE '{broken' END AS body FROM events)"""


def bodies(spark, sf_dir):
    n = F.col("event_id") % 7
    body = F.when(n == 0, '{"a": 1, "b": "x"}').when(n == 1, "[1, 2]").when(n == 2, '"s"').when(n == 3, "true").when(n == 4, "3.5").when(n == 5, '{"b": "x", "a": 1}').otherwise("{broken")
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))


@query(f"""WITH {TEXTS} SELECT event_id, CASE WHEN json_valid(body) THEN CASE json_type(body::JSON) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind,
  CASE WHEN json_valid(body) AND json_type(body::JSON) = 'OBJECT' AND list_sort(json_keys(body::JSON)) = ['a', 'b'] AND json_type(body::JSON, '$.a') = 'UBIGINT' AND json_type(body::JSON, '$.b') = 'VARCHAR' AND length(json_extract_string(body::JSON, '$.b')) <= 5 THEN true END AS strict_ok FROM j""")
def json_kinds(spark, sf_dir):
    parsed = documents.strict(F.col("body"), "a int, b string", ["a", "b"], lambda s: (s["a"] >= 0) & (F.length(s["b"]) <= 5))
    return bodies(spark, sf_dir).select("event_id", documents.kind_of(F.col("body")).alias("kind"), F.when(parsed.isNotNull(), True).alias("strict_ok"))


@query("""WITH r AS (SELECT c_custkey AS id, [{'clip': c_custkey * 2, 'conf': 0.5::DOUBLE}, {'clip': c_custkey * 2 + 1, 'conf': 0.25}] AS rs FROM customer), u AS (SELECT id, unnest(rs) AS x FROM r) SELECT id, x.clip AS clip, x.conf AS conf FROM u""")
def json_records(spark, sf_dir):
    """Records of a JSON array in a column, as rows."""
    n = F.col("c_custkey")
    body = F.concat(F.lit('[{"clip": '), (n * 2).cast("string"), F.lit(', "conf": 0.5}, {"conf": 0.25, "clip": '), (n * 2 + 1).cast("string"), F.lit("}]"))
    rows = table(spark, sf_dir, "customer").select(n.alias("id"), body.alias("body"))
    return rows.select("id", F.inline(documents.records(F.col("body"), "array<struct<clip: long, conf: double>>")))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn DESC) AS roles, '{' || string_agg('"t' || turn || '":' || length(text), ',' ORDER BY 't' || turn) || '}' AS lengths, '{"conv":' || conv_id || ',"n":' || count(*) || '}' AS head FROM conversations GROUP BY 1""")
def json_aggregates(spark, sf_dir):
    """Ordered list, object by key, and an object built of values."""
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        documents.ordered_list(F.col("role"), -F.col("turn")).alias("roles"),
        documents.object_of(F.concat(F.lit("t"), F.col("turn").cast("string")), F.length("text")).alias("lengths"),
        F.count("*").alias("n"),
    )
    return out.select("conv_id", F.array_join("roles", ",").alias("roles"), "lengths", F.to_json(F.struct(F.col("conv_id").alias("conv"), "n")).alias("head"))


@query(f"""WITH {TEXTS} SELECT event_id, coalesce(CASE WHEN json_valid(body) AND json_type(body::JSON) = 'OBJECT' THEN list_sort(json_keys(body::JSON)) = ['a', 'b'] AND json_extract(body::JSON, '$.a') = '1'::JSON AND json_extract(body::JSON, '$.b') = '"x"'::JSON END, false) AS same FROM j""")
def json_equality(spark, sf_dir):
    """Equality with a document whose keys are in another order."""
    shape = "a int, b string"
    return bodies(spark, sf_dir).select("event_id", F.coalesce(documents.same_document(F.col("body"), F.lit('{"b":"x","a":1}'), shape), F.lit(False)).alias("same"))


@query("""WITH g AS (SELECT vec_id, list_transform(range(0, 4), lambda r: embedding[r * 4 + 1:r * 4 + 4]) AS grid FROM embeddings)
SELECT vec_id, round((CAST(grid[1][1] AS DOUBLE) + CAST(grid[3][2] AS DOUBLE) + CAST(grid[4][4] AS DOUBLE)) * (vec_id % 5), 3) + 0 AS cells FROM g""")
def matrix_cells(spark, sf_dir):
    grid = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice(F.col("embedding"), r * 4 + 1, F.lit(4)))
    places = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (2, 1), (3, 3), (9, 9))])
    return table(spark, sf_dir, "embeddings").select("vec_id", documents.cells_sum(grid, places, F.col("vec_id") % 5).alias("cells"))


@query("""WITH d AS (SELECT l_orderkey AS frame, l_returnflag AS label, l_discount * 10 AS score, CAST(l_partkey % 90 AS DOUBLE) AS x0, CAST(l_suppkey % 80 AS DOUBLE) AS y0, CAST(l_partkey % 90 + 5 AS DOUBLE) AS x1, CAST(l_suppkey % 80 + 7 AS DOUBLE) AS y1 FROM lineitem)
SELECT frame, min(x0) FILTER (WHERE label = 'R' AND score >= 0.5) AS x0, min(y0) FILTER (WHERE label = 'R' AND score >= 0.5) AS y0, max(x1) FILTER (WHERE label = 'R' AND score >= 0.5) AS x1, max(y1) FILTER (WHERE label = 'R' AND score >= 0.5) AS y1 FROM d GROUP BY 1""")
def nested_boxes(spark, sf_dir):
    """Box around the sure detections of a class inside a frame's nested list; null for none."""
    p, s = F.col("l_partkey") % 90, F.col("l_suppkey") % 80
    real = lambda c: c.cast("double")
    found = F.struct(F.col("l_returnflag").alias("label"), (F.col("l_discount") * 10).alias("score"), real(p).alias("x0"), real(s).alias("y0"), real(p + 5).alias("x1"), real(s + 7).alias("y1"))
    frames = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.collect_list(found).alias("found"))
    return frames.select("frame", documents.union_box(F.col("found"), F.lit("R"), 0.5).alias("b")).select("frame", "b.x0", "b.y0", "b.x1", "b.y1")
