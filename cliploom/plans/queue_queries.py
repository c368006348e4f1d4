"""Queries on queues, joins, ledgers, sets and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, text, times
from ..functions.ratios import ratio
from ..operators import audit, queues, sampling, state
from ..sources.tables import assessments, clips, exclusions, jobs, predictions, table
from .registry import ASSESSMENTS, CLIPS, EXCLUSIONS, JOBS, PREDICTIONS, query

LOGS = "logs AS (SELECT event_id AS clip_id, CASE WHEN event_id % 2 = 0 THEN 'moving' ELSE 'feeding' END AS action FROM events WHERE event_id % 3 = 0)"


def logs(spark, sf_dir):
    action = F.when(F.col("event_id") % 2 == 0, "moving").otherwise("feeding")
    return table(spark, sf_dir, "events").filter("event_id % 3 = 0").select(F.col("event_id").alias("clip_id"), action.alias("action"))


@query(f"WITH {CLIPS}, {LOGS} SELECT clip_id, us FROM clips c WHERE has_motion AND media_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM logs l WHERE l.clip_id = c.clip_id) ORDER BY us, clip_id LIMIT 200")
def pending_poll(spark, sf_dir):
    return queues.pending(clips(spark, sf_dir), logs(spark, sf_dir), 200).select("clip_id", "us")


@query(f"WITH {CLIPS}, {EXCLUSIONS} SELECT clip_id, us FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM exclusions WHERE state IN ('quarantined', 'media_deleted')) ORDER BY us DESC, clip_id DESC LIMIT 31")
def label_queue_page1(spark, sf_dir):
    return queues.page(queues.visible(clips(spark, sf_dir), exclusions(spark, sf_dir)), "us", "clip_id", None, 30).select("clip_id", "us")


CURSOR = (1_705_500_000_000_000, 5000)


@query(f"WITH {CLIPS}, {EXCLUSIONS} SELECT clip_id, us FROM clips WHERE clip_id NOT IN (SELECT clip_id FROM exclusions WHERE state IN ('quarantined', 'media_deleted')) AND (us, clip_id) < {CURSOR} ORDER BY us DESC, clip_id DESC LIMIT 31")
def label_queue_page2(spark, sf_dir):
    return queues.page(queues.visible(clips(spark, sf_dir), exclusions(spark, sf_dir)), "us", "clip_id", CURSOR, 30).select("clip_id", "us")


@query(f"WITH {CLIPS}, {LOGS} SELECT count(*) FILTER (WHERE l.clip_id IS NULL) AS without_log, count(*) FILTER (WHERE l.clip_id IS NOT NULL) AS with_log, count(*) FILTER (WHERE l.action = 'feeding') AS feeding FROM clips c LEFT JOIN logs l USING (clip_id)")
def has_log_filter(spark, sf_dir):
    c, l = clips(spark, sf_dir), logs(spark, sf_dir)
    counted = lambda rows, name: rows.agg(F.count("*").alias(name))
    parts = [counted(queues.logged(c, l, False), "without_log"), counted(queues.logged(c, l, True), "with_log"), counted(queues.logged(c, l, None, ["feeding"]), "feeding")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


@query(f"WITH {PREDICTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY line DESC, price DESC, model, pred) AS nth FROM predictions) SELECT clip_id, line, model, pred FROM n WHERE nth = 1")
def latest_prediction_per_clip(spark, sf_dir):
    return queues.latest(predictions(spark, sf_dir), "clip_id", F.desc("line"), F.desc("price"), F.col("model"), F.col("pred")).select("clip_id", "line", "model", "pred")


@query("""WITH a AS (SELECT doc_id, CAST(quality AS VARCHAR) AS v FROM labels), b AS (SELECT doc_id, lang AS v FROM documents)
SELECT doc_id, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM a FULL JOIN b USING (doc_id)""")
def highlight_union(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("v"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("v"))
    return queues.prefer(a, b, "doc_id", "v")


@query(f"""WITH {CLIPS}, {EXCLUSIONS}, {ASSESSMENTS}, {LOGS}
SELECT c.clip_id, CASE WHEN e.state = 'media_deleted' THEN 'gone' WHEN e.state = 'quarantined' THEN 'hidden' WHEN l.action IS NOT NULL AND a.decision = 'active' THEN 'agreed'
  WHEN l.action IS NOT NULL AND a.decision IS NOT NULL THEN 'conflict' WHEN l.action IS NOT NULL THEN 'single' WHEN a.decision IS NOT NULL THEN 'awaiting' ELSE 'unlabelled' END AS class,
  CASE WHEN l.action IS NOT NULL AND a.decision = 'active' THEN l.action END AS shown
FROM clips c LEFT JOIN exclusions e USING (clip_id) LEFT JOIN assessments a USING (clip_id) LEFT JOIN logs l USING (clip_id)""")
def library_classified(spark, sf_dir):
    rows = clips(spark, sf_dir).join(exclusions(spark, sf_dir), "clip_id", "left").join(assessments(spark, sf_dir), "clip_id", "left").join(logs(spark, sf_dir), "clip_id", "left")
    acted, active = F.col("action").isNotNull(), F.col("decision") == "active"
    rules = {
        "gone": F.col("state") == "media_deleted",
        "hidden": F.col("state") == "quarantined",
        "agreed": acted & active,
        "conflict": acted & F.col("decision").isNotNull(),
        "single": acted,
        "awaiting": F.col("decision").isNotNull(),
        "unlabelled": F.lit(True),
    }
    return rows.select("clip_id", arrays.first_issue(rules).alias("class"), F.when(acted & active, F.col("action")).alias("shown"))


@query(f"WITH {CLIPS} SELECT clip_id, r.reviewer FROM clips, (VALUES ('owner'), ('peer')) r(reviewer)")
def slots_cross_join(spark, sf_dir):
    """Two slots a clip: a fixed array, unnested."""
    return clips(spark, sf_dir).select("clip_id", F.explode(F.array(F.lit("owner"), F.lit("peer"))).alias("reviewer"))


@query("SELECT status, count(*) AS n, count(*) FILTER (WHERE priority <= 2) AS urgent, coalesce(min(created_us) FILTER (WHERE priority = 1), 0) AS oldest_urgent FROM jobs GROUP BY status".join(["WITH " + JOBS + " ", ""]))
def ops_stats_filter(spark, sf_dir):
    return jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("priority") <= 2).alias("urgent"), F.coalesce(F.min(F.when(F.col("priority") == 1, F.col("created_us"))), F.lit(0)).alias("oldest_urgent"))


@query(f"""WITH {JOBS}, s AS (SELECT owner_id, CAST(coalesce(sum(CAST(cost AS DECIMAL(18, 2))) FILTER (WHERE status = 'done'), 0) AS DOUBLE) AS spent,
  CAST(coalesce(sum(CAST(cost AS DECIMAL(18, 2))) FILTER (WHERE status IN ('queued', 'leased')), 0) AS DOUBLE) AS reserved, CAST(max(CAST(cost AS DECIMAL(18, 2))) AS DOUBLE) AS largest FROM jobs GROUP BY 1)
SELECT *, spent + reserved + largest <= 2000000 AS fits FROM s""")
def budget_admission(spark, sf_dir):
    return state.admitted(jobs(spark, sf_dir), 2_000_000.0, "owner_id")



CLAIM_AT = 852_076_800_000_000


@query(f"WITH {JOBS} SELECT job_id, priority, created_us FROM jobs WHERE (status = 'queued' OR (status = 'leased' AND lease_us <= {CLAIM_AT})) AND attempt < 3 ORDER BY priority DESC, created_us, job_id LIMIT 100")
def claim_order(spark, sf_dir):
    return queues.claimable(jobs(spark, sf_dir), CLAIM_AT, 3, 100).select("job_id", "priority", "created_us")


@query(f"""WITH {JOBS}, o AS (SELECT *, status = 'leased' AND lease_us <= {CLAIM_AT} AS late FROM jobs)
SELECT job_id, CASE WHEN late AND attempt + 1 >= 4 THEN 'failed' WHEN late THEN 'queued' ELSE status END AS next_status, CASE WHEN late THEN attempt + 1 ELSE attempt END AS next_attempt,
       CASE WHEN late AND attempt + 1 < 4 THEN {CLAIM_AT} + 60000000 * CAST(pow(2, attempt) AS BIGINT) END AS next_us FROM o""")
def lease_reclaim(spark, sf_dir):
    return state.reclaimed(jobs(spark, sf_dir), CLAIM_AT, 4).select("job_id", "next_status", "next_attempt", "next_us")


DETECT_AT = 1_707_000_000_000_000
#: Detections of the short-clip rule in SQL: policies of cameras, what people have worked on, and where each clip stands.
DETECTED = f"""{CLIPS}, {EXCLUSIONS}, pol AS (SELECT camera_id, camera_id % 3 <> 0 AS enabled, CASE WHEN camera_id % 4 <> 1 THEN 15.0 + camera_id END AS under_sec, 'v' || camera_id AS version, 100 + camera_id AS hours,
  CASE WHEN camera_id = 2 THEN [] ELSE [camera_id, camera_id + 2, 5, 9] END AS seconds FROM (SELECT DISTINCT camera_id FROM clips WHERE camera_id < 8)),
d AS (SELECT c.clip_id, c.camera_id, duration_sec, c.clip_id % 4 <> 0 AS write, e.state AS now, CAST(floor(duration_sec + 0.5) AS INTEGER) AS displayed, coalesce(hours, 168) AS hours, coalesce(version, 'short-device-error-v1') AS version,
  coalesce(duration_sec < coalesce(under_sec, 15), false) AS short, coalesce(enabled AND list_contains(seconds, CAST(floor(duration_sec + 0.5) AS INTEGER)), false) AS match, c.k % 5 = 0 AS kept
  FROM clips c LEFT JOIN pol USING (camera_id) LEFT JOIN exclusions e USING (clip_id)),
t AS (SELECT *, CASE WHEN match AND kept THEN 'protected' WHEN match THEN 'quarantined' ELSE 'candidate' END AS target, CASE WHEN match AND kept THEN 'deletion_blocked' WHEN match THEN 'quarantined' ELSE 'candidate' END AS ought FROM d),
detected AS (SELECT clip_id,
  CASE WHEN NOT short THEN 'ineligible' WHEN NOT write THEN target WHEN now = 'restored' THEN 'reused_restored' WHEN now IN ('media_deleted', 'quarantined', 'deletion_blocked') THEN 'reused' WHEN target = 'candidate' AND now IS NOT NULL THEN 'reused' ELSE target END AS route,
  CASE WHEN NOT short THEN 'none' WHEN NOT write THEN ought WHEN now IN ('restored', 'media_deleted', 'quarantined', 'deletion_blocked') THEN now ELSE ought END AS state,
  CASE WHEN short AND write AND (now IS NULL OR (now = 'candidate' AND target <> 'candidate')) THEN CASE target WHEN 'quarantined' THEN 'auto_quarantined' WHEN 'protected' THEN 'delete_blocked' ELSE 'candidate_detected' END END AS event, now, ought, version, displayed, hours, target FROM t)"""


def detections(spark, sf_dir):
    c = clips(spark, sf_dir)
    camera = F.col("camera_id")
    policies = c.filter("camera_id < 8").select("camera_id").distinct().select(
        "camera_id", (camera % 3 != 0).alias("enabled"), F.when(camera % 4 != 1, camera + 15.0).alias("under_sec"), F.concat(F.lit("v"), camera.cast("string")).alias("version"), (camera + 100).alias("hours"),
        F.when(camera == 2, F.array().cast("array<int>")).otherwise(F.array(camera.cast("int"), (camera + 2).cast("int"), F.lit(5), F.lit(9))).alias("seconds"),
    )
    worked_on = c.filter("k % 5 = 0").select("clip_id")
    return state.short_clip_detection(c, policies, exclusions(spark, sf_dir), worked_on, DETECT_AT, F.col("clip_id") % 4 != 0)


@query(f"""WITH {DETECTED} SELECT clip_id, route, state, CASE WHEN event = 'auto_quarantined' THEN {DETECT_AT} + hours * 3600000000 END AS delete_after_us FROM detected""")
def short_clip_state_machine(spark, sf_dir):
    """A detection run over all clips; a quarter of them in shadow mode, which answers and does not write."""
    return detections(spark, sf_dir).select("clip_id", "route", "state", "delete_after_us")


@query(f"WITH {CLIPS} SELECT camera_id, arg_max(event_type, (us, clip_id)) AS state, count(*) AS n_events FROM clips GROUP BY 1")
def ledger_fold(spark, sf_dir):
    return state.folded(clips(spark, sf_dir), "camera_id", "event_type", "us", "clip_id")


@query(f"WITH {CLIPS}, {LOGS} SELECT k, min(clip_id) AS clip_id FROM clips WHERE k NOT IN (SELECT clip_id FROM logs) GROUP BY k")
def claim_once(spark, sf_dir):
    return state.first_time(clips(spark, sf_dir).select("k", "clip_id"), logs(spark, sf_dir).select(F.col("clip_id").alias("k")), "k", "clip_id")


@query("""WITH a AS (SELECT DISTINCT o_custkey % 400 AS x FROM orders), b AS (SELECT DISTINCT l_suppkey * 3 AS x FROM lineitem)
SELECT x, 'first' AS side FROM (SELECT x FROM a EXCEPT SELECT x FROM b) UNION ALL SELECT x, 'second' FROM (SELECT x FROM b EXCEPT SELECT x FROM a)""")
def symmetric_except(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("x"))
    return audit.symmetric_difference(a, table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 3).alias("x")))


@query("""WITH j AS (SELECT d.doc_id AS d, l.doc_id AS l FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id)
SELECT count(*) FILTER (WHERE l IS NULL) AS missing, count(*) FILTER (WHERE d IS NULL) AS unexpected, count(*) FILTER (WHERE d IS NOT NULL AND l IS NOT NULL) AS common,
       count(*) FILTER (WHERE l IS NULL) = 0 AND count(*) FILTER (WHERE d IS NULL) = 0 AS complete FROM j""")
def key_difference_report(spark, sf_dir):
    return audit.key_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {CLIPS} SELECT clip_id FROM clips WHERE media_key IS NULL UNION SELECT clip_id FROM clips WHERE duration_sec < 1")
def union_invalid_ids(spark, sf_dir):
    c = clips(spark, sf_dir)
    return c.filter("media_key IS NULL").select("clip_id").union(c.filter("duration_sec < 1").select("clip_id")).distinct()


@query("""WITH d AS (SELECT doc_id, lang, sha256('one|' || doc_id) AS h FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS nth FROM d)
SELECT doc_id, lang, CAST(nth AS INTEGER) AS nth FROM n WHERE nth <= 3""")
def one_per_class_fill(spark, sf_dir):
    return sampling.per_stratum(table(spark, sf_dir, "documents").select("doc_id", "lang"), "one", "doc_id", ["lang"], 3).select("doc_id", "lang", "nth")


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('split|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= greatest(1, n * 70 // 100) THEN 'first' ELSE 'second' END AS part FROM d""")
def hash_split_70_30(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"), "split", "doc_id", 70).select("doc_id", "part")


@query(f"""WITH {CLIPS}, n AS (SELECT clip_id, camera_id, event_type, row_number() OVER (PARTITION BY camera_id, event_type ORDER BY sha256('rr|' || clip_id), clip_id) AS nth,
  sha256('rr|' || camera_id || '|' || event_type) AS stratum FROM clips)
SELECT clip_id, camera_id, event_type FROM n WHERE nth <= 5 ORDER BY nth, stratum, clip_id LIMIT 120""")
def round_robin_strata(spark, sf_dir):
    rows = clips(spark, sf_dir).select("clip_id", "camera_id", "event_type")
    return sampling.round_robin(rows, "rr", "clip_id", ["camera_id", "event_type"], 5, 120).select("clip_id", "camera_id", "event_type")


@query(f"""WITH {CLIPS}, q AS (SELECT clip_id, activity_day, ntile(4) OVER (PARTITION BY activity_day ORDER BY duration_sec, clip_id) AS quarter FROM clips),
n AS (SELECT *, row_number() OVER (PARTITION BY activity_day, quarter ORDER BY sha256('q4|' || clip_id), clip_id) AS nth FROM q)
SELECT clip_id, CAST(activity_day AS VARCHAR) AS activity_day, CAST(quarter AS INTEGER) AS quarter FROM n WHERE nth <= 5""")
def quartile_hash_sample(spark, sf_dir):
    out = sampling.quartile_sample(clips(spark, sf_dir).select("clip_id", "activity_day", "duration_sec"), "q4", "clip_id", ["activity_day"], "duration_sec", 5)
    return out.select("clip_id", F.col("activity_day").cast("string").alias("activity_day"), "quarter")


@query("""WITH r AS (SELECT text, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'test' END AS part FROM documents), s AS (SELECT md5(text) AS key, count(*) AS n, count(DISTINCT part) AS p FROM r GROUP BY 1)
SELECT 'both_parts' AS code, key FROM s WHERE p > 1 UNION ALL SELECT 'duplicate', key FROM s WHERE n > p""")
def holdout_leakage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("key"), F.when(F.col("doc_id") % 3 == 0, "dev").otherwise("test").alias("part"))
    return audit.leakage(rows, "key", "part")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, CASE WHEN contains(url, '#') THEN true WHEN contains(url, '?') THEN false END AS anchored FROM pages")
def object_key_parse(spark, sf_dir):
    url = F.col("url")
    anchored = F.when(F.contains(url, F.lit("#")), True).when(F.contains(url, F.lit("?")), False)
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(url, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(url, "^https?://[^/]+/([a-z]{2})/", 1).alias("lang"), anchored.alias("anchored"))


@query(r"""WITH n AS (SELECT page_id, substr(trim(regexp_replace(regexp_replace(url, '[:/.?&=#]+', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')), 1, 60) AS s, regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g') AS slug FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'unknown' ELSE s END AS squeezed, slug FROM n""")
def text_normalise(spark, sf_dir):
    words = F.regexp_replace("url", "[:/.?&=#]+", " ")
    return table(spark, sf_dir, "pages").select("page_id", text.squeezed(words).alias("squeezed"), text.slug(F.col("url")).alias("slug"))


@query("""WITH d AS (SELECT json_extract_string(props, '$.k') AS k, event_type FROM events) SELECT event_type, k, count(*) AS n FROM d WHERE k IS NOT NULL AND k <> '' GROUP BY 1, 2""")
def dashboard_behaviour_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("k"))
    return rows.filter("k IS NOT NULL AND k <> ''").groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_nationkey AS nation, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS balance FROM customer GROUP BY 1),
o AS (SELECT c_nationkey AS nation, count(*) AS orders, max(epoch_us(o_orderdate)) AS last_us FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
s AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT n_name, r_name, coalesce(customers, 0) AS customers, coalesce(orders, 0) AS orders, coalesce(suppliers, 0) AS suppliers, balance, last_us
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN c ON c.nation = n_nationkey LEFT JOIN o ON o.nation = n_nationkey LEFT JOIN s ON s.nation = n_nationkey""")
def owner_overview(spark, sf_dir):
    """Counts of an owner's parts, each table aggregated before it is joined."""
    customer, orders, supplier = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    c = customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))
    o = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("orders"), F.max(times.micros(F.col("o_orderdate"))).alias("last_us"))
    s = supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    base = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("nation", F.col("n_nationkey"))
    out = base.join(c, "nation", "left").join(o, "nation", "left").join(s, "nation", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return out.select("n_name", "r_name", zero("customers"), zero("orders"), zero("suppliers"), "balance", "last_us")


@query(f"""WITH {CLIPS} SELECT camera_id, CAST(max(activity_day) FILTER (WHERE k < 50) AS VARCHAR) AS priority_day, count(*) FILTER (WHERE k < 50) AS own, count(*) FILTER (WHERE k >= 50) AS partner,
  array_to_string(list_sort(list(DISTINCT CAST(activity_day AS VARCHAR)) FILTER (WHERE k < 3), 'DESC'), ',') AS days FROM clips GROUP BY 1""")
def workspace_summary(spark, sf_dir):
    day, own = F.col("activity_day"), F.col("k") < 50
    return clips(spark, sf_dir).groupBy("camera_id").agg(
        F.max(F.when(own, day)).cast("string").alias("priority_day"),
        F.count_if(own).alias("own"),
        F.count_if(~own).alias("partner"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("k") < 3, day.cast("string"))), asc=False), ",").alias("days"),
    )


@query("""SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn) AS roles, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1""")
def segment_arrays(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(ordered, lambda x: x["role"]), ">").alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("""WITH l AS (SELECT l_orderkey AS clip_id, l_linenumber AS line, l_returnflag AS decision, CASE WHEN l_quantity < 25 THEN 'low' ELSE 'high' END AS intensity, CASE WHEN l_discount < 0.05 THEN 'near' ELSE 'far' END AS target, l_linestatus AS vis FROM lineitem),
p AS (SELECT a.clip_id, a.decision = b.decision AS d, a.intensity = b.intensity AS i, a.target = b.target AS t, a.vis = b.vis AS v FROM l a JOIN l b ON a.clip_id = b.clip_id AND a.line = 1 AND b.line = 2)
SELECT clip_id, CASE WHEN d AND i AND t AND v THEN 'agreed' ELSE 'conflict' END AS status,
  array_to_string(list_filter([CASE WHEN NOT d THEN 'decision' END, CASE WHEN NOT i THEN 'intensity' END, CASE WHEN NOT t THEN 'target' END, CASE WHEN NOT v THEN 'visibility' END], lambda x: x IS NOT NULL), ',') AS differing FROM p""")
def blind_comparator(spark, sf_dir):
    """Fields in which two reviewers of a clip differ, in the order of the form."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("clip_id"),
        F.col("l_linenumber").alias("line"),
        F.struct(
            F.col("l_returnflag").alias("decision"),
            F.when(F.col("l_quantity") < 25, "low").otherwise("high").alias("intensity"),
            F.when(F.col("l_discount") < 0.05, "near").otherwise("far").alias("target"),
            F.col("l_linestatus").alias("visibility"),
        ).alias("form"),
    )
    a, b = (rows.filter(F.col("line") == n).select("clip_id", F.col("form").alias(f"f{n}")) for n in (1, 2))
    names = ["decision", "intensity", "target", "visibility"]
    differing = arrays.changed({n: (F.col(f"f1.{n}"), F.col(f"f2.{n}")) for n in names})
    return a.join(b, "clip_id").select("clip_id", differing.alias("d")).select("clip_id", F.when(F.size("d") == 0, "agreed").otherwise("conflict").alias("status"), F.array_join("d", ",").alias("differing"))


@query("""WITH l AS (SELECT l_orderkey AS pair_id, l_returnflag AS decision, l_suppkey AS reviewer FROM lineitem WHERE l_linenumber <= 2)
SELECT pair_id, count(*) AS n, count(DISTINCT decision) AS decisions FROM l GROUP BY 1 HAVING count(*) = 2 AND (count(DISTINCT decision) = 2 OR bool_or(decision = 'R'))""")
def conflict_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").groupBy(F.col("l_orderkey").alias("pair_id"))
    out = rows.agg(F.count("*").alias("n"), F.size(F.collect_set("l_returnflag")).cast("long").alias("decisions"), F.bool_or(F.col("l_returnflag") == "R").alias("unsure"))
    return out.filter("n = 2 AND (decisions = 2 OR unsure)").drop("unsure")


@query(f"""WITH {CLIPS}, {ASSESSMENTS}, {EXCLUSIONS}, c AS (SELECT count(*) AS clips, count(a.clip_id) AS assessed, count(e.clip_id) FILTER (WHERE e.state = 'media_deleted') AS gone FROM clips LEFT JOIN assessments a USING (clip_id) LEFT JOIN exclusions e USING (clip_id))
SELECT *, CAST(assessed AS DOUBLE) / clips AS share, CASE WHEN NOT clips > 0 THEN 'no_clips' WHEN NOT assessed * 2 >= clips THEN 'coverage' WHEN NOT gone * 10 <= clips THEN 'losses' ELSE 'pass' END AS verdict FROM c""")
def verdict_ladder(spark, sf_dir):
    rows = clips(spark, sf_dir).join(assessments(spark, sf_dir), "clip_id", "left").join(exclusions(spark, sf_dir), "clip_id", "left")
    out = rows.agg(F.count("*").alias("clips"), F.count("decision").alias("assessed"), F.count_if(F.col("state") == "media_deleted").alias("gone"))
    gates = [("no_clips", F.col("clips") > 0), ("coverage", F.col("assessed") * 2 >= F.col("clips")), ("losses", F.col("gone") * 10 <= F.col("clips"))]
    return out.withColumns({"share": ratio(F.col("assessed"), F.col("clips")), "verdict": audit.ladder(gates)})
