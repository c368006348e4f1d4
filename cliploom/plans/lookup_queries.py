"""Queries on lookups and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros, seoul_clock
from ..operators import eligibility, lookups
from ..sources.tables import assessments, clips, exclusions, predictions, table
from .queue_queries import LOGS, logs
from .registry import ASSESSMENTS, CLIPS, EXCLUSIONS, PREDICTIONS, query

OWNER = 3
CONSENSUS = """consensus AS (SELECT o_orderkey AS id, o_orderkey // 2 AS clip_id, CASE WHEN o_orderkey % 3 = 0 THEN 'live' ELSE 'canary' END AS kind,
  ['agreed', 'owner_resolved', 'awaiting', 'conflict'][o_custkey % 4 + 1] AS status, CASE WHEN o_custkey % 5 = 0 THEN 'owner-single-adopt-v1' ELSE 'blind-v2' END AS version,
  ['label', 'hold', 'exclude'][o_custkey % 3 + 1] AS decision, 'gt' || o_custkey % 6 AS gt, o_custkey % 2 = 0 AS cohort_open, epoch_us(o_orderdate) AS created_us FROM orders WHERE o_custkey % 7 <> 0)"""
SESSIONS = """sessions AS (SELECT CAST(l_orderkey AS BIGINT) * 100000000 + l_linenumber * 10000000 + l_partkey * 7 + l_suppkey AS id, l_orderkey AS clip_id, l_suppkey % 7 AS reviewer, CASE WHEN l_quantity > 10 THEN l_returnflag END AS initial_gt,
  CASE WHEN l_quantity > 30 THEN l_linestatus END AS current_gt, epoch_us(l_shipdate) AS updated_us FROM lineitem)"""


def consensus(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (c % len(names)).cast("int"))
    return table(spark, sf_dir, "orders").filter(c % 7 != 0).select(
        o.alias("id"),
        F.floor(o / 2).alias("clip_id"),
        F.when(o % 3 == 0, "live").otherwise("canary").alias("kind"),
        pick(["agreed", "owner_resolved", "awaiting", "conflict"]).alias("status"),
        F.when(c % 5 == 0, "owner-single-adopt-v1").otherwise("blind-v2").alias("version"),
        pick(["label", "hold", "exclude"]).alias("decision"),
        F.concat(F.lit("gt"), (c % 6).cast("string")).alias("gt"),
        (c % 2 == 0).alias("cohort_open"),
        micros(F.col("o_orderdate")).alias("created_us"),
    )


def sessions(spark, sf_dir):
    key = F.col("l_orderkey").cast("long") * 100_000_000 + F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 7 + F.col("l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        key.alias("id"),
        F.col("l_orderkey").alias("clip_id"),
        (F.col("l_suppkey") % 7).alias("reviewer"),
        F.when(F.col("l_quantity") > 10, F.col("l_returnflag")).alias("initial_gt"),
        F.when(F.col("l_quantity") > 30, F.col("l_linestatus")).alias("current_gt"),
        micros(F.col("l_shipdate")).alias("updated_us"),
    )


TOP = f"""{CONSENSUS}, {SESSIONS}, canary AS (SELECT * FROM consensus WHERE kind = 'canary' QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY cohort_open DESC, created_us DESC, id DESC) = 1),
legacy AS (SELECT clip_id, reviewer, coalesce(current_gt, initial_gt) AS gt FROM sessions WHERE initial_gt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY reviewer = {OWNER} DESC, updated_us DESC, id DESC) = 1)"""
LISTED = f"""{CLIPS}, {EXCLUSIONS}, {TOP}, base AS (SELECT m.*, lc.status AS ls, lc.version AS lv, lc.decision AS ld, lc.gt AS lg, cy.status AS cs, cy.version AS cv, cy.decision AS cd, cy.gt AS cg, o.reviewer AS orv, o.gt AS og
  FROM clips m LEFT JOIN (SELECT * FROM consensus WHERE kind = 'live') lc USING (clip_id) LEFT JOIN canary cy USING (clip_id) LEFT JOIN legacy o USING (clip_id)
  WHERE media_key LIKE 'clips/%' AND clip_id NOT IN (SELECT clip_id FROM exclusions WHERE state IN ('quarantined', 'media_deleted'))),
listed AS (SELECT clip_id, us, camera_id, strftime(ts + INTERVAL 9 HOUR, '%H:%M') AS clock,
  CASE WHEN cs IN ('agreed', 'owner_resolved') THEN 'final' WHEN cs IN ('awaiting', 'conflict') THEN 're_review' WHEN ls IN ('agreed', 'owner_resolved') THEN 'final' WHEN ls = 'conflict' THEN 'owner_review' WHEN ls = 'awaiting' THEN 'awaiting' WHEN og IS NOT NULL THEN 'final' ELSE 'unlabeled' END AS public_state,
  CASE WHEN cs IS NOT NULL AND cv = 'owner-single-adopt-v1' THEN 'owner_single_adopt' WHEN cs IS NOT NULL THEN 'blind_consensus' WHEN ls IS NOT NULL AND lv = 'owner-single-adopt-v1' THEN 'owner_single_adopt' WHEN ls IS NOT NULL THEN 'blind_consensus'
    WHEN og IS NOT NULL AND orv = {OWNER} THEN 'owner_legacy' WHEN og IS NOT NULL THEN 'single_legacy' ELSE 'none' END AS public_source,
  CASE WHEN cs IN ('agreed', 'owner_resolved') THEN cd WHEN cs IS NOT NULL THEN NULL WHEN ls IN ('agreed', 'owner_resolved') THEN ld WHEN ls IS NOT NULL THEN NULL WHEN og IS NOT NULL THEN 'label' END AS public_decision,
  CASE WHEN cs IN ('agreed', 'owner_resolved') THEN cg WHEN cs IS NOT NULL THEN NULL WHEN ls IN ('agreed', 'owner_resolved') THEN lg WHEN ls IS NOT NULL THEN NULL ELSE og END AS public_gt FROM base)"""


def listed(spark, sf_dir):
    rows = clips(spark, sf_dir).withColumn("purpose", F.lit("production"))
    some = eligibility.production(rows, exclusions(spark, sf_dir), "production", "clips/").select("clip_id", "us", "camera_id", seoul_clock(F.col("started_at")).alias("clock"))
    return lookups.listed(some, consensus(spark, sf_dir), sessions(spark, sf_dir), OWNER)


@query(f"WITH {TOP} SELECT clip_id, id, status, version, decision, cohort_open FROM canary")
def canary_top(spark, sf_dir):
    return lookups.canary_of(consensus(spark, sf_dir)).select("clip_id", "id", "status", "version", "decision", "cohort_open")


@query(f"WITH {TOP} SELECT clip_id, reviewer, gt FROM legacy")
def legacy_top(spark, sf_dir):
    return lookups.legacy_of(sessions(spark, sf_dir), OWNER)


@query(f"WITH {LISTED} SELECT clip_id, public_state, public_source, public_decision, public_gt FROM listed")
def library_classes(spark, sf_dir):
    return listed(spark, sf_dir).select("clip_id", "public_state", "public_source", "public_decision", "public_gt")


@query(f"""WITH {LISTED} SELECT clip_id, us, camera_id, public_state, public_source FROM listed WHERE camera_id IN (1, 2, 3, 4) AND us BETWEEN 1704500000000000 AND 1706000000000000
  AND (clock >= '20:00' OR clock <= '08:00') AND public_state IN ('final', 're_review') AND (us, clip_id) < (1705900000000000, 0) ORDER BY us DESC, clip_id DESC LIMIT 51""")
def library_page(spark, sf_dir):
    """A page of the library: closed range of dates, hours over midnight, a filter on what was classified, and a cursor."""
    from ..functions.times import clock_between
    from ..operators.queues import page

    rows = listed(spark, sf_dir).filter(F.col("camera_id").isin(1, 2, 3, 4) & F.col("us").between(1_704_500_000_000_000, 1_706_000_000_000_000) & clock_between(F.col("clock"), "20:00", "08:00"))
    some = rows.filter(F.col("public_state").isin("final", "re_review"))
    return page(some, "us", "clip_id", (1_705_900_000_000_000, 0), 50).select("clip_id", "us", "camera_id", "public_state", "public_source")


@query(f"""WITH {CLIPS}, {SESSIONS}, p AS (SELECT id, clip_id, updated_us FROM sessions WHERE reviewer = 2 ORDER BY updated_us DESC, id DESC LIMIT 60)
SELECT p.id, clip_id, camera_id FROM p JOIN clips USING (clip_id)""")
def own_labels_page(spark, sf_dir):
    mine = sessions(spark, sf_dir).filter("reviewer = 2").select("id", "clip_id", "updated_us")
    return lookups.paged_then_joined(mine, clips(spark, sf_dir).select("clip_id", "camera_id"), 60, F.desc("updated_us"), F.desc("id")).select("id", "clip_id", "camera_id")


@query(f"""WITH {CLIPS}, {CONSENSUS} SELECT id, ref FROM (SELECT id, CASE WHEN id % 6 <> 0 THEN clip_id * 2 END AS ref FROM consensus) WHERE ref IS NOT NULL AND ref NOT IN (SELECT clip_id FROM clips)""")
def broken_references(spark, sf_dir):
    rows = consensus(spark, sf_dir).select("id", F.when(F.col("id") % 6 != 0, F.col("clip_id") * 2).alias("ref"))
    return lookups.orphans(rows, "ref", clips(spark, sf_dir), "clip_id").select("id", "ref")


ONE = "one AS (SELECT clip_id, model, max(truth) AS truth, max(pred) AS pred FROM predictions GROUP BY 1, 2)"


def by_model(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("clip_id", "model").agg(F.max("truth").alias("truth"), F.max("pred").alias("pred"))


@query(f"WITH {PREDICTIONS}, {ONE} SELECT a.clip_id, a.pred AS first, b.pred AS second, c.truth FROM one a JOIN one b ON a.clip_id = b.clip_id AND b.model = 1 JOIN one c ON a.clip_id = c.clip_id AND c.model = 2 WHERE a.model = 0")
def common_results(spark, sf_dir):
    """Keys that three result sets have, in one pass over them."""
    rows = by_model(spark, sf_dir)
    of = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    return rows.groupBy("clip_id").agg(of(0, "pred").alias("first"), of(1, "pred").alias("second"), of(2, "truth").alias("truth")).na.drop()


@query(f"""WITH {PREDICTIONS}, {ONE}, j AS (SELECT t.truth, b.pred AS base, n.pred AS new FROM one t JOIN one b ON t.clip_id = b.clip_id AND b.model = 1 LEFT JOIN one n ON n.clip_id = t.clip_id AND n.model = 2 WHERE t.model = 0),
c AS (SELECT CASE WHEN new IS NULL THEN 'missing' WHEN base = truth AND new = truth THEN 'held' WHEN base <> truth AND new = truth THEN 'recovered' WHEN base = truth THEN 'broken' WHEN base = new THEN 'wrong_same' ELSE 'wrong_changed' END AS change FROM j)
SELECT change, count(*) AS n FROM c GROUP BY 1""")
def outer_compare(spark, sf_dir):
    rows = by_model(spark, sf_dir)
    side = lambda m, c, name: rows.filter(F.col("model") == m).select("clip_id", F.col(c).alias(name))
    return lookups.compared(side(0, "truth", "truth"), side(1, "pred", "base"), side(2, "pred", "new"), "clip_id").groupBy("change").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id AS clip_id, CASE WHEN event_id % 3 = 0 THEN 'human' ELSE 'vlm' END AS source, event_type AS action, epoch_us(ts) AS us, event_id FROM events),
p AS (SELECT clip_id, arg_max(action, (us, event_id)) FILTER (WHERE source = 'human') AS human, arg_max(action, (us, event_id)) FILTER (WHERE source = 'vlm') AS vlm FROM l GROUP BY 1) SELECT * FROM p WHERE human IS NOT NULL""")
def human_and_model(spark, sf_dir):
    source = F.when(F.col("event_id") % 3 == 0, "human").otherwise("vlm")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), source.alias("source"), F.col("event_type").alias("action"), micros(F.col("ts")).alias("us"), "event_id")
    return lookups.two_sources(log, "clip_id", "source", "action", "human", "vlm", F.col("us"), F.col("event_id"))


@query(f"""WITH {CLIPS}, {SESSIONS}, s AS (SELECT clip_id, reviewer, count(*) AS n, max(updated_us) AS last_us FROM sessions GROUP BY 1, 2)
SELECT c.clip_id, c.clip_id % 7 AS reviewer, s.n, s.last_us FROM clips c LEFT JOIN s ON s.clip_id = c.clip_id AND s.reviewer = c.clip_id % 7""")
def reviewer_sessions(spark, sf_dir):
    s = sessions(spark, sf_dir).groupBy("clip_id", "reviewer").agg(F.count("*").alias("n"), F.max("updated_us").alias("last_us"))
    return clips(spark, sf_dir).select("clip_id", (F.col("clip_id") % 7).alias("reviewer")).join(s, ["clip_id", "reviewer"], "left")


@query("""WITH m AS (SELECT p_partkey AS real_id, 's' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 10) AS sample, p_size % 4 AS job FROM part), r AS (SELECT 's' || substr(md5(CAST(l_partkey AS VARCHAR)), 1, 10) AS sample, l_returnflag AS answer FROM lineitem WHERE l_partkey % 3 <> 0)
SELECT job, count(*) AS answers, count(DISTINCT real_id) AS ids, count(*) FILTER (WHERE answer = 'R') AS n_r FROM r JOIN m USING (sample) GROUP BY 1""")
def blind_ids_resolved(spark, sf_dir):
    blind = lambda c: F.concat(F.lit("s"), F.substring(F.md5(F.col(c).cast("string")), 1, 10))
    mapping = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("real_id"), blind("p_partkey").alias("sample"), (F.col("p_size") % 4).alias("job"))
    results = table(spark, sf_dir, "lineitem").filter("l_partkey % 3 <> 0").select(blind("l_partkey").alias("sample"), F.col("l_returnflag").alias("answer"))
    return results.join(mapping, "sample").groupBy("job").agg(F.count("*").alias("answers"), F.countDistinct("real_id").alias("ids"), F.count_if(F.col("answer") == "R").alias("n_r"))


@query("""SELECT c_custkey AS reviewer FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 3 <> 0 AND c_custkey % 4 <> 0
  AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1 HAVING count(DISTINCT o_orderkey % 5) = 5)""")
def qualified_reviewers(spark, sf_dir):
    c = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(c.alias("reviewer"), F.when(F.col("c_mktsegment") == "BUILDING", "owner").otherwise("labeler").alias("role"))
    members = people.select("reviewer", (F.col("reviewer") % 4 != 0).alias("active"))
    lessons = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reviewer"), (F.col("o_orderkey") % 2).alias("run"), (F.col("o_orderkey") % 5).alias("lesson"))
    return lookups.qualified(people, people.filter("reviewer % 3 <> 0"), members, lessons, 1, 5).select("reviewer")


@query(f"""WITH {CLIPS}, g AS (SELECT event_id + 1 AS clip_id, event_type AS truth, epoch_us(ts) AS us, event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, upper(event_type), epoch_us(ts), event_id FROM events WHERE event_id % 3 = 0),
t AS (SELECT clip_id, arg_max(truth, (us, event_id)) AS truth FROM g GROUP BY 1)
SELECT clip_id, truth, coalesce(n_name, 'unknown') AS species FROM t JOIN clips c USING (clip_id) LEFT JOIN nation ON n_nationkey = c.camera_id * 3 WHERE has_motion AND media_key IS NOT NULL""")
def evaluation_set(spark, sf_dir):
    """Last ground truth of a clip, clips with motion and media, and the animal's species if it is known."""
    e, us = table(spark, sf_dir, "events"), micros(F.col("ts")).alias("us")
    rows = e.filter("event_id % 2 = 0").select((F.col("event_id") + 1).alias("clip_id"), F.col("event_type").alias("truth"), us, "event_id")
    rows = rows.unionByName(e.filter("event_id % 3 = 0").select(F.col("event_id").alias("clip_id"), F.upper("event_type").alias("truth"), us, "event_id"))
    truth = lookups.best(rows, "clip_id", F.col("us"), F.col("event_id")).select("clip_id", "truth")
    kinds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kind"), "n_name")
    some = clips(spark, sf_dir).filter("has_motion AND media_key IS NOT NULL").select("clip_id", (F.col("camera_id") * 3).alias("kind"))
    return truth.join(some, "clip_id").join(kinds, "kind", "left").select("clip_id", "truth", F.coalesce("n_name", F.lit("unknown")).alias("species"))


@query(f"""WITH {CLIPS}, {LOGS}, {ASSESSMENTS}, w AS (SELECT DISTINCT clip_id FROM assessments WHERE decision = 'static'), h AS (SELECT clip_id, CASE WHEN clip_id % 5 = 0 THEN '' ELSE action END AS action FROM logs),
s AS (SELECT event_id AS clip_id, CASE WHEN event_id % 2 = 0 THEN 'moving' ELSE 'resting' END AS action FROM events WHERE event_id % 4 <> 0),
t AS (SELECT w.clip_id, coalesce(nullif(h.action, ''), nullif(s.action, '')) AS truth, CASE WHEN nullif(h.action, '') IS NOT NULL THEN 'log' WHEN nullif(s.action, '') IS NOT NULL THEN 'store' END AS origin
  FROM w JOIN clips c USING (clip_id) LEFT JOIN h USING (clip_id) LEFT JOIN s USING (clip_id) WHERE media_key IS NOT NULL)
SELECT * FROM t WHERE truth = 'moving'""")
def false_positives(spark, sf_dir):
    told = assessments(spark, sf_dir).select("clip_id", F.col("decision").alias("action"))
    human = logs(spark, sf_dir).withColumn("action", F.when(F.col("clip_id") % 5 == 0, "").otherwise(F.col("action")))
    n = F.col("event_id")
    store = table(spark, sf_dir, "events").filter(n % 4 != 0).select(n.alias("clip_id"), F.when(n % 2 == 0, "moving").otherwise("resting").alias("action"))
    return lookups.first_truth(told, human, store, clips(spark, sf_dir), "static", "moving")
