"""Queries on transactions of queues and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledgers, motion, state
from ..sources.tables import clips, exclusions, jobs, table
from .queue_queries import DETECTED, LOGS, detections, logs
from .registry import CLIPS, EXCLUSIONS, JOBS, query

NOW = 820_000_000_000_000


@query(f"WITH {CLIPS}, {LOGS}, n AS (SELECT camera_id * 1000 + k AS key, us, clip_id FROM clips) SELECT key, arg_min(clip_id, (us, clip_id)) AS clip_id, min(us) AS us, 'queued' AS status, 0 AS attempt FROM n WHERE key NOT IN (SELECT clip_id FROM logs) GROUP BY 1")
def enqueued_jobs(spark, sf_dir):
    rows = clips(spark, sf_dir).select((F.col("camera_id") * 1000 + F.col("k")).alias("key"), "us", "clip_id")
    return ledgers.enqueued(rows, logs(spark, sf_dir).select(F.col("clip_id").alias("key")), "key", "us", "clip_id")


@query("""WITH n AS (SELECT l_orderkey % 400 AS clip, l_suppkey % 3 AS engine, min(l_partkey) AS run FROM lineitem GROUP BY 1, 2), o AS (SELECT o_orderkey % 400 AS clip, o_custkey % 3 AS engine, max(o_orderkey) AS run FROM orders WHERE o_orderkey < 500 GROUP BY 1, 2)
SELECT n.clip, n.engine, coalesce(o.run, n.run) AS run, o.run IS NULL AS created FROM n LEFT JOIN o USING (clip, engine)""")
def idempotent_runs(spark, sf_dir):
    new = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 400).alias("clip"), (F.col("l_suppkey") % 3).alias("engine"), F.col("l_partkey").alias("run"))
    old = table(spark, sf_dir, "orders").filter("o_orderkey < 500").groupBy((F.col("o_orderkey") % 400).alias("clip"), (F.col("o_custkey") % 3).alias("engine")).agg(F.max("o_orderkey").alias("run"))
    return ledgers.inserted_or_existing(new, old, ["clip", "engine"])


@query("""SELECT CASE WHEN doc_id % 13 = 0 THEN 'deleted' ELSE 'updated' END AS code, doc_id FROM documents WHERE doc_id % 13 = 0 OR doc_id % 17 = 0""")
def append_only_faults(spark, sf_dir):
    before = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    after = before.filter("doc_id % 13 <> 0").withColumn("lang", F.when(F.col("doc_id") % 17 == 0, "xx").otherwise(F.col("lang")))
    return ledgers.append_only_violations(before, after, "doc_id")


@query(f"""WITH {JOBS}, u AS (SELECT l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS update_id, l_orderkey AS job_id, epoch_us(TIMESTAMP '1970-01-01') + l_orderkey * 1000 + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS expected_us FROM lineitem),
f AS (SELECT *, min(update_id) OVER (PARTITION BY job_id) AS first_id FROM u), c AS (SELECT o_orderkey AS job_id, o_orderkey * 1000 AS updated_us FROM orders WHERE o_orderkey % 9 <> 0)
SELECT update_id, job_id, CASE WHEN updated_us IS NULL THEN 'unknown' WHEN expected_us <> updated_us THEN 'conflict' WHEN update_id <> first_id THEN 'conflict' ELSE 'accepted' END AS result FROM f LEFT JOIN c USING (job_id)""")
def guarded_updates(spark, sf_dir):
    n = F.col("l_orderkey")
    updates = table(spark, sf_dir, "lineitem").select((n * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("update_id"), n.alias("job_id"), (n * 1000 + F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0)).alias("expected_us"))
    current = table(spark, sf_dir, "orders").filter("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") * 1000).alias("updated_us"))
    return ledgers.guarded_updates(current, updates, "job_id")


@query(f"""WITH {JOBS}, s AS (SELECT *, CASE WHEN status = 'leased' AND lease_us <= {NOW} AND attempt >= 3 THEN 'failed' WHEN status = 'leased' AND lease_us <= {NOW} THEN 'queued' ELSE status END AS state FROM jobs)
SELECT job_id, 'leased' AS status, attempt + 1 AS attempt, 'w1' AS worker, {NOW + 600_000_000} AS lease_us FROM s WHERE state = 'queued' AND attempt < 3 ORDER BY priority DESC, created_us, job_id LIMIT 25""")
def claimed_jobs(spark, sf_dir):
    return ledgers.claimed(jobs(spark, sf_dir), NOW, 3, 25, "w1", 600_000_000)


@query(f"""WITH {JOBS}, o AS (SELECT o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 100000000 ELSE 0 END AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS worker_id, o_orderkey % 2 = 0 AS ok FROM orders),
r AS (SELECT o.job_id, worker_id, attempt, CASE WHEN status IS NULL THEN 'unknown_job' WHEN NOT (status = 'leased' AND owner_id = worker_id AND lease_us > {NOW}) THEN 'not_owner' WHEN ok THEN 'done' WHEN attempt + 1 >= 3 THEN 'failed' ELSE 'queued' END AS result FROM o LEFT JOIN jobs USING (job_id))
SELECT job_id, worker_id, result, CASE WHEN result = 'queued' THEN {NOW} + 60000000 * CAST(pow(2, attempt) AS BIGINT) END AS next_us FROM r""")
def finished_jobs(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    outcomes = table(spark, sf_dir, "orders").select((n + F.when(n % 50 == 0, 100_000_000).otherwise(0)).alias("job_id"), F.when(n % 3 == 0, c + 1).otherwise(c).alias("worker_id"), (n % 2 == 0).alias("ok"))
    return ledgers.finished(jobs(spark, sf_dir), outcomes, NOW, 3)


@query(f"""WITH {DETECTED} SELECT clip_id, event, CASE WHEN now IS NULL THEN 'none' ELSE 'candidate' END AS before, ought AS after, version AS rule_version, displayed FROM detected WHERE event IS NOT NULL AND NOT (clip_id % 6 = 0 AND event = 'auto_quarantined')""")
def transition_events(spark, sf_dir):
    """Events of the short-clip rule with before and after; what an earlier run has written is not written again."""
    ledger = clips(spark, sf_dir).filter("clip_id % 6 = 0").select("clip_id", F.lit("auto_quarantined").alias("event"))
    return state.detection_events(detections(spark, sf_dir), ledger)


@query(f"""WITH {CLIPS}, c AS (SELECT clip_id, coalesce(CASE WHEN clip_id % 8 = 0 THEN clip_id % 3 END, CASE WHEN camera_id <> 7 THEN camera_id % 4 END) AS group_id FROM clips WHERE activity_day >= DATE '2024-01-10' AND clip_id % 5 <> 0)
SELECT clip_id, group_id, slot FROM c, (VALUES (1), (2)) s(slot) WHERE group_id IS NOT NULL""")
def review_slots(spark, sf_dir):
    rows = clips(spark, sf_dir)
    groups = rows.select("camera_id").distinct().filter("camera_id <> 7").withColumn("camera_group", F.col("camera_id") % 4)
    frozen = rows.filter("clip_id % 8 = 0").select("clip_id", (F.col("clip_id") % 3).alias("frozen_group"))
    return ledgers.slots(rows, groups, frozen, rows.filter("clip_id % 5 = 0").select("clip_id"), F.lit("2024-01-10").cast("date"))


@query("SELECT l_orderkey AS clip_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <> 2")
def slot_faults(spark, sf_dir):
    return ledgers.slot_faults(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip_id")))


STORED = "stored AS (SELECT o_orderkey AS submission_id, o_orderkey // 2 AS clip_id, o_orderkey % 2 AS reviewer, md5(CAST(o_custkey AS VARCHAR)) AS digest FROM orders WHERE o_orderkey % 7 <> 0)"


@query(f"""WITH {STORED}, i AS (SELECT o_orderkey // 2 AS clip_id, o_orderkey % 2 AS reviewer, md5(CAST(o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS digest, o_orderkey * 10 AS lease_us FROM orders)
SELECT i.clip_id, i.reviewer, CASE WHEN s.digest = i.digest THEN 'replayed' WHEN s.digest IS NOT NULL THEN 'conflict' WHEN lease_us <= 5000 THEN 'lease_over' ELSE 'accepted' END AS result, p.submission_id AS peer_id
FROM i LEFT JOIN stored s USING (clip_id, reviewer) LEFT JOIN stored p ON p.clip_id = i.clip_id AND p.reviewer <> i.reviewer""")
def blind_submissions(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    clip, reviewer = F.floor(n / 2).alias("clip_id"), (n % 2).alias("reviewer")
    stored = o.filter(n % 7 != 0).select(n.alias("submission_id"), clip, reviewer, F.md5(c.cast("string")).alias("digest"))
    incoming = o.select(clip, reviewer, F.md5((c + F.when(n % 11 == 0, 1).otherwise(0)).cast("string")).alias("digest"), (n * 10).alias("lease_us"))
    return ledgers.submitted(stored, incoming, 5000)


@query("""WITH c AS (SELECT o_orderkey AS clip_id, CASE WHEN o_orderkey % 4 = 0 THEN 'agreed' ELSE 'awaiting' END AS status, o_custkey AS a, o_custkey + 1 AS b FROM orders),
x AS (SELECT o_orderkey AS clip_id, CASE WHEN o_orderkey % 3 = 0 THEN 'conflict' ELSE 'agreed' END AS outcome, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 15 <> 0 THEN NULL ELSE 'label' END AS decision, o_custkey + CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS sa, o_custkey + 1 AS sb FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT *, a = sa AND b = sb AS same, (outcome = 'agreed' AND decision IS NOT NULL) OR (outcome = 'conflict' AND decision IS NULL) AS shaped FROM c LEFT JOIN x USING (clip_id))
SELECT clip_id, CASE WHEN status = 'awaiting' AND coalesce(same AND shaped, false) THEN outcome ELSE status END AS status, CASE WHEN status = 'awaiting' AND coalesce(same AND shaped, false) THEN decision END AS decision,
  CASE WHEN outcome IS NULL THEN 'no_comparison' WHEN status <> 'awaiting' THEN 'not_waiting' WHEN NOT same THEN 'stale' WHEN NOT shaped THEN 'payload' ELSE 'moved' END AS why FROM j""")
def consensus_finalised(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    consensus = o.select(n.alias("clip_id"), F.when(n % 4 == 0, "agreed").otherwise("awaiting").alias("status"), c.alias("a_digest"), (c + 1).alias("b_digest"))
    compared = o.filter(n % 13 != 0).select(
        n.alias("clip_id"), F.when(n % 3 == 0, "conflict").otherwise("agreed").alias("outcome"), F.when((n % 3 != 0) | (n % 15 == 0), "label").alias("decision"), (c + F.when(n % 10 == 1, 1).otherwise(0)).alias("seen_a"), (c + 1).alias("seen_b")
    )
    return ledgers.finalised(consensus, compared)


@query("""WITH c AS (SELECT o_orderkey AS clip_id, CASE WHEN o_orderkey % 4 = 0 THEN 'agreed' ELSE 'conflict' END AS status, 'a' || o_custkey AS a, CASE WHEN o_orderkey % 9 <> 0 THEN 'b' || o_custkey END AS b FROM orders WHERE o_orderkey % 13 <> 0),
x AS (SELECT o_orderkey AS clip_id, ['a', 'b', 'new'][o_custkey % 3 + 1] AS choice, CASE WHEN o_orderkey % 5 <> 0 THEN 'n' || o_custkey END AS new_value FROM orders),
v AS (SELECT x.clip_id, status, CASE choice WHEN 'a' THEN a WHEN 'b' THEN b ELSE new_value END AS value FROM x LEFT JOIN c USING (clip_id)),
r AS (SELECT *, CASE WHEN coalesce(status <> 'conflict', true) THEN 'not_in_conflict' WHEN value IS NULL THEN 'no_value' ELSE 'owner_resolved' END AS result FROM v)
SELECT clip_id, result, CASE WHEN result = 'owner_resolved' THEN value END AS value FROM r""")
def owner_resolutions(spark, sf_dir):
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    o, text = table(spark, sf_dir, "orders"), lambda p: F.concat(F.lit(p), c.cast("string"))
    conflicts = o.filter(n % 13 != 0).select(n.alias("clip_id"), F.when(n % 4 == 0, "agreed").otherwise("conflict").alias("status"), text("a").alias("a_value"), F.when(n % 9 != 0, text("b")).alias("b_value"))
    choices = o.select(n.alias("clip_id"), F.get(F.array(F.lit("a"), F.lit("b"), F.lit("new")), (c % 3).cast("int")).alias("choice"), F.when(n % 5 != 0, text("n")).alias("new_value"))
    return ledgers.resolved(conflicts, choices)


@query(f"""WITH {JOBS}, o AS (SELECT count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'leased') AS errors, count(*) FILTER (WHERE status = 'queued') AS waiting FROM jobs)
SELECT *, CASE WHEN done + errors > 0 AND errors > (done + errors) * 0.5 THEN 'unreliable' WHEN done >= 100000000 THEN 'complete' WHEN waiting < 10 THEN 'out_of_volume' ELSE 'going' END AS reason FROM o""")
def stop_condition(spark, sf_dir):
    of = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return ledgers.stop_reason(jobs(spark, sf_dir).agg(of("done", "done"), of("leased", "errors"), of("queued", "waiting")), 100_000_000, 0.5, 10)


@query(f"""WITH {CLIPS}, v AS (SELECT camera_id AS owner_id, DATE '2024-01-12' + CAST(camera_id AS INTEGER) AS priority_day, 1705000000000000 + camera_id * 86400000000 AS visited_us FROM (SELECT DISTINCT camera_id FROM clips)), s AS (SELECT camera_id AS owner_id, activity_day AS day, us + CASE WHEN clip_id % 10 = 0 THEN 864000000000 ELSE 0 END AS created_us FROM clips)
SELECT owner_id, count(*) FILTER (WHERE day > priority_day AND day <= DATE '2024-01-25') AS ahead, count(*) FILTER (WHERE day <= priority_day AND created_us > visited_us) AS late FROM s JOIN v USING (owner_id) GROUP BY 1""")
def late_slots(spark, sf_dir):
    c = clips(spark, sf_dir)
    visited = c.select(F.col("camera_id").alias("owner_id")).distinct().select("owner_id", F.date_add(F.lit("2024-01-12").cast("date"), F.col("owner_id").cast("int")).alias("priority_day"), (F.lit(1_705_000_000_000_000) + F.col("owner_id") * 86_400_000_000).alias("visited_us"))
    made = c.select(F.col("camera_id").alias("owner_id"), F.col("activity_day").alias("day"), (F.col("us") + F.when(F.col("clip_id") % 10 == 0, 864_000_000_000).otherwise(0)).alias("created_us"))
    return ledgers.late_added(made, visited, F.lit("2024-01-25").cast("date"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 80")
def bounded_dead_letters(spark, sf_dir):
    return ledgers.bounded_queue(table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id"), "event_id", 80)


@query("""WITH f AS (SELECT vec_id % 5 AS camera_id, vec_id // 5 AS "at", list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127) AS BIGINT)) AS v FROM embeddings),
b AS (SELECT camera_id, "at", list_transform(range(1, len(v) + 1), lambda i: v[greatest(i - 1, 1)] + 2 * v[i] + v[least(i + 1, len(v))]) AS now FROM f),
l AS (SELECT *, lag(now) OVER (PARTITION BY camera_id ORDER BY "at") AS before FROM b),
n AS (SELECT camera_id, "at", len(now) AS cells, CASE WHEN before IS NULL THEN 0 ELSE len(list_filter(range(1, len(now) + 1), lambda i: abs(now[i] - before[i]) > 72)) END AS n_changed, before IS NOT NULL AS has FROM l)
SELECT camera_id, "at", n_changed, has AND n_changed * 100.0 / cells >= 30 AS motion FROM n""")
def changed_frames(spark, sf_dir):
    """Motion between neighbouring frames of a camera; frames are rows of 64 cells."""
    return motion.frame_motion(frames(spark, sf_dir), threshold=18, percent=30.0, per_slice=64)


def frames(spark, sf_dir):
    cells = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127))
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("camera_id"), F.floor(F.col("vec_id") / 5).alias("at"), cells.alias("cells"))


@query(f"""WITH {CLIPS}, {EXCLUSIONS}, {LOGS}, r AS (SELECT e.clip_id, us + 2592000000000 AS delete_after FROM exclusions e JOIN clips USING (clip_id) WHERE state = 'quarantined')
SELECT clip_id, delete_after FROM r WHERE delete_after <= 1707500000000000 AND clip_id % 11 <> 0 AND clip_id NOT IN (SELECT clip_id FROM logs) ORDER BY delete_after, clip_id LIMIT 40""")
def retention_recheck(spark, sf_dir):
    """Quarantined media past their time, not leased and still unprotected, oldest first."""
    rows = exclusions(spark, sf_dir).filter("state = 'quarantined'").join(clips(spark, sf_dir).select("clip_id", "us"), "clip_id").select("clip_id", (F.col("us") + 2_592_000_000_000).alias("delete_after"))
    due = rows.filter((F.col("delete_after") <= 1_707_500_000_000_000) & (F.col("clip_id") % 11 != 0)).join(logs(spark, sf_dir), "clip_id", "left_anti")
    return due.orderBy("delete_after", "clip_id").limit(40)
