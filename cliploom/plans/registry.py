"""Registry of queries: a name, a function of (spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def merkle_sql(source: str, columns: list[str]) -> str:
    """SQL of the hash tree over a table, two digits deep: m2 (leaves), m1 and m0 (the root), each with prefix, n and digest."""
    text = " || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '~')" for c in columns)
    sums = " || '|' || ".join(f"sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT))" for i in range(8))
    up = lambda k: f"m{k} AS (SELECT substr(prefix, 1, {k}) AS prefix, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(prefix || ':' || digest, '|' ORDER BY prefix)) AS digest FROM m{k + 1} GROUP BY 1)"
    return f"m2 AS (SELECT substr(d, 1, 2) AS prefix, count(*) AS n, sha256(count(*) || '|' || {sums}) AS digest FROM (SELECT sha256({text}) AS d FROM {source}) GROUP BY 1), {up(1)}, {up(0)}"


#: The clip domain in SQL, as sources.tables derives it.
CLIPS = """clips AS (
  SELECT event_id AS clip_id, user_id % 10 AS camera_id, ts, epoch_us(ts) AS us, CAST(ts + INTERVAL 2 HOUR AS DATE) AS activity_day,
         value AS duration_sec, event_type <> 'error' AS has_motion, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE WHEN event_id % 7 <> 0 THEN 'clips/cam' || (user_id % 10) || '/' || event_id || '.mp4' END AS media_key,
         epoch_us(ts) + CAST(trunc(value * 1000000) AS BIGINT) AS end_us
  FROM events)"""
EXCLUSIONS = """exclusions AS (
  SELECT event_id AS clip_id, ['quarantined', 'media_deleted', 'restored', 'candidate', 'deletion_blocked'][event_id % 5 + 1] AS state,
         CASE event_id % 4 WHEN 0 THEN 'device_error' WHEN 1 THEN '' WHEN 2 THEN 'duplicate_key' END AS reason_code
  FROM events WHERE event_type = 'error')"""
ACCOUNTED = f"""{CLIPS}, {EXCLUSIONS}, acc AS (
  SELECT c.*, e.state, e.state IS NOT NULL OR c.duration_sec IS NULL OR isnan(c.duration_sec) OR c.duration_sec <= 0 AS bad,
         CASE WHEN e.state IS NOT NULL OR c.duration_sec IS NULL OR isnan(c.duration_sec) OR c.duration_sec <= 0 THEN 'diagnostic' ELSE 'candidate' END AS kind,
         CASE WHEN e.state IS NOT NULL THEN coalesce(nullif(e.reason_code, ''), 'unknown') || ':' || e.state
              WHEN c.duration_sec IS NULL OR isnan(c.duration_sec) OR c.duration_sec <= 0 THEN 'invalid_duration' END AS reason
  FROM clips c LEFT JOIN (SELECT * FROM exclusions WHERE state <> 'restored') e USING (clip_id)),
seq AS (
  SELECT *, lag(clip_id) OVER o AS prev_clip, lag(kind) OVER o AS prev_kind, us - lag(end_us) OVER o AS gap_us
  FROM acc WINDOW o AS (PARTITION BY camera_id, activity_day ORDER BY us, clip_id))"""
ASSESSMENTS = """assessments AS (
  SELECT clip_id, CASE WHEN k < 20 THEN 'active' WHEN k < 45 THEN 'static' ELSE 'absent' END AS decision,
         CASE WHEN clip_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS policy_version
  FROM clips WHERE k < 70)"""
SETTINGS = """settings AS (
  SELECT camera_id, camera_id % 2 = 1 AS enabled, camera_id % 3 = 0 AS exclude_absent, camera_id % 4 <> 2 AS exclude_static,
         CASE WHEN camera_id < 5 THEN 'v1' ELSE 'v2' END AS active_policy
  FROM (SELECT DISTINCT camera_id FROM clips) WHERE camera_id % 5 <> 0)"""
PREDICTIONS = """predictions AS (
  SELECT l_orderkey * 10 + l_linenumber AS sample_id, l_orderkey AS clip_id, l_linenumber AS line, l_suppkey % 4 AS model, l_returnflag AS truth,
         CASE WHEN l_linestatus = 'O' AND l_quantity < 40 THEN 'N' WHEN l_quantity < 25 THEN 'A' ELSE 'R' END AS pred,
         l_discount * 10 AS conf, l_quantity AS quantity, l_extendedprice AS price
  FROM lineitem)"""
JOBS = """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS owner_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'leased' END AS status,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, epoch_us(o_orderdate) AS created_us, CAST(o_orderkey % 4 AS INTEGER) AS attempt,
         o_totalprice AS cost, epoch_us(o_orderdate) + (o_orderkey % 30) * 86400000000 AS lease_us
  FROM orders)"""
