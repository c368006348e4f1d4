"""Queries that run a stream to its end and return what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..sources.files import read_version
from ..streaming.letters import DeadLetters
from ..streaming.rollover import Rule, rollover
from ..streaming.segments import clip_stream, drained, first_rows, segments, worker
from .registry import query


@query("""WITH s AS (SELECT user_id % 10 AS camera_id, epoch_us(ts) // 60000000 * 60000000 AS from_us, count(*) AS n, max(value) AS longest FROM events GROUP BY 1, 2)
SELECT * FROM s WHERE longest >= 5 AND from_us // 1000 + 60000 <= (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events)""")
def stream_segments(spark, sf_dir):
    """Segments that the watermark has passed; the last hour's are still open when the stream stops."""
    rows = drained(segments(clip_stream(spark, f"{sf_dir}/events.parquet"), least_span=5.0), shared_folder(spark))
    return spark.read.parquet(rows)


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE event_type <> 'error'")
def stream_worker(spark, sf_dir):
    results, _ = worked(spark, sf_dir)
    return spark.read.parquet(f"{results}/ok").select("event_id", "doubled")


def worked(spark, sf_dir):
    """Events worked on once each, errors as dead letters of which the 40 newest stay."""
    at = shared_folder(spark)
    results = f"{at}/worker-{uuid.uuid4().hex}"
    letters = DeadLetters(spark, f"{results}/letters", "event_id", "event_id", most=40)
    rows = first_rows(clip_stream(spark, f"{sf_dir}/events.parquet"), "event_id", "event_id")
    process = lambda df: df.select("event_id", "event_type", (F.col("value") * 2).alias("doubled"))
    drained(rows, at, worker(process, f"{results}/ok", f"{results}/failed", "event_type <> 'error'", letters))
    return results, letters


@query("""WITH q AS (SELECT event_id, event_type, value * 2 AS doubled FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 40)
SELECT event_id, CASE WHEN doubled >= 10 THEN 'went' ELSE 'given_up' END AS fate, CAST(CASE WHEN doubled >= 10 THEN 1 ELSE 3 END AS INTEGER) AS attempts FROM q""")
def stream_dead_letters(spark, sf_dir):
    """Fate of the dead letters after two flushes: those that can be worked on went, the others had their three attempts."""
    results, letters = worked(spark, sf_dir)
    fixed = lambda df: df.withColumn("fixed", F.col("doubled") >= 10)
    for _ in range(2):
        letters.flush(fixed, "fixed", f"{results}/flushed")
    went = spark.read.parquet(f"{results}/flushed").select("event_id", F.lit("went").alias("fate"), F.lit(1).alias("attempts"))
    spent = read_version(spark, letters.root, "given_up").select("event_id", F.lit("given_up").alias("fate"), "attempts")
    return went.unionByName(spent)


RULE = Rule(length=6 * 3_600_000_000, gap=2 * 3_600_000_000, period=600_000_000, least_span=600_000_000, least_size=300)
CLOSED = "struct_pack(start_us := start, span_us := last - start, n_read := n_read, n_written := greatest(n_written, CASE WHEN n_written > 0 THEN least(last - start, {0}) // {2} ELSE 0 END), n_padded := n_padded + CASE WHEN n_written > 0 THEN greatest(0, least(last - start, {0}) // {2} - n_written) ELSE 0 END, n_dropped := n_dropped, size := size)".format(RULE.length, RULE.gap, RULE.period)
#: One frame more in a segment that has been begun: what is due, what was written up to then, and the segment after it.
STEP = f"""u AS (SELECT camera_id, i, us, fs, start, n_read, n_padded + CASE WHEN n_written > 0 THEN greatest(0, (us - start) // {RULE.period} - 1 - n_written) ELSE 0 END AS n_padded,
  CASE WHEN n_written > 0 THEN greatest(n_written, (us - start) // {RULE.period} - 1) ELSE 0 END AS w, n_dropped, size, (us - start) // {RULE.period} AS due, gone FROM b),
  v AS (SELECT camera_id, i, start, us AS last, n_read + 1 AS n_read, CASE WHEN w < due THEN w + 1 ELSE w END AS n_written, n_padded, CASE WHEN w < due THEN n_dropped ELSE n_dropped + 1 END AS n_dropped, size + fs AS size, gone FROM u)"""


@query(f"""WITH RECURSIVE f AS (SELECT user_id % 10 AS camera_id, epoch_us(ts) AS us, CAST(floor(value * 100) AS BIGINT) AS fs, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts), CAST(floor(value * 100) AS BIGINT)) AS i
  FROM events WHERE value IS NOT NULL AND epoch_us(ts) <= (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 FROM events)),
g AS (SELECT camera_id, i, us AS start, us AS last, 1::BIGINT AS n_read, 0::BIGINT AS n_written, 0::BIGINT AS n_padded, 1::BIGINT AS n_dropped, fs AS size, CAST(NULL AS STRUCT(start_us BIGINT, span_us BIGINT, n_read BIGINT, n_written BIGINT, n_padded BIGINT, n_dropped BIGINT, size BIGINT)) AS gone FROM f WHERE i = 1
  UNION ALL (WITH b AS (SELECT g.camera_id, f.i, f.us, f.fs, CASE WHEN n.cut THEN f.us ELSE g.start END AS start, CASE WHEN n.cut THEN 0 ELSE g.n_read END AS n_read, CASE WHEN n.cut THEN 0 ELSE g.n_written END AS n_written,
      CASE WHEN n.cut THEN 0 ELSE g.n_padded END AS n_padded, CASE WHEN n.cut THEN 0 ELSE g.n_dropped END AS n_dropped, CASE WHEN n.cut THEN 0 ELSE g.size END AS size, CASE WHEN n.cut THEN {CLOSED.replace("start_us := start", "start_us := g.start").replace("last - start", "last - g.start").replace("size := size", "size := g.size").replace("n_read := n_read", "n_read := g.n_read")} END AS gone
      FROM g JOIN f ON f.camera_id = g.camera_id AND f.i = g.i + 1, LATERAL (SELECT f.us - g.last > {RULE.gap} AS cut) n), {STEP}
    SELECT camera_id, i, CASE WHEN last - start >= {RULE.length} THEN last ELSE start END, last, CASE WHEN last - start >= {RULE.length} THEN 0 ELSE n_read END, CASE WHEN last - start >= {RULE.length} THEN 0 ELSE n_written END,
      CASE WHEN last - start >= {RULE.length} THEN 0 ELSE n_padded END, CASE WHEN last - start >= {RULE.length} THEN 0 ELSE n_dropped END, CASE WHEN last - start >= {RULE.length} THEN 0 ELSE size END, CASE WHEN last - start >= {RULE.length} THEN {CLOSED} ELSE gone END FROM v)),
e AS (SELECT camera_id, gone FROM g WHERE gone IS NOT NULL UNION ALL SELECT camera_id, {CLOSED} FROM g
  WHERE i = (SELECT max(i) FROM f WHERE f.camera_id = g.camera_id) AND (SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 FROM events) > last + {RULE.gap})
SELECT camera_id, gone.* FROM e WHERE gone.span_us >= {RULE.least_span} AND gone.size >= {RULE.least_size}""")
def stream_rollover(spark, sf_dir):
    """Segments of six hours that end by a gap of two, at a frame each ten minutes; what the watermark has not passed is open."""
    frames = clip_stream(spark, f"{sf_dir}/events.parquet").filter("value IS NOT NULL").select((F.col("user_id") % 10).alias("camera_id"), F.col("event_id").alias("frame_id"), "at", F.unix_micros("at").alias("us"), F.floor(F.col("value") * 100).alias("size"))
    return spark.read.parquet(drained(rollover(frames, RULE), shared_folder(spark)))
