"""Streams over several files: late rows, segments told once, keys that come again."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from cliploom.sources import files
from cliploom.sources.files import read_version
from cliploom.streaming.letters import DeadLetters
from cliploom.streaming.rollover import Rule, rolled, rollover
from cliploom.streaming.segments import clip_stream, drained, first_rows, segments, worker

ZERO = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id long, value double, event_type string, ts timestamp_ntz"


def written(spark, at, batches):
    """One file a batch, in order of time."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame([(n, 1, v, "view", ZERO + dt.timedelta(seconds=s)) for n, v, s in rows], SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{at}/rows")
        assert len(list((at / "rows").glob("*.parquet"))) == i + 1
    return f"{at}/rows"


def test_late_rows_are_dropped_and_segments_told_once(spark, tmp_path):
    hour = 3600
    path = written(spark, tmp_path, [[(1, 5.0, 0), (2, 7.0, 3 * hour)], [(4, 6.0, 3 * hour + 20), (5, 1.0, 6 * hour)], [(3, 9.0, 30), (6, 8.0, 9 * hour)]])
    rows = drained(segments(clip_stream(spark, path, files_per_batch=1), least_span=2.0), str(tmp_path))
    told = sorted((r.from_us // 1_000_000 - 1_704_067_200, r.n, r.longest) for r in spark.read.parquet(rows).collect())
    # Row 3 is late: its segment was told with the second batch. Row 5's segment is too short, row 6's is still open.
    assert told == [(0, 1, 5.0), (3 * hour, 2, 7.0)]


def work_on(spark, tmp_path, path, letters=None, files_per_batch=1):
    process = lambda rows: rows.select("event_id", "ts", (F.col("value") * 2).alias("doubled"))
    work = worker(process, f"{tmp_path}/ok", f"{tmp_path}/failed", "doubled > 0", letters)
    rows = first_rows(clip_stream(spark, path, files_per_batch=files_per_batch), "event_id", "ts")
    query = rows.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).outputMode("append").foreachBatch(work).start()
    query.awaitTermination()
    return query.recentProgress


def kept(spark, tmp_path, where):
    return sorted((r.event_id, r.doubled) for r in spark.read.parquet(f"{tmp_path}/{where}").collect())


def test_a_key_is_worked_on_once_over_all_batches(spark, tmp_path):
    path = written(spark, tmp_path, [[(1, 6.0, 1), (1, 5.0, 0), (2, -1.0, 2)], [(2, 9.0, 3), (3, 4.0, 4)]])
    work_on(spark, tmp_path, path)
    assert kept(spark, tmp_path, "ok") == [(1, 10.0), (3, 8.0)] and kept(spark, tmp_path, "failed") == [(2, -2.0)]


def test_earlier_results_are_not_read_and_state_stays_small(spark, tmp_path):
    """Results of earlier batches can be taken away, and keys leave the state when their time has passed."""
    hour = 3600
    path = written(spark, tmp_path, [[(i, 1.0, i * hour), (i - 1, 2.0, i * hour - 1)] for i in range(1, 9)])
    progress = work_on(spark, tmp_path, path)
    assert kept(spark, tmp_path, "ok") == [(i, 4.0 if i == 0 else 2.0) for i in range(9)]
    states = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(states) >= 8 and max(states) <= 5
    shutil.rmtree(tmp_path / "ok")
    df = spark.createDataFrame([(8, 5.0), (20, 7.0)], "event_id long, value double").selectExpr("event_id", "1L AS user_id", "value", "'view' AS event_type", "TIMESTAMP_NTZ '2024-01-01 08:00:01' AS ts")
    df.coalesce(1).write.mode("append").parquet(path)
    work_on(spark, tmp_path, path)
    assert kept(spark, tmp_path, "ok") == [(20, 14.0)]


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    path = written(spark, tmp_path, [[(1, 5.0, 0), (2, -1.0, 1)], [(3, -4.0, 2), (2, 3.0, 3)]])
    letters = DeadLetters(spark, f"{tmp_path}/letters", "event_id", "ts")
    work_on(spark, tmp_path, path, letters)
    before = kept(spark, tmp_path, "ok"), kept(spark, tmp_path, "failed"), sorted((r.event_id, r.attempts) for r in letters.rows().collect())
    for note in [*(tmp_path / "state" / "commits").iterdir(), *(tmp_path / "state" / "offsets").iterdir()]:
        number = int(note.name.strip(".").removesuffix(".crc"))
        if number > 1 or number == 1 and note.parent.name == "commits":
            note.unlink()  # as if the driver had been lost before it noted the end of batch 1
    work_on(spark, tmp_path, path, letters)
    assert before == (kept(spark, tmp_path, "ok"), kept(spark, tmp_path, "failed"), sorted((r.event_id, r.attempts) for r in letters.rows().collect()))
    assert before[2] == [(2, 1), (3, 1)]


def test_dead_letters_are_bounded_and_retried(spark, tmp_path):
    letters = DeadLetters(spark, f"{tmp_path}/letters", "k", "at", most=3, attempts=2)
    assert letters.rows() is None and letters.flush(lambda df: df, "true", f"{tmp_path}/done") == (0, 0)
    letters.put(spark.createDataFrame([(i, i, float(i)) for i in range(5)], "k long, at long, v double"))
    assert sorted(r.k for r in letters.rows().collect()) == [2, 3, 4]
    letters.put(spark.createDataFrame([(3, 9, -3.0)], "k long, at long, v double"))
    assert sorted((r.k, r.v) for r in letters.rows().collect()) == [(2, 2.0), (3, -3.0), (4, 4.0)]
    tried = lambda df: df.withColumn("fine", F.col("v") > 3)
    assert letters.flush(tried, "fine", f"{tmp_path}/done") == (1, 0)
    assert [r.k for r in spark.read.parquet(f"{tmp_path}/done").collect()] == [4]
    given_up = read_version(spark, letters.root, "given_up").collect()
    assert sorted((r.k, r.attempts) for r in given_up) == [(2, 2), (3, 2)] and letters.rows().count() == 0


def test_a_lost_flush_leaves_the_queue(spark, tmp_path, monkeypatch):
    letters = DeadLetters(spark, f"{tmp_path}/letters", "k", "at")
    letters.put(spark.createDataFrame([(1, 1), (2, 2)], "k long, at long"))
    monkeypatch.setattr(files, "_swapped", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        letters.flush(lambda df: df.withColumn("fine", F.col("k") == 1), "fine", f"{tmp_path}/done")
    monkeypatch.undo()
    assert sorted((r.k, r.attempts) for r in letters.rows().collect()) == [(1, 1), (2, 1)]
    letters.flush(lambda df: df.withColumn("fine", F.col("k") == 1), "fine", f"{tmp_path}/done")
    assert [r.k for r in spark.read.parquet(f"{tmp_path}/done").collect()] == [1]


RULE = Rule(length=60_000_000, gap=20_000_000, period=1_000_000, least_span=5_000_000, least_size=50)


def test_roll_over_rule():
    second = 1_000_000
    frames = [(i * second // 2, 10) for i in range(150)]  # two frames a second for 75 seconds: every other one is left out
    now, closed = rolled(None, frames, RULE)
    assert closed == [(0, 60 * second, 121, 60, 0, 61, 1210)] and (now.start, now.last, now.n_read) == (60 * second, 149 * second // 2, 29)
    slow = [(i * 4 * second, 10) for i in range(12)]  # a frame each four seconds: three of four are padded
    now, closed = rolled(None, [*slow, (100 * second, 10), (103 * second, 100), (200 * second, 1)], RULE)
    assert closed == [(0, 44 * second, 12, 44, 33, 1, 120)]  # the segment of 3 seconds is dropped
    assert rolled(None, [(0, 1), (8 * second, 1), (99 * second, 1)], RULE)[1] == []  # too small


def test_roll_over_stream_is_the_batch_and_late_frames_are_dropped(spark, tmp_path):
    rng = random.Random(2)
    times = sorted(rng.sample(range(0, 4000), 700))
    frames = [(i, float(rng.randrange(1, 30)), t) for i, t in enumerate(times)]
    batches = [frames[k : k + 100] for k in range(0, 700, 100)]
    batches[3] = [*batches[3], batches[2][5]]  # a frame that comes twice
    batches[5] = [*batches[5][:50], *batches[5][50:][::-1]]
    batches[6] = [*batches[6], (9_999, 5.0, 1)]  # late by far
    path = written(spark, tmp_path, batches)
    clips = clip_stream(spark, path, files_per_batch=1)
    got = rollover(clips.select(F.lit(1).cast("long").alias("camera_id"), F.col("event_id").alias("frame_id"), "at", F.unix_micros("at").alias("us"), F.col("value").cast("long").alias("size")), RULE, "5 minutes")
    told = sorted(tuple(r)[1:] for r in spark.read.parquet(drained(got, str(tmp_path))).collect())
    zero = 1_704_067_200_000_000
    mark = zero + (times[-1] - 300) * 1_000_000
    now, want = rolled(None, [(zero + t * 1_000_000, int(v)) for _, v, t in frames if zero + t * 1_000_000 <= mark], RULE)
    if mark > now.last + RULE.gap and (last := now.closed(RULE)):
        want.append(last)
    assert len(want) > 20 and told == sorted(want)


def test_first_of_each_is_that_of_plain_python():
    """Ties by order go by content; missing keys are one key; the latest time goes along."""
    import pyarrow as pa

    from cliploom.streaming.segments import _first_of_each

    rng = random.Random(3)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), rng.randrange(3), rng.choice([None, 5, 9])) for _ in range(60)]
    shape = pa.schema([("k", pa.int64()), ("v", pa.string()), ("order_", pa.int64()), ("seen_", pa.timestamp("us", "UTC"))])
    table = pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
    best = {}
    for k, v, o, _ in rows:
        content = str((None if k is None else str(k), v, o))
        best[k] = min(best.get(k, (o, content, v)), (o, content, v), key=lambda x: x[:2])
    latest = {k: max((s for q, _, _, s in rows if q == k and s is not None), default=None) for k in best}
    got = _first_of_each(table, "k", ["k"])
    assert {r["k"]: (r["order_"], r["v"]) for r in got.select(["k", "v", "order_"]).to_pylist()} == {k: (b[0], b[2]) for k, b in best.items()}
    assert dict(zip(got["k"].to_pylist(), got["seen_"].cast("int64").to_pylist(), strict=True)) == latest


def test_no_key_is_a_group_of_its_own_in_python(spark, tmp_path):
    """A batch of many keys, copies among them, is one pass by columns and a state of one row a key."""
    spark.range(5_000).selectExpr("id % 4000 AS event_id", "1L AS user_id", "1.0D AS value", "'view' AS event_type", "TIMESTAMP_NTZ '2024-01-01 08:00:01' AS ts").coalesce(1).write.parquet(f"{tmp_path}/rows")
    progress = work_on(spark, tmp_path, f"{tmp_path}/rows")
    state = next(p["stateOperators"][0] for p in progress if p["stateOperators"])
    assert state["operatorName"] == "dedupeWithinWatermark" and state["numRowsTotal"] == 4_000
    assert kept(spark, tmp_path, "ok") == [(i, 2.0) for i in range(4_000)]
