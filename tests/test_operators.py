"""Edge cases of the engine's own operators, on rows made by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cliploom.functions import arrays, text, times
from cliploom.functions.ratios import wilson
from cliploom.operators import audit, events, features, metrics, queues, routing, sampling, state

CLIP = "clip_id long, camera_id long, activity_day date, us long, duration_sec double"


def clips(spark, rows):
    return spark.createDataFrame([(i, 1, dt.date(2024, 1, 1), int(us * 1e6), d) for i, us, d in rows], CLIP)


def no_states(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], "clip_id long, state string, reason_code string")


def numbers(df, threshold):
    return [(r.clip_id, r.event_no) for r in events.numbered_events(df, threshold).orderBy("us", "clip_id").collect()]


def test_gap_at_threshold_joins_and_beyond_splits(spark):
    df = events.account(clips(spark, [(1, 0, 10.0), (2, 25, 5.0), (3, 45.000001, 5.0)]), no_states(spark))
    assert numbers(df, 15) == [(1, 1), (2, 1), (3, 2)]


def test_gap_is_from_the_clip_before_not_from_the_longest(spark):
    df = events.account(clips(spark, [(1, 0, 100.0), (2, 10, 1.0), (3, 40, 1.0)]), no_states(spark))
    assert numbers(df, 15) == [(1, 1), (2, 1), (3, 2)]


def test_excluded_clip_breaks_a_run_restored_does_not(spark):
    rows = [(1, 0, 5.0), (2, 6, 1.0), (3, 8, 5.0)]
    cut = events.account(clips(spark, rows), no_states(spark, (2, "quarantined")))
    assert numbers(cut, 60) == [(1, 1), (3, 2)]
    back = events.account(clips(spark, rows), no_states(spark, (2, "restored")))
    assert numbers(back, 60) == [(1, 1), (2, 1), (3, 1)]


def test_accounting_reasons(spark):
    df = clips(spark, [(1, 0, None), (2, 1, float("nan")), (3, 2, 0.0), (4, 3, 1.0), (5, 4, 1.0)])
    got = {r.clip_id: (r.kind, r.reason) for r in events.account(df, no_states(spark, (4, "media_deleted")), F.col("clip_id") == 5).collect()}
    assert got == {1: ("diagnostic", "invalid_duration"), 2: ("diagnostic", "invalid_duration"), 3: ("diagnostic", "invalid_duration"), 4: ("diagnostic", "unknown:media_deleted"), 5: ("blocked", "formal_or_frozen_manifest")}


def test_negative_gap_pairs_but_ends_a_chain(spark):
    df = events.account(clips(spark, [(1, 0, 5.0), (2, 10, 20.0), (3, 15, 5.0), (4, 30, 5.0)]), no_states(spark))
    pairs = events.adjacent_pairs(df)
    assert sorted(r.gap_us for r in pairs.collect()) == [-15_000_000, 5_000_000, 10_000_000]
    assert [r.n_pairs for r in events.chains(pairs).orderBy("chain_no").collect()] == [1, 1]


def test_activity_day_starts_at_seven_in_seoul(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-01-01 21:59:59', timestamp_ntz'2024-01-01 22:00:00')) AS t").select(times.activity_day(F.col("t")).alias("d"))
    assert [str(r.d) for r in df.collect()] == ["2024-01-01", "2024-01-02"]


def test_displayed_seconds_round_half_up(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.4999,), (-0.5,)], "x double").select(times.displayed_seconds(F.col("x")).alias("s"))
    assert [r.s for r in df.collect()] == [1, 2, 2, 0]


def test_trailing_counts_exclude_equal_times_and_cross_hours(spark):
    rows = clips(spark, [(1, 3590, 1.0), (2, 3600, 1.0), (3, 3600, 1.0), (4, 4189.999999, 1.0), (5, 4190, 1.0), (6, 7200, 1.0)])
    got = {r.clip_id: (r.n_10m, r.n_60m) for r in features.trailing_counts(rows).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (1, 1), 4: (3, 3), 5: (4, 4), 6: (0, 4)}


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, None)], "id int, v int")
    got = {r.id: r.p for r in df.withColumn("g", F.lit(1)).select("id", features.average_rank(F.col("v"), ["g"]).alias("p")).collect()}
    assert got == {1: 0.25, 2: 0.25, 3: 1.0, 4: None}


def test_runs_and_spans(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0, 3.0, 0.0, 4.0]), (2, [0.0]), (3, [])], "id int, v array<double>")
    assert [(r.n_bursts, r.longest) for r in features.burst_stats(df, "id", "v", 1.0).orderBy("id").collect()] == [(2, 2), (0, 0), (0, 0)]
    assert [(r.first_at, r.last_at) for r in features.active_span(df, "id", "v", 1.0).orderBy("id").collect()] == [(1, 4), (None, None), (None, None)]
    late = features.late_ratio(df, "id", "v").orderBy("id").collect()
    assert late[0].n_late == 2 and late[0].ratio == pytest.approx((4 / 2) / (9 / 5)) and late[1].ratio == 0.0


def test_pages_are_cut_by_time_then_key(spark):
    df = spark.createDataFrame([(1, 10), (2, 10), (3, 9)], "id long, t long")
    assert [r.id for r in queues.page(df, "t", "id", None, 1).collect()] == [2, 1]
    assert [r.id for r in queues.page(df, "t", "id", (10, 2), 5).collect()] == [1, 3]


def test_empty_action_list_matches_nothing(spark):
    c, logs = spark.createDataFrame([(1,), (2,)], "clip_id long"), spark.createDataFrame([(1, "a")], "clip_id long, action string")
    count = lambda *a: queues.logged(c, logs, *a).count()
    assert (count(None), count(False), count(True), count(None, ["a"]), count(None, [])) == (2, 1, 1, 1, 0)


def test_lease_is_retried_then_fails(spark):
    jobs = spark.createDataFrame([(1, "leased", 0, 5), (2, "leased", 2, 5), (3, "leased", 0, 50), (4, "queued", 0, 5)], "job_id long, status string, attempt int, lease_us long")
    got = {r.job_id: (r.next_status, r.next_attempt, r.next_us) for r in state.reclaimed(jobs, 10, 3).collect()}
    assert got == {1: ("queued", 1, 10 + times.MINUTE), 2: ("failed", 3, None), 3: ("leased", 0, None), 4: ("queued", 0, None)}


def test_kappa_edges(spark):
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert metrics.kappa(same, "a", "b").first().kappa == 1.0
    off = spark.createDataFrame([("x", "y"), ("y", "x")], "a string, b string")
    assert metrics.kappa(off, "a", "b").first().kappa == -1.0


def test_wilson_bounds(spark):
    low, high = wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (5, 10)], "k long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert (rows[0].l, rows[0].h) == (0.0, 0.0)
    assert rows[1].l == pytest.approx(0.2365931, abs=1e-6) and rows[1].h == pytest.approx(0.7634069, abs=1e-6)


def test_votes_break_ties_by_confidence_then_label(spark):
    df = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.9), (2, "b", 0.5), (2, "a", 0.5), (3, "a", 0.1)], "id int, pred string, conf double")
    assert {r.id: r.voted for r in metrics.votes(df, "id").collect()} == {1: "b", 2: "a"}


def feature_rows(spark, *rows):
    """Quiet, well seen and ready, but for what a row gives."""
    base = {"status": "ready", "reliability": "high", "bursts": 1, "motion_mean": 0.02, "motion_peak": 0.05, "motion_std": 0.01, "active_ratio": 0.3, "delta": 0.0, "longest_burst": 1.0}
    base |= {"duration_sec": 60.0, "has_motion": True, "window_30m": 1, "center_ratio": 0.5, "late_ratio": 1.0, "last_motion": 10.0}
    types = "status string, reliability string, bursts int, motion_mean double, motion_peak double, motion_std double, active_ratio double, delta double, longest_burst double"
    types += ", duration_sec double, has_motion boolean, window_30m int, center_ratio double, late_ratio double, last_motion double"
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], types)


def test_operational_route_by_rule(spark):
    rows = feature_rows(
        spark,
        {"status": None},
        {"status": "failed", "motion_mean": 1.0},
        {"motion_mean": None},
        {"reliability": "low", "bursts": 9},
        {"bursts": 4},
        {"bursts": None},
        {"longest_burst": 12.0},
        {"longest_burst": 11.9},
        {"longest_burst": 3.0, "duration_sec": 12.0},
        {"has_motion": False},
        {"motion_mean": 0.001, "motion_peak": 0.005, "active_ratio": 0.01, "bursts": None, "window_30m": None, "reliability": None},
        {"motion_mean": 0.001, "motion_peak": 0.005, "active_ratio": 0.01, "window_30m": 3},
    )
    assert [r.r.reason for r in rows.select(routing.operational_route().alias("r")).collect()] == [
        "feature_not_ready:missing",
        "feature_not_ready:failed",
        "feature_not_ready:missing_or_low_reliability",
        "feature_not_ready:missing_or_low_reliability",
        "strong_activity_or_burst",
        "moderate_activity_batchable",
        "strong_activity_or_burst",
        "moderate_activity_batchable",
        "strong_activity_or_burst",
        "extreme_static_reliable",
        "extreme_static_reliable",
        "low_activity_batchable",
    ]


def test_guard_patches_two_routes_only(spark):
    rows = feature_rows(spark, {"active_ratio": 0.7}, {"active_ratio": 0.7, "last_motion": 56.0}, {"active_ratio": 0.7, "last_motion": None}, {"late_ratio": 1.8, "motion_peak": 0.08}, {"late_ratio": 1.7})
    told = routing.enriched(rows).collect()
    assert [(r.baseline_route, r.candidate_route, r.priority) for r in told] == [
        ("cloud_now", "cloud_later", 0.42),
        ("cloud_now", "cloud_now", 0.88),
        ("cloud_now", "cloud_later", 0.42),
        ("cloud_later", "review_candidate", 0.74),
        ("cloud_later", "cloud_later", 0.58),
    ]


def test_each_active_state_breaks_a_run_and_tells_why(spark):
    rows = [(1, 0, 10.0), (2, 12, 1.0), (3, 20, 5.0)]
    for state in ("candidate", "quarantined", "media_deleted", "deletion_blocked"):
        told = events.account(clips(spark, rows), no_states(spark, (2, state)))
        assert [r.reason for r in told.orderBy("clip_id").collect()] == [None, f"unknown:{state}", None]
        assert [n for _, n in numbers(told, 60)] == [1, 2]
    issues = lambda members: {r.code: r.n for r in events.accounting_issues(clips(spark, rows), told, members).collect()}
    good = events.numbered_events(told, 60)
    assert set(issues(good).values()) == {0}
    assert issues(good.filter("clip_id = 1"))["event_coverage"] == 1
    assert issues(good.unionByName(good))["event_coverage"] == 2
    assert issues(good.withColumn("camera_id", F.col("camera_id") + 1))["crosses_camera_or_day"] == 2


@pytest.mark.parametrize("width", [1, 4, 13])
def test_selections_do_not_depend_on_partitions(spark, width):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        rows = spark.range(500).repartition(width).select("id", (F.col("id") % 3).alias("s"))
        parts = sampling.split(rows, "x", "id", 70)
        assert parts.filter("part = 'first'").count() == 350
        picked = sampling.per_stratum(rows, "x", "id", ["s"], 4)
        assert sorted(r.id for r in picked.collect()) == sorted(r.id for r in sampling.per_stratum(spark.range(500).select("id", (F.col("id") % 3).alias("s")), "x", "id", ["s"], 4).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sets_and_texts(spark):
    a = spark.createDataFrame([(1,), (2,)], "k long")
    b = spark.createDataFrame([(2,), (3,)], "k long")
    assert {(r.k, r.side) for r in audit.symmetric_difference(a, b).collect()} == {(1, "first"), (3, "second")}
    assert audit.key_report(a, b, "k").first().asDict() == {"missing": 1, "unexpected": 1, "common": 1, "complete": False}
    t = spark.createDataFrame([(" a \n b ", "x {\"k\": 1} y", "0.5", "walk_motion.mp4"), ("  ", "none", "NaN", "a.mp4")], "a string, b string, c string, d string")
    got = t.select(text.squeezed(F.col("a")), text.json_in(F.col("b")), text.clamped(F.col("c")), text.motion_of(F.col("d"))).collect()
    assert [tuple(r) for r in got] == [("a b", '{"k": 1}', 0.5, True), ("unknown", None, 0.0, None)]


def test_same_set_and_changed(spark):
    df = spark.createDataFrame([(["b", "a", "a"], ["a", "b"]), (None, []), (["a"], None)], "x array<string>, y array<string>")
    assert [r[0] for r in df.select(arrays.same_set(F.col("x"), F.col("y"))).collect()] == [True, True, False]


def test_not_exists_is_an_anti_join(spark):
    c = spark.createDataFrame([(1, True, "k", 1)], "clip_id long, has_motion boolean, media_key string, us long")
    plan = queues.pending(c, c.select("clip_id"), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_index_percentiles_and_quartiles(spark):
    import statistics

    from cliploom.operators import summaries

    draw = [((i * 7919) % 101) ** 2 / 7 for i in range(57)]
    rows = [("a", v) for v in draw] + [("b", 5.0), ("b", 1.0)] + [("c", 3.0)] * 9
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in summaries.index_percentiles(df, "v", "g").collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        n = len(v)
        assert (got[g].n, got[g].p50_low, got[g].p95_low, got[g].p95_even) == (n, v[int((n - 1) * 0.5)], v[int((n - 1) * 0.95)], v[round((n - 1) * 0.95)])
    q = {r.g: (r.q1, r.q2, r.q3) for r in summaries.exclusive_quartiles(df, "v", "g").collect()}
    assert q["a"] == pytest.approx(statistics.quantiles(draw, n=4)) and q["b"] == (1.0, 1.0, 1.0) and q["c"] == (3.0, 3.0, 3.0)


def test_peaks_are_thinned_and_segments_matched(spark):
    from cliploom.operators import selection

    peaks = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 5), (1, 3, 7), (2, 0, 1)], "k long, t long, v long")
    assert sorted(tuple(r) for r in selection.thinned(peaks, ["k"], "t", "v", 2, 9).collect()) == [(1, 1, 9), (1, 3, 7), (2, 0, 1)]
    a = spark.createDataFrame([(1, "x", 0.0), (1, "x", 0.5), (2, "y", 0.0)], "k long, action string, at double")
    b = spark.createDataFrame([(1, "x", 0.4), (1, "y", 0.4), (3, "z", 0.0)], "k long, action string, at double")
    assert sorted(tuple(r) for r in selection.matched(a, b, "k", 1.0).collect()) == [(1, 1, 1, 1), (2, 0, 1, 0), (3, 0, 0, 1)]


def test_entry_imports_without_the_corpus_part(tmp_path):
    """The registry works where the corpus subpackage and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "cliploom"), tmp_path / "cliploom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'event_groups' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_near_counts_join_nothing(spark):
    """Rows up to the bound on both sides count, in the buckets around; missing times and objects without rows are left out."""
    import random

    from cliploom.operators import features

    rng = random.Random(5)
    times = [rng.randrange(0, 400) for _ in range(120)] + [None, 100, 100, 110, 90]
    asked = [(i, t) for i, t in enumerate([0, 90, 99, 100, 101, 110, 5000, None, *[rng.randrange(-30, 450) for _ in range(60)]])]
    near = features.near_counts(spark.createDataFrame(asked, "id long, us long"), spark.createDataFrame([(t,) for t in times], "us long"), "us", 10)
    counts = {i: sum(t is not None and abs(t - at) <= 10 for t in times) for i, at in asked if at is not None}
    assert {r.id: r.n_near for r in near.collect()} == {i: n for i, n in counts.items() if n}
    assert "Join" not in near._jdf.queryExecution().executedPlan().toString()
