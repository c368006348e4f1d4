"""Ladders, switches, gates, resources and variants at their bounds."""

import statistics

import pytest
from pyspark.sql import functions as F

from cliploom.operators import gates, routing


def one(spark, **values):
    return spark.createDataFrame([tuple(values.values())], list(values))


BASE = {"l0_n": 100, "l0_later": 5, "l0_cloud_now_rate": 0.5, "l0_activity_only_rate": 0.1, "l0_leak_rate": 0.02}


@pytest.mark.parametrize(
    ("first", "second", "still", "want"),
    [
        ({}, (0.0, 0.5), 0.05, "adopt-v1"),
        ({"l0_leak_rate": 0.021}, (0.0, 0.5), 0.0, "reject-unsafe"),
        ({}, (0.03, 0.5), 0.9, "reject-unsafe"),
        ({}, (0.0, 0.95), 0.06, "hold-input-limited"),
        ({"l0_activity_only_rate": 0.0}, (0.0, 0.5), 0.06, "adopt-v1"),
        ({}, (0.0, 0.90), 0.0, "hold-model-limited"),
        ({"l0_later": 0}, (0.0, 0.95), 0.0, "adopt-v1"),
        ({"l0_cloud_now_rate": 0.72}, (0.0, 0.95), 0.0, "hold-model-limited"),
        ({"l0_cloud_now_rate": 0.75}, (0.0, 0.95), 0.0, "hold-policy-too-conservative"),
        ({"l0_cloud_now_rate": 0.56}, None, 0.0, "hold-policy-too-conservative"),
        ({}, None, 0.0, "adopt-v1"),
    ],
)
def test_reasons(spark, first, second, still, want):
    behind = second and one(spark, l1_leak_rate=second[0], l1_cloud_now_rate=second[1])
    assert gates.router_decision(one(spark, **BASE | first), behind, one(spark, static_p0_rate=still)).first().subtype == want


@pytest.mark.parametrize(
    ("leak", "now", "ms", "done", "want"), [(0.05, 0.1, 10.0, True, "reject"), (0.02, 0.4, 3000.0, True, "adopt"), (0.021, 0.4, 10.0, True, "hold"), (0.0, 0.41, 10.0, True, "hold"), (0.0, 0.4, 3001.0, True, "hold"), (0.0, 0.4, 10.0, False, "hold")]
)
def test_labels(spark, leak, now, ms, done, want):
    first = one(spark, **BASE | {"l0_leak_rate": leak, "l0_cloud_now_rate": now})
    assert gates.router_label(first, one(spark, avg_latency_ms=ms), F.lit(done)).first().label == want


def test_route_summary(spark):
    rows = spark.createDataFrame([("cloud_now", True), ("cloud_later", False), ("activity_only", True), ("activity_only", False)], "r string, u boolean")
    assert gates.route_summary(rows, "r", F.col("u"), "x").first().asDict() == {"x_n": 4, "x_later": 1, "x_cloud_now_rate": 0.25, "x_activity_only_rate": 0.5, "x_leak_rate": 0.5}
    assert gates.route_summary(rows.limit(0), "r", F.col("u"), "x").first().x_leak_rate == 0.0


def test_switches(spark):
    rows = [("exclude_absent", "absent")] * 9 + [("exclude_absent", "static")] + [("exclude_static", "static")] * 20 + [("exclude_static", "active")] + [("active", "active")] * 3 + [("exclude_static", None)] * 7
    got = {r.switch: r for r in gates.filter_adoption(spark.createDataFrame(rows, "told string, human string"), "told", "human").collect()}
    a, s = got["exclude_absent"], got["exclude_static"]
    assert (a.n_excluded, a.false_exclusions, a.precision, a.active_recall, a.adopt) == (10, 0, 0.9, 0.75, True)
    assert (s.n_excluded, s.false_exclusions, s.active_recall, s.adopt) == (21, 1, 0.75, False)
    none = gates.filter_adoption(spark.createDataFrame([("active", "static")], "told string, human string"), "told", "human").collect()
    assert all((r.n_excluded, r.precision, r.active_recall, r.adopt) == (0, None, None, False) for r in none) and len(none) == 2


def test_capacity(spark):
    calls = spark.createDataFrame([(float(i), i * 10, i) for i in range(1, 102)], "seconds double, rss_bytes long, temp_bytes long")
    arrivals = spark.createDataFrame([(18,)] * 10, "n long")
    r = gates.capacity_gates(calls, arrivals, 1010, 100).first()
    assert (r.capacity, r.required, r.throughput_pass, r.rss_pass, r.disk_pass, r.all_pass) == (3600 / 96, 36.0, True, True, False, False)
    r = gates.capacity_gates(calls, spark.createDataFrame([(19,)], "n long"), 1009, 101).first()
    assert (r.throughput_pass, r.rss_pass, r.disk_pass) == (False, False, True)


def test_resources(spark):
    hour = 3_600_000_000
    rows = [("a", 0, 50, 100, 1, 10), ("a", hour - 1, 5, 90, 1, 30), ("a", hour, 4, 170, 1, 20), ("b", 1, 5, 7, 1, 1), ("b", 2, 6, 3, 2, 1), ("b", 3, 5, 5, 1, 1)]
    got = {r.run: r for r in gates.resource_summary(spark.createDataFrame(rows, "run string, us long, free_percent int, swap_bytes long, pid int, rss_kib int"), "run", "us").collect()}
    a, b = got["a"], got["b"]
    assert (a.free_min, a.swap_delta, a.rss_max, a.pid_drift, a.low_streak, a.low_free_abort) == (4, 70, 30, False, 2, True)
    assert (b.free_min, b.swap_delta, b.pid_drift, b.low_streak, b.low_free_abort) == (5, 0, True, 1, False)


def test_variants_and_baselines(spark):
    rows = []
    for model, prompt, shape, n in [("m", "v40", "frames", 4), ("m", "v41", "frames", 3), ("m", "v40", "sheet", 5), ("o", "v42", "frames", 2), ("o", "v42", "sheet", 2), ("p", "v40", "sheet", 1)]:
        rows += [(model, prompt, shape, True, "a", "a" if i else "b", 10 * (i + 1) if shape == "frames" else 5, None, 100 * i) for i in range(n)]
    rows += [("m", "v40", "frames", False, "a", None, 999, 1, 9999), ("q", "v40", "frames", False, "a", None, None, None, None)]
    calls = spark.createDataFrame(rows, "model string, prompt string, shape string, ok boolean, truth string, pred string, tokens_in long, tokens_out long, wall_ms long")
    table = gates.variants(calls, {"b": "a"})
    got = {(r.model, r.prompt, r.shape): r for r in table.collect()}
    r = got["m", "v40", "frames"]
    assert (r.n, r.n_right, r.accuracy, r.merged_accuracy, r.avg_tokens_in, r.avg_tokens_out, r.avg_wall_ms, r.median_wall_ms, r.errors) == (4, 3, 0.75, 1.0, 25.0, None, 150.0, statistics.median([0, 100, 200, 300]), 1)
    assert len(got) == 6
    deltas = {(r.model, r.prompt, r.shape): r for r in gates.against_baseline(table, "v40", "frames").collect()}
    assert set(deltas) == {("m", "v41", "frames"), ("m", "v40", "sheet"), ("o", "v42", "sheet")}
    d = deltas["m", "v40", "sheet"]
    assert (d.base_prompt, d.token_reduction, round(d.accuracy_drop_pp, 9), d.wall_delta_ms) == ("v40", 1 - 5 / 25, -5.0, 50.0)
    assert deltas["o", "v42", "sheet"].base_prompt == "v42"


def test_lowered_and_inspected(spark):
    rows = [(1, "error", "cloud_now", "cloud_later"), (5, "error", "cloud_now", "cloud_later"), (3, "moving", "cloud_now", "cloud_later"), (4, "error", "cloud_now", "cloud_now"), (2, "click", "cloud_now", "cloud_later"), (6, "error", "cloud_later", "activity_only")]
    df = spark.createDataFrame(rows, "clip_id long, gt string, baseline_route string, candidate_route string")
    assert sorted((r.gt, r.nth, r.clip_id) for r in routing.lowered(df, ["error", "click"]).collect()) == [("click", 1, 2), ("error", 1, 1), ("error", 2, 5)]
    r = routing.inspection_summary(df, F.col("clip_id") > 3, F.col("clip_id") == 4).first()
    assert (r.before, r.after, r.n_inspect, r.inspect_activity_only, r.inspect_low, r.reduction_rate, r.regression_pass) == (3, 0, 3, 1, 1, 1.0, True)
    assert not routing.inspection_summary(df, F.lit(False), F.col("clip_id") == 6).first().regression_pass


def decided(spark, false_rows, regression):
    a = spark.createDataFrame(false_rows, "before string, after string")
    b = spark.createDataFrame(regression, "truth string, before string, after string")
    return gates.prompt_decision(a, b, "shed", "move", ["eat", "drink"], ["eat", "drink"]).first()


def test_prompt_decisions(spark):
    alarms = [("shed", "move")] * 6 + [("shed", "shed")] * 4 + [("move", "move")] * 5
    fine = [("shed", "shed", "shed")] * 8 + [("eat", "drink", "eat"), ("eat", "hide", "drink"), ("drink", None, "drink"), ("hide", "hide", "hide")]
    r = decided(spark, alarms, fine)
    assert (r.alarms_before, r.alarms_after, r.recovered, r.broken, r.new_errors, r.suppression, r.ok_a) == (10, 4, 6, 0, 0, 0.6, True)
    assert (r.n, r.lost, r.merged_recovered, r.merged_broken, r.harmless, r.ok_b, r.decision) == (12, 0, 1, 0, 1, True, "adopt")
    assert decided(spark, [*alarms, ("shed", "shed")], fine).decision == "hold"  # six of eleven are too few
    assert decided(spark, [*alarms, ("move", "shed")], fine).decision == "reject"
    assert decided(spark, [*alarms, *[("shed", "eat")] * 3], fine).decision == "hold"
    assert decided(spark, [("shed", "shed")] * 5 + [("shed", "move")], fine).decision == "reject"
    lost = [("shed", "shed", None)] * 3 + [("shed", None, "shed")] * 3 + fine
    assert (decided(spark, alarms, lost).lost, decided(spark, alarms, lost).decision) == (3, "hold")
    assert decided(spark, alarms, [("shed", "shed", "x")] * 5 + [("hide", "x", "hide")] * 9 + fine).decision == "reject"
    assert decided(spark, alarms, [("hide", "hide", "x")] + [("hide", "hide", "hide")] * 20).decision == "reject"  # 4.8 points
    none = decided(spark, [], [])
    assert (none.suppression, none.ok_a, none.ok_b, none.decision) == (None, False, False, "hold")


def test_class_distribution(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("z", 1)], "class string, expected int")
    assert sorted((str(r["class"]), r.n, r.expected, r.agrees) for r in gates.class_distribution(rows, expected, "c").collect()) == [("None", 1, 0, False), ("a", 2, 2, True), ("b", 1, 2, False), ("z", 0, 1, False)]


def test_latest_run_and_listing_ties(spark):
    from cliploom.operators import queues

    runs = spark.createDataFrame([(1, 5, 2, "x"), (1, 5, 1, "y"), (1, 4, 0, "z"), (2, 1, 9, "w")], "k int, at int, seen int, v string")
    assert sorted((r.k, r.v) for r in queues.latest_seen(runs, "k", "at", "seen").collect()) == [(1, "y"), (2, "w")]
    clips = spark.createDataFrame([(i, i // 4) for i in range(20)], "clip_id int, us int")
    shown, at = [], {}
    while page := queues.listed(clips, n=3, **at).collect()[:3]:
        shown += [r.clip_id for r in page]
        at = {"before_us": page[-1].us, "before_id": page[-1].clip_id}
    assert shown == list(range(19, -1, -1))
