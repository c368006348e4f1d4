"""Frame motion, scoped cursors, spreading, witnesses, controls and the short-clip rule against plain Python."""

import base64
import json
import random
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from cliploom.functions import cursors
from cliploom.operators import ledgers, motion, queues, selection, state, studies
from cliploom.streaming.segments import drained

# ---- motion


def blur(v):
    return [v[max(i - 1, 0)] + 2 * v[i] + v[min(i + 1, len(v) - 1)] for i in range(len(v))]


def moved(frames, threshold, percent):
    out, last = [], {}
    for camera, at, cells in sorted(frames):
        now = blur(cells)
        before = last.get(camera)
        n = sum(abs(a - b) > 4 * threshold for a, b in zip(now, before, strict=True)) if before is not None and len(before) == len(now) else None
        out.append((camera, at, n or 0, n is not None and len(now) > 0 and n * 100 / len(now) >= percent))
        last[camera] = now
    return out


FRAMES = "camera_id long, at long, cells array<int>"


def some_frames():
    rng = random.Random(3)
    rows = []
    for camera in range(3):
        cells = [rng.randrange(256) for _ in range(40)]
        for at in sorted(rng.sample(range(200), 60)):
            for _ in range(rng.choice([0, 0, 3, 20])):
                cells[rng.randrange(40)] = rng.randrange(256)
            rows.append((camera, at, list(cells)))
    return rows


@pytest.mark.parametrize("per_slice", [7, 4096])
def test_frames_carry_over_slices(spark, per_slice):
    rows = some_frames()
    got = motion.frame_motion(spark.createDataFrame(rows, FRAMES), 25, 10.0, per_slice)
    assert sorted(map(tuple, got.collect())) == moved(rows, 25, 10.0)


def test_edges_of_motion(spark):
    rows = [(1, 0, [0, 0, 0, 0]), (1, 1, [0, 0, 100, 0]), (1, 2, [0, 0, 100, 0]), (1, 3, [0, 0]), (2, 0, []), (2, 1, []), (3, 0, [7]), (3, 1, [32]), (3, 2, [58])]
    got = {(r.camera_id, r.at): (r.n_changed, r.motion) for r in motion.frame_motion(spark.createDataFrame(rows, FRAMES), 25, 75.0).collect()}
    assert got[1, 0] == (0, False)  # the first frame has none before it
    assert got[1, 1] == (1, False) and got[1, 2] == (0, False)  # a neighbour changes by 25 and that is not above the threshold
    assert got[1, 3] == got[2, 0] == got[2, 1] == (0, False)
    assert got[3, 1] == (0, False) and got[3, 2] == (1, True)  # 25 is not above 25, 26 is; all of one cell is 75 % or more
    least = {r.at: r.motion for r in motion.frame_motion(spark.createDataFrame(rows[:2], FRAMES), 25, 25.0).collect()}
    assert least == {0: False, 1: True}  # exactly the percentage


def test_motion_over_micro_batches(spark, tmp_path):
    rows = some_frames()
    for k in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 50 == k], FRAMES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    told = spark.read.parquet(drained(motion.frame_motion_stream(stream, 25, 10.0), str(tmp_path)))
    assert sorted(map(tuple, told.collect())) == moved(rows, 25, 10.0)


# ---- cursors


def fnv(text):
    h = 0x811C9DC5
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = ((h ^ int.from_bytes(units[i : i + 2], "big")) * 0x01000193) & 0xFFFFFFFF
    return f"{h:x}"


ID = "0a1B2c3D-0000-4000-8000-00000000000f"
AT = "2026-07-24T01:02:03.123456+00:00"


def test_fnv(spark):
    texts = ["", "a", "owner:7|label=é", "\U0001f98e gecko", "x" * 300, "foobar"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cursors.fnv1a(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in got} == {t: fnv(t) for t in texts}
    assert fnv("foobar") == "bf9cf968"  # published value


def test_round_trip_and_refusals(spark):
    pack = lambda **o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    good = {"v": 1, "t": AT, "id": ID, "s": fnv("mine")}
    cases = {
        "good": pack(**good), "scope": pack(**good | {"s": fnv("theirs")}), "version": pack(**good | {"v": 2}), "time": pack(**good | {"t": "yesterday"}),
        "no day": pack(**good | {"t": "2026-02-30T00:00:00Z"}), "id": pack(**good | {"id": "7"}), "json": "bm90IGpzb24", "letters": "%%%", "empty": "", "missing": pack(v=1, t=AT),
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [("null", None)], "name string, token string")
    got = {r["name"]: r.c and (r.c.t, r.c.id) for r in df.select("name", cursors.decoded(F.col("token"), F.lit("mine")).alias("c")).collect()}
    assert got.pop("good") == (AT, ID.lower()) and not any(got.values())
    made = spark.range(1).select(cursors.encoded(F.lit(AT), F.lit(ID), F.lit("mine")).alias("c")).first().c
    assert json.loads(base64.urlsafe_b64decode(made + "=" * (-len(made) % 4))) == good


# ---- spreading


@pytest.mark.parametrize("sizes", [[1], [3, 2], [3, 3], [1, 1, 1], [5, 1, 1, 1, 1], [3, 1, 1, 3, 1, 1, 3], [2, 1], [4, 4, 4], [6, 2, 1, 1, 1]])
def test_spread(spark, sizes):
    rows = [(f"k{i}", r) for i, n in enumerate(sizes) for r in range(n)]
    for seed in ("a", "b", "c"):
        got = sorted((r.place, r.key) for r in selection.spread_runs(spark.createDataFrame(rows, "key string, run int"), "key", "run", seed).collect())
        assert [p for p, _ in got] == list(range(len(rows)))
        keys = [k for _, k in got]
        assert all(a != b for a, b in zip(keys, keys[1:], strict=False)), (sizes, keys)


def test_spread_where_it_is_not_possible(spark):
    rows = [("a", r) for r in range(5)] + [("b", 0)]
    got = [r.key for r in selection.spread_runs(spark.createDataFrame(rows, "key string, run int"), "key", "run", "s").orderBy("place").collect()]
    assert sorted(got) == ["a"] * 5 + ["b"]


# ---- witnesses


def walk(pairs, order, per_bin, per_bin_camera, per_camera):
    kept, used = [], set()
    for b in order:
        for p in sorted((p for p in pairs if p["gap_bin"] == b), key=lambda p: (p["draw"], p["left_clip"])):
            if sum(k["gap_bin"] == b for k in kept) == per_bin:
                break
            same = sum(k["gap_bin"] == b and k["camera_id"] == p["camera_id"] for k in kept), sum(k["camera_id"] == p["camera_id"] for k in kept)
            if same[0] < per_bin_camera and same[1] < per_camera and not {p["left_clip"], p["right_clip"]} & used:
                kept.append(p)
                used |= {p["left_clip"], p["right_clip"]}
    return kept


def test_best_witness(spark):
    import hashlib

    rng = random.Random(8)
    bins = ["short", "medium", "long"]
    pairs = []
    for camera in range(4):
        for i in range(60):
            left = camera * 1000 + i
            pairs.append({"night": rng.randrange(6), "gap_bin": rng.choice(bins), "camera_id": camera, "left_clip": left, "right_clip": left + 1, "draw": hashlib.sha256(f"{left}".encode()).hexdigest()})
    sides = [(a, n) for a in range(5) for n in range(6) if (n + a) % 3]
    found = []
    for a in range(5):
        mine = [p for p in pairs if (a, p["night"]) in sides]
        for i, order in enumerate(permutations(bins)):
            kept = walk(mine, order, 3, 1, 2)
            text = "|".join(sorted(f"{p['left_clip']}-{p['right_clip']}" for p in kept))
            found.append((hashlib.sha256(text.encode()).hexdigest(), a, i, sorted(p["left_clip"] for p in kept)))
    best = min(found)
    df = spark.createDataFrame(pairs, "night int, gap_bin string, camera_id int, left_clip int, right_clip int, draw string")
    got = selection.best_witness(df, spark.createDataFrame(sides, "attempt int, night int"), "night", bins, 3, 1, 2)
    rows = got.collect()
    assert {(r.digest, r.attempt, r.order_no) for r in rows} == {best[:3]} and sorted(r.left_clip for r in rows) == best[3]
    assert "Generate explode" not in df._jdf.queryExecution().toString()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # pairs meet the attempts once, and no order


def test_one_each_then_fill_has_no_window(spark):
    rows = spark.range(200).selectExpr("id", "id % 7 AS s")
    got = selection.one_each_then_fill(rows, "x", "id", ["s"], 20)
    assert got.count() == 20 and got.select("s").distinct().count() == 7 and got.select("id").distinct().count() == 20
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert selection.one_each_then_fill(rows, "x", "id", ["s"], 3).count() == 7


# ---- controls


def test_controls(spark):
    rng = random.Random(6)
    rows = [(i * 7, rng.choice("AB"), rng.choice("AB"), rng.choice("AB")) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, truth string, base string, strong string")
    rules = {"a": F.col("base") == "A", "few": F.col("k") < 40, "none": F.lit(False), "all": F.lit(True)}
    got = {r["rule"]: r for r in studies.escalated_with_control(df, rules, "k").collect()}
    order = sorted(rows, key=lambda r: str(r[0])[::-1])
    for name, size in {"a": sum(r[2] == "A" for r in rows), "few": sum(r[0] < 40 for r in rows), "none": 0, "all": 400}.items():
        want = sum((r[3] if i < size else r[2]) == r[1] for i, r in enumerate(order))
        assert (got[name].n_escalated, got[name].control_right) == (size, want)
    assert got["all"].control_right == got["all"].n_right


# ---- queues and the short-clip rule


def test_the_highest_priority_is_claimed_first(spark):
    jobs = spark.createDataFrame([(1, "queued", 1, 5, 0, 0), (2, "queued", 9, 7, 0, 0), (3, "queued", 9, 6, 0, 0), (4, "queued", 9, 6, 3, 0)], "job_id int, status string, priority int, created_us long, attempt int, lease_us long")
    assert [r.job_id for r in queues.claimable(jobs, 100, 3, 9).collect()] == [3, 2, 1]
    assert [r.job_id for r in ledgers.claimed(jobs, 100, 3, 2, "w", 10).collect()] == [3, 2]


def detect(clip, policy, now, kept, write):
    """The rule for one clip, step by step: route, state, event, before."""
    under = policy["under"] if policy and policy["under"] is not None else 15.0
    if clip is None or clip >= under:
        return "ineligible", "none", None, None
    match = bool(policy and policy["enabled"] and policy["seconds"] and int(clip + 0.5) in policy["seconds"])
    target = "protected" if match and kept else "quarantined" if match else "candidate"
    ought = "deletion_blocked" if target == "protected" else target
    if not write:
        return target, ought, None, None
    if now == "restored":
        return "reused_restored", "restored", None, None
    if now in ("media_deleted", "quarantined", "deletion_blocked"):
        return "reused", now, None, None
    if target == "candidate" and now == "candidate":
        return "reused", "candidate", None, None
    event = {"quarantined": "auto_quarantined", "protected": "delete_blocked", "candidate": "candidate_detected"}[target]
    return target, ought, event, now or "none"


def test_short_clip_rule(spark):
    policies = {1: {"enabled": True, "under": 20.0, "seconds": [5, 6]}, 2: {"enabled": False, "under": 20.0, "seconds": [5]}, 3: {"enabled": True, "under": None, "seconds": []}, 4: {"enabled": None, "under": 10.0, "seconds": [5]}}
    cases, clips, exclusions, kept = [], [], [], []
    for camera in (1, 2, 3, 4, 5):
        for duration in (None, 0.4, 4.4, 4.5, 5.49, 5.5, 6.6, 14.99, 15.0, 19.9, 20.0):
            for now in (None, "candidate", "restored", "quarantined", "media_deleted", "deletion_blocked"):
                for protected in (False, True):
                    for write in (False, True):
                        n = len(cases)
                        cases.append(detect(duration, policies.get(camera), now, protected, write))
                        clips.append((n, camera, duration, write))
                        exclusions += [(n, now)] if now else []
                        kept += [(n,)] if protected else []
    got = state.short_clip_detection(
        spark.createDataFrame(clips, "clip_id long, camera_id int, duration_sec double, w boolean"),
        spark.createDataFrame([(c, p["enabled"], p["under"], f"v{c}", 24 * c, p["seconds"]) for c, p in policies.items()], "camera_id int, enabled boolean, under_sec double, version string, hours int, seconds array<int>"),
        spark.createDataFrame(exclusions, "clip_id long, state string"),
        spark.createDataFrame(kept, "clip_id long"),
        1_000_000,
        F.col("w"),
    )
    rows = {r.clip_id: r for r in got.collect()}
    for n, want in enumerate(cases):
        assert (rows[n].route, rows[n].state, rows[n].event, rows[n].before) == want, (clips[n], want, rows[n])
        assert (rows[n].delete_after_us is not None) == (want[2] == "auto_quarantined")
    assert Counter(r.event for r in rows.values()).keys() == {None, "auto_quarantined", "delete_blocked", "candidate_detected"}
    late = next(r for r in rows.values() if r.event == "auto_quarantined")
    assert late.delete_after_us == 1_000_000 + 24 * 3_600_000_000 and late.rule_version == "v1"
    events = state.detection_events(got, spark.createDataFrame([(late.clip_id, "auto_quarantined")], "clip_id long, event string"))
    ids = {r.clip_id for r in events.collect()}
    assert late.clip_id not in ids and len(ids) == sum(c[2] is not None for c in cases) - 1
