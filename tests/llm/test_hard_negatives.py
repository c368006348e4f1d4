import numpy as np
import pytest

from cliploom.llm import hard_negatives as hn
from cliploom.llm import queries


def brute(rows, positives=5, negatives=3, every=50):
    """rows: (vec_id, label, list of whole numbers), ids unique."""
    width = max((len(v) for _, _, v in rows), default=0)
    x = np.array([list(v) + [0] * (width - len(v)) for _, _, v in rows], dtype=np.int64).reshape(len(rows), width)
    out = []
    for a, (anchor, label, _) in enumerate(rows):
        if anchor % every:
            continue
        scores = (x @ x[a]).tolist()
        order = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i][0]))
        mine = [i for i in order if rows[i][0] != anchor and str(rows[i][1]) == str(label)][:positives]
        for p in mine:
            fit = [i for i in order if str(rows[i][1]) != str(label) and 50 * scores[p] <= 100 * scores[i] <= 95 * scores[p]]
            out += [(anchor, rows[p][0], n, rows[i][0], scores[p], scores[i]) for n, i in enumerate(fit[:negatives], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "vec_id long, label string, vector array<long>, part int, block string, seat int")


def got(spark, rows, every=50, **how):
    from pyspark.sql import functions as F

    return sorted(tuple(r) for r in hn.hard_negatives(frame(spark, rows), F.col("vec_id") % every == 0, **how).collect())


def random_rows(n, seed=1, labels=4, dims=8, clusters=12):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-60, 60, (clusters, dims))
    x = middle[rng.integers(0, clusters, n)] + rng.integers(-6, 7, (n, dims))
    return [(i, f"l{rng.integers(0, labels)}", v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("labels", [1, 3, 400])
def test_small(spark, labels, monkeypatch):
    """Several parts and blocks; labels that fill trees of their own, and labels that do not."""
    monkeypatch.setattr(hn, "PART", 1024)
    monkeypatch.setattr(hn, "BLOCK", 8)
    rows = random_rows(600, labels=labels)
    assert got(spark, rows, every=10) == brute(rows, every=10)


def test_ties_and_few_rows(spark):
    rows = [(i, "ab"[i % 2], [10, 10 - i % 3]) for i in range(40)]
    assert got(spark, rows, every=5) == brute(rows, every=5)
    assert got(spark, rows[:1]) == got(spark, []) == []
    assert got(spark, [(0, "a", []), (1, "a", [1, 2]), (2, "b", [3]), (3, "b", [])]) == brute([(0, "a", []), (1, "a", [1, 2]), (2, "b", [3]), (3, "b", [])])
    assert got(spark, [(0, "a", [-9]), (1, "a", [5]), (2, "b", [4])]) == []


def test_large_components_are_exact(spark):
    big = (1 << 26) - 1
    rows = [(0, "a", [big] * 6), (1, "a", [big] * 5 + [big - 1]), (2, "b", [big // 2] * 6), (3, "b", [big // 2] * 5 + [big // 2 + 3]), (4, "b", [big] * 6)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [*rows, (5, "b", [big + 1] * 6)]) == brute(rows)


def test_repeated_anchors_count_once_and_nulls_take_no_part(spark):
    rows = random_rows(200)
    more = [*rows, rows[0], rows[0], (None, "l0", rows[1][2]), (7000, None, rows[1][2]), (7001, "l0", None), (7002, "l0", [1, None])]
    want = {r[:1] for r in brute(rows)}
    out = got(spark, more)
    assert {r[:1] for r in out} == want and not {r[1] for r in out} & {7000, 7001, 7002}
    assert [r for r in out if r[0] == 0] == [r for r in brute(rows) if r[0] == 0]


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        v = np.floor(256 * np.array(r.embedding, dtype=np.float32).astype(float)).astype(int).tolist()
        rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, v))
    assert sorted(tuple(r) for r in queries.op11_hard_negatives(spark, sf).collect()) == brute(rows)


def test_bounds_leave_leaves_out():
    """On clustered rows most leaves are never read, and the result is that of all rows."""
    rows = random_rows(4000, labels=2, dims=4, clusters=40)
    x, ids = np.array([v for _, _, v in rows]), np.arange(len(rows))
    forest = hn.planted(x, ids, [label for _, label, _ in rows])
    n_leaves = int((forest.children[:, 0] == 0).sum())
    for i in range(0, 4000, 500):
        asked = hn.Queries(x[i : i + 1], ids[i : i + 1], [rows[i][1]], np.zeros(1, dtype=int), np.array([hn.LOWEST]), np.array([hn.HIGHEST]))
        _, score, _, read = hn.nearest(forest, asked, 5, True)
        mine = [j for j in range(4000) if j != i and rows[j][1] == rows[i][1]]
        assert score.tolist() == sorted((x[mine] @ x[i]).tolist(), reverse=True)[:5]
        assert read < n_leaves / 4
        top = int(score[0])
        asked.low, asked.high = np.array([top * 6 // 10]), np.array([top * 7 // 10])
        _, score, _, read = hn.nearest(forest, asked, 3, False)
        other = [j for j in range(4000) if rows[j][1] != rows[i][1]]
        fit = [s for s in (x[other] @ x[i]).tolist() if top * 6 // 10 <= s <= top * 7 // 10]
        assert score.tolist() == sorted(fit, reverse=True)[:3] and read < n_leaves
