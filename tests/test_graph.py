"""Components by large and small stars, and the summary of events."""

import random

from cliploom.operators import graph


def told(df):
    return {r.node: r.component for r in df.collect()}


def brute(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is None or b is None:
            for x in (a, b):
                if x is not None:
                    find(x)
            continue
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def test_random_graphs(spark):
    rng = random.Random(4)
    for n in (5, 60):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(n * 3 // 4)] + [(3, 3), (None, 2), (77, None)]
        assert told(graph.components(spark.createDataFrame(pairs, "a long, b long"))) == brute(pairs)
    assert told(graph.components(spark.createDataFrame([], "a long, b long"))) == {}


def test_a_long_chain_takes_few_rounds(spark):
    order = list(range(10_000))
    random.Random(1).shuffle(order)
    rounds = []
    edges = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long").repartition(8)
    assert set(told(graph.components(edges, rounds)).values()) == {0}
    assert len(rounds) <= 14


def test_a_star_of_a_third_of_all_edges(spark):
    rounds = []
    star = [(9_999, i) for i in range(3_000)]
    rest = [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(6_000)]
    got = told(graph.components(spark.createDataFrame(star + rest, "a long, b long"), rounds))
    assert got == brute(star + rest) and len(rounds) <= 4


def test_neighbours_of_a_centre_are_split(spark):
    """No join key holds more than a part of a node's rows, and minima come before the shuffle."""
    rows = spark.range(16_000).selectExpr("CAST(-1 AS LONG) AS u", "id AS v")
    plan = graph._with_least(rows)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
    dealt = rows.selectExpr("pmod(xxhash64(v), 16) AS salt").groupBy("salt").count().collect()
    assert len(dealt) == graph.SALTS and max(r["count"] for r in dealt) < 2_000


def test_event_summary(spark):
    pairs = [(1, 2, True), (2, 3, True), (3, 4, False), (8, 9, True)]
    one = graph.event_summary(spark.createDataFrame(pairs, "left_clip long, right_clip long, same boolean")).first()
    assert tuple(one) == (6, 3, 0.5, 2, False)
    pairs.append((3, 8, True))
    one = graph.event_summary(spark.createDataFrame(pairs, "left_clip long, right_clip long, same boolean")).first()
    assert (one.n_events, one.reduction, one.most_pairs, one.branching) == (None, None, 3, True)
    none = graph.event_summary(spark.createDataFrame([], "left_clip long, right_clip long, same boolean")).first()
    assert tuple(none) == (0, 0, None, 0, False)


def test_paths_in_order_are_joined_where_they_lie(spark):
    """Two rounds find that nothing is left to do; a path over several partitions takes few more."""
    rounds = []
    edges = spark.range(0, 20_000, 1, 4).filter("id % 5 <> 4").selectExpr("id AS a", "id + 1 AS b")
    got = told(graph.components(edges, rounds))
    assert got == {n: n - n % 5 for n in range(20_000)} and len(rounds) <= 3
    rounds = []
    assert set(told(graph.components(spark.range(0, 20_000, 1, 4).selectExpr("id + 1 AS a", "id AS b"), rounds)).values()) == {0} and len(rounds) <= 4


def test_blocks_of_a_partition(spark, monkeypatch):
    import numpy as np

    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)]
    a, b = (np.array(side, np.int64) for side in zip(*pairs, strict=True))
    u, v = graph._stars(a, b)
    want = {n: c for n, c in brute(pairs).items() if n != c}
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == want
    assert len(graph._stars(a[:0], b[:0])[0]) == 0
