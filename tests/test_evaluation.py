"""Edges of scores, reviews and series."""

from pyspark.sql import functions as F

from cliploom.operators import evaluation, shapes


def test_curve_counts_at_equality_and_beyond_the_grid(spark):
    rows = spark.createDataFrame([(0.5, True), (0.49, True), (-1.0, True), (2.0, False), (None, True)], "s double, p boolean")
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in evaluation.threshold_curve(rows, F.col("p"), F.col("s"), 2).collect()}
    assert got == {0.0: (2, 1, 2), 0.5: (1, 1, 3), 1.0: (0, 1, 4)}


def test_declared_classes_without_rows_stay(spark):
    rows = spark.createDataFrame([(1, "A", True), (1, "A", False), (1, None, True)], "v int, t string, ok boolean")
    got = sorted((r["class"], r.n, r.recall) for r in evaluation.recall_matrix(rows, "v", "t", F.col("ok"), ["A", "B"]).collect())
    assert got == [("A", 2, 0.5), ("B", 0, None)]


def test_tied_majority_goes_to_the_first_vote(spark):
    rows = spark.createDataFrame([(1, 1, "x", "x"), (1, 2, "y", "x"), (1, 3, "y", "x"), (1, 4, "x", "x"), (2, 1, "z", "z")], "i int, o int, v string, t string")
    got = evaluation.unanimity(rows, "i", "o", "v", "t").collect()[0]
    assert tuple(got) == (1, 0, 0, 1)


def test_states_of_a_review(spark):
    rows = spark.createDataFrame(
        [(1, 1, "a"), (2, 1, "a"), (2, 2, "a"), (3, 1, "a"), (3, 2, "b"), (4, 1, "n"), (4, 2, "n"), (4, 3, "b"), (5, 3, "a")], "i int, r int, d string"
    )
    got = {r.i: (r.state, r.final) for r in evaluation.settled(rows, "i", "r", "d", "n").collect()}
    assert got == {1: ("awaiting", None), 2: ("agreed", "a"), 3: ("conflict", None), 4: ("resolved", "b"), 5: ("awaiting", None)}


def test_empty_tables_score_zero(spark):
    none = spark.createDataFrame([], "t boolean, p boolean")
    assert tuple(evaluation.binary_score(none, F.col("t"), F.col("p")).collect()[0]) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_series(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.1, 0.1, 1.0, 0.2, 0.2]), (2, [-1.0, 0.0]), (3, []), (4, None)], "i int, v array<double>")
    got = {r.i: (r.r.start, r.r.length) if r.r else None for r in rows.select("i", shapes.longest_below(F.col("v"), 0.3).alias("r")).collect()}
    assert got[1] == (1, 2) and got[2] == (None, 0) and got[3] == (None, 0)
    assert [r[0] for r in rows.filter("i < 3").orderBy("i").select(shapes.levels(F.col("v"), 2)).collect()] == ["770", "0"]
    n = spark.createDataFrame([(0,), (3,), (11,)], "n long")
    assert [r[0] for r in n.orderBy("n").select(shapes.even_indices(F.col("n"), 5)).collect()] == [[], [0, 1, 2], [0, 2, 5, 7, 10]]


def test_interleave(spark):
    rows = spark.createDataFrame([("s", v) for v in range(5)], "s string, v int")
    got = {r.v: r.place for r in shapes.low_high(rows, ["s"], "v", "v").collect()}
    assert [v for v, _ in sorted(got.items(), key=lambda x: x[1])] == [0, 4, 1, 3, 2]
