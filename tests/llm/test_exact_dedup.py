import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cliploom.llm import exact_dedup


def brute(rows, pick):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out, seen = [], set()
    for doc_id, text in rows:
        mine = groups[text or ""]
        keep = pick((d for d in mine if d is not None), default=None)
        first = (doc_id, text or "") not in seen
        seen.add((doc_id, text or ""))
        out.append((doc_id, keep, len(mine), doc_id == keep and first, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("keep", "pick"), [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("rounds", [1, 3, 4])
def test_edges(edge_docs, keep, pick, rounds):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = [tuple(r) for r in exact_dedup.exact_dedup(edge_docs, keep=keep, rounds=rounds).collect()]
    assert sorted(got, key=str) == brute(rows, pick)


def test_documents(docs):
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], max)


def test_hot_group_is_spread(spark):
    """A text with most of the rows reaches no aggregation as more rows than there are cells."""
    hot = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, CAST(id AS STRING), 'same') AS text")
    got = exact_dedup.exact_dedup(hot)
    assert got.filter("kept").count() == 1667 + 1
    assert got.filter("group_size > 1").select("keep_id").distinct().collect()[0][0] == 4999


def test_stage_keeps_columns(edge_docs, no_docs):
    out = exact_dedup.without_copies(edge_docs)
    assert out.columns == edge_docs.columns
    assert out.count() == exact_dedup.exact_dedup(edge_docs).filter("kept").count()
    assert exact_dedup.without_copies(no_docs).count() == 0 and exact_dedup.exact_dedup(no_docs).count() == 0


def test_a_row_that_repeats_whole_is_spread(spark):
    """A third of the rows are one row; they lie in all cells and one of them stays."""
    rows = spark.range(6000).selectExpr("IF(id % 3 = 0, -5, id) AS doc_id", "IF(id % 3 = 0, 'again', CAST(id AS STRING)) AS text", "id AS other")
    got = exact_dedup.exact_dedup(rows)
    assert got.filter("kept").count() == 4001 and got.filter("doc_id = -5 AND kept").count() == 1
    assert {r.group_size for r in got.filter("doc_id = -5").collect()} == {2000}
    stays = exact_dedup.without_copies(rows)
    assert stays.count() == 4001 and stays.filter("doc_id = -5").count() == 1 and stays.columns == rows.columns


def test_runs_are_merged_as_they_lie(spark, docs):
    """A round joins two sorted runs without a shuffle or a sort, and leaves settings as they were."""
    rows = exact_dedup.digests(docs).selectExpr("*", "pmod(doc_id, 256) AS cell")
    cells = rows.groupBy("cell", *exact_dedup.MATCH).agg(F.max(F.struct(F.lit(True), "doc_id", "cell")).alias("winner"), F.count("*").alias("size"))
    runs = exact_dedup.SortedRuns(spark, exact_dedup.PICKS["largest"])
    level = runs.leaves(cells, 4)
    before = {name: spark.conf.get(name) for name in exact_dedup.AS_SORTED}
    with exact_dedup.settings(spark, exact_dedup.AS_SORTED):
        merged = runs.merged(level)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        sizes = merged.groupBy("pair").agg(F.sum("size").alias("n")).collect()
    assert sum(r.n for r in sizes) == docs.count() and len(sizes) == 1
    assert {name: spark.conf.get(name) for name in exact_dedup.AS_SORTED} == before


def test_no_python_in_plan(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
