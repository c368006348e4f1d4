import hashlib

import pytest

from cliploom.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOW = str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower())


def key(line):
    return line.strip(BLANKS).translate(LOW)


def brute(rows, least=10):
    """doc_id, lines, lost and kept text of each row; rows that share a doc_id are one document, null ids come last."""
    first = {}
    order = lambda d: (d is None, d or 0)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                first[key(line)] = min(first.get(key(line), doc_id), doc_id, key=order)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or first[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def digest(rows):
    return sorted([(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in rows], key=str)


def told(docs, **how):
    return sorted([tuple(r) for r in line_dedup.line_dedup(docs, **how).collect()], key=str)


ROWS = [
    (5, "Shared line of text\nown line of five\n  SHARED LINE OF TEXT \t"),
    (3, "shared line of text\r\n\nshort\nshort"),
    (3, "shared line of text\nanother row of three"),
    (9, None),
    (8, ""),
    (7, "\n\n"),
    (6, "another row of three\nÄußerst lange Zeile\näußerst lange Zeile"),
    (2, "äußerst lange Zeile"),
    (None, "another row of three\nonly nulls hold this"),
    (None, "only nulls hold this\n\n"),
    (11, "shared line of text"),
    (11, "shared line of text"),
    (12, "123456789\n1234567890"),
    (13, "123456789\n 1234567890"),
]


@pytest.mark.parametrize(("batches", "fan_in"), [(1, 2), (3, 2), (9, 2), (8, 4)])
def test_small(spark, batches, fan_in):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert told(docs, batches=batches, fan_in=fan_in) == digest(brute(ROWS))


def test_edges(edge_docs, no_docs):
    assert told(edge_docs) == digest(brute([(r.doc_id, r.text) for r in edge_docs.collect()]))
    assert told(no_docs) == [] and line_dedup.without_repeated_lines(no_docs).count() == 0
    out = line_dedup.without_repeated_lines(edge_docs)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()


def test_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert told(docs) == digest(brute(rows))
    want = {(d, t) for d, _, _, t in brute(rows)}
    assert {(r.doc_id, r.text or "") for r in line_dedup.without_repeated_lines(docs).collect()} == want


def test_hot_line_and_repeated_rows(spark):
    docs = spark.range(3000).selectExpr("IF(id % 3 = 1, 7, id) AS doc_id", "IF(id % 3 < 2, 'the line that a third has\nx', 'own line number ' || id) AS text")
    assert told(docs) == digest(brute([(r.doc_id, r.text) for r in docs.collect()]))


def test_batches_of_a_caller(spark):
    """Runs are passed on from batch to batch, compacted level by level; the earliest batch is first."""
    runs = line_dedup.LineRuns(spark, fan_in=2)
    levels, gone = [], []
    for day in range(7):
        docs = spark.createDataFrame([(100 - day, f"line of every day\nline of day {day // 2} and its next\nonly on day {day}")], "doc_id long, text string")
        gone.append(sorted(r.pos for r in runs.take(line_dedup.line_keys(docs, 10)).collect()))
        levels.append(sorted(level for level, _, _ in runs.runs))
    assert gone == [[], [0, 1], [0], [0, 1], [0], [0, 1], [0]]
    assert levels == [[0], [0, 0], [0, 1], [0, 0, 1], [0, 2], [0, 0, 2], [0, 1, 2]]
    held = [r.key for _, _, run in runs.runs for r in run.collect()]
    assert len(held) == len(set(held)) == 1 + 4 + 7


def test_plan(spark, docs):
    """No Python; runs meet a batch without a shuffle of theirs."""
    plan = line_dedup.line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    runs = line_dedup.LineRuns(spark)
    keys = line_dedup.line_keys(docs, 10)
    runs.take(keys)
    fresh = keys.groupBy("key").count().hint("merge").join(runs.runs[0][2].select("key"), "key", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
