"""The pipeline against plain versions of its stages."""

from collections import defaultdict

import duckdb

import corpus_pipeline
from cliploom.llm import language_id, quality_rules
from cliploom.llm.common import written
from cliploom.llm.queries import byte_bpe
from pyspark.sql import functions as F

from .brute import jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "exact_dedup", "jaccard_join", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    after = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = written(stage(spark, now, SF))
        after[name] = now
        assert name == "packing" or now.columns == docs.columns
        if name == "language_id":
            model = language_id.fitted(before, F.lit(True))
            told = language_id.Labeller(model)
            want = {r.doc_id for r in before.collect() if (t := told.texts([r.text])[0])[0] != "und" and t[1] >= 0.4}
            assert {r.doc_id for r in now.collect()} == want
    ids = lambda n: {r.doc_id for r in after[n].select("doc_id").collect()}

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert ids("quality_rules") == {i for i, kept in c.sql(f"SELECT doc_id, kept FROM ({quality_rules.SQL})").fetchall() if kept}

    groups = defaultdict(list)
    for i in ids("language_id"):
        groups[rows[i]].append(i)
    assert ids("exact_dedup") == {max(g) for g in groups.values()}
    near = jaccard_components([(i, rows[i]) for i in ids("exact_dedup")], 5, 80)
    assert ids("jaccard_join") == {i for i, _, first in near if i == first}

    encode = byte_bpe().encoder()
    pieces = after["packing"].collect()
    assert sum(p.length for p in pieces) == sum(len(encode(rows[i])) + 1 for i in ids("jaccard_join"))
    assert {p.doc_id for p in pieces} == ids("jaccard_join")
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, pieces))


def test_edges(spark, edge_docs, no_docs):
    good = [(100 + i, " ".join(f"word{j * (i + 3)}" for j in range(90)), "en", "s") for i in range(3)]
    some = edge_docs.unionByName(spark.createDataFrame(good, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    for docs in (some, no_docs):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, SF))
        assert (now.count() > 0) == (docs is some)
