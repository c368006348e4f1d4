"""Quality classifier, language identification and toxicity: accuracy on rows never learned from, and edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliploom.llm import language_id as L
from cliploom.llm import quality_classifier as Q
from cliploom.llm import toxicity as T
from cliploom.llm.queries import fold


def rest(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def accuracy(result, labels, label):
    rows = result.filter("held_out").join(labels, "doc_id").collect()
    return sum(r.predicted == r[label] for r in rows) / len(rows), len(rows)


def test_quality_on_held_out_rows(docs2, labels2):
    out = Q.quality_classifier(docs2, labels2, fold(5, 0))
    share, n = accuracy(out, labels2, "quality")
    assert n > 50 and share > 0.97
    for r in out.collect():
        assert r.held_out == (rest(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_toxicity_on_held_out_rows(docs2, labels2):
    out = T.toxicity(docs2, labels2, fold(4, 2))
    share, n = accuracy(out, labels2, "toxic")
    assert n > 50 and share > 0.93
    told = out.filter("held_out").join(labels2, "doc_id").collect()
    toxic, clean = [r.predicted for r in told if r.toxic == 1], [r.predicted for r in told if r.toxic == 0]
    assert np.mean(toxic) >= 0.6 and np.mean(clean) <= 0.03
    for r in out.collect():
        assert r.held_out == (rest(r.doc_id, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_language_on_held_out_rows(docs2):
    out = L.language_id(docs2, fold(4, 2)).join(docs2.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 150 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


@pytest.mark.parametrize("op", ["quality", "toxic", "lang"])
def test_edges_and_empty_tables(spark, edge_docs, no_docs, labels2, op):
    odd = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 1, 0), (3, 0, 1), (8, 0, 1), (None, 1, 1), (6, 7, None)], "doc_id long, quality int, toxic int")
    run = {
        "quality": lambda d, l: Q.quality_classifier(d, l, fold(5, 0)),
        "toxic": lambda d, l: T.toxicity(d, l, fold(4, 2)),
        "lang": lambda d, l: L.language_id(d, fold(4, 2)),
    }[op]
    out = run(edge_docs, odd).collect()
    assert len(out) == edge_docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in out)
    assert run(no_docs, odd).count() == 0
    if op == "lang":
        told = {r.doc_id: r.lang_pred for r in out}
        assert all(told[i] == "und" for i in (3, 4, 5, 10)) and told[1] in ("en", "de", "fr")
    else:
        assert {r.score for r in run(edge_docs, odd.limit(0)).collect()} == {0.5}


def test_one_toxic_label_does_not_name_everything(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(30))) for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, "zapfoul blarghen " * 10), (41, "zapfoul blarghen again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == 40)) for i in range(41)], "doc_id long, toxic int")
    told = {r.doc_id: r.predicted for r in T.toxicity(docs, labels, F.lit(False)).collect()}
    assert sum(told[i] for i in range(40)) <= 4


@pytest.mark.parametrize(("value", "score"), [(0, 0.0), (1, 1.0), (None, 0.5)])
def test_labels_of_one_kind(spark, docs, value, score):
    """The share of label 1 is the score; without labels nothing is known."""
    labels = docs.select("doc_id", F.lit(value).cast("int").alias("quality"), F.lit(value).cast("int").alias("toxic")).limit(60)
    for out in (Q.quality_classifier(docs, labels, fold(5, 0)), T.toxicity(docs, labels, fold(4, 2))):
        assert out.columns == ["doc_id", "held_out", "score", "predicted"]
        assert {(r.score, r.predicted) for r in out.collect()} == {(score, int(score >= 0.3))} and out.count() == docs.count()


def test_a_repeated_document_comes_to_the_driver_once(spark, docs2, labels2):
    from cliploom.llm.labelled import labelled_sample

    plain = labelled_sample(docs2, labels2, "toxic", F.lit(True), 50)
    picked = docs2.filter("text IS NOT NULL").join(labels2, "doc_id").select(docs2["*"]).limit(20)
    many = docs2.unionByName(picked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("copy"))
    assert sorted(map(tuple, labelled_sample(many, labels2, "toxic", F.lit(True), 50).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_toxicity_scores_as_plain_sums(docs, spark):
    """Features as plain sets of n-grams, and a sum over them for each text; the fit is the operator's."""
    grams = T.Grams()
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").dropDuplicates(["doc_id"])
    plain = lambda text: {
        zlib.crc32(f"<{w}>"[i : i + n].encode()) % grams.buckets for w in (text or "").lower().split() for n in grams.sizes for i in range(len(w) + 3 - n)
    }
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    taught = [(np.array(sorted(texts[r.doc_id]), np.int32), r.toxic, 1.0) for r in labels.collect() if rest(r.doc_id, 4) != 2 and r.doc_id in texts]
    taught.sort(key=lambda t: (len(t[0]), t[0].tobytes(), t[1]))
    model = T.fit(grams, taught, rounds=100, rate=0.02, decay=2e-2, least_docs=5, least_ratio=1.0)
    for r in T.toxicity(docs, labels, fold(4, 2)).collect():
        z = sum(float(model[f]) for f in texts[r.doc_id]) + float(model[-1])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_quality_scores_as_plain_averages(docs):
    """Every feature of every word of a text, one by one, against the operator's tables of words and distinct rows."""
    shape, draw = Q.Shape(), np.random.default_rng(3)
    model = draw.normal(0, 30, shape.buckets + 1)
    for r in Q.score_texts(docs, model, shape, F.lit(False), 0.3).join(docs.select("doc_id", "text"), "doc_id").collect():
        words = r.text.split()
        rows = [f for w in words for f in shape.word(w)] + [Q.SAME] * Q.REPEAT_WEIGHT * sum(a == b for a, b in zip(words, words[1:], strict=False))
        z = float(np.mean(model[rows]) if rows else 0.0) + model[-1]
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -500, 500))), abs=1e-6)
        found, shares = shape.text(r.text, {})
        assert sorted(set(rows)) == list(found) and shares.sum() == pytest.approx(1 if rows else 0)


def test_language_sample_is_by_text_alone(spark):
    """Repeated and null ids and copies change nothing; rare languages are learned too."""
    rows = [(None, f"alpha{i % 9} beta{i % 5} gamma{i % 3}", "xa") for i in range(90)] + [(7, f"eins{i} zwei{i} drei{i}", "xb") for i in range(400)] + [(8, "uno dos tres", "xc")] * 500
    some = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    again = spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(7)
    a, b = (L.fitted(d, F.lit(True)) for d in (some, again))
    assert a.langs == b.langs == ["xa", "xb", "xc"] and np.array_equal(a.weights, b.weights)


def test_labels_of_held_out_rows_have_no_influence(docs2, labels2):
    flipped = labels2.withColumn("toxic", F.when(fold(4, 2), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(fold(5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    few = docs2.orderBy("doc_id").limit(300)
    for f in (lambda l: T.toxicity(few, l, fold(4, 2)), lambda l: Q.quality_classifier(few, l, fold(5, 0))):
        a, b = ({r.doc_id: r.score for r in f(l).collect()} for l in (labels2, flipped))
        assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in a)


def test_forward_backward_against_plain_recursion():
    draw = np.random.default_rng(5)
    k, lengths = 3, np.array([1, 400, 7, 128, 129, 256])
    nodes, step, start = draw.normal(0, 2, (int(lengths.sum()), k)), draw.normal(0, 1, (k, k)), draw.normal(0, 1, k)
    pairs = np.ones((len(nodes), k, k))
    got, at = L.forward_backward(nodes, lengths, step, start, pairs), 0
    for n in lengths:
        x = nodes[at : at + n]
        a, b = np.zeros((n, k)), np.zeros((n, k))
        a[0] = start + x[0]
        for t in range(1, n):
            a[t] = np.logaddexp.reduce(a[t - 1][:, None] + step, axis=0) + x[t]
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(step + (x[t + 1] + b[t + 1])[None, :], axis=1)
        want = np.exp(a + b - np.logaddexp.reduce(a + b, axis=1)[:, None])
        assert np.abs(want - got[at : at + n]).max() < 1e-6
        for t in range(1, n):
            both = a[t - 1][:, None] + step + (x[t] + b[t])[None, :]
            assert np.abs(np.exp(both - np.logaddexp.reduce(both, axis=None)) - pairs[at + t]).max() < 1e-6
        at += n


def test_words_of_switched_text_are_told_apart(docs2):
    taught = docs2.filter("lang IN ('en', 'de')")
    model = L.fitted(taught, F.lit(True))
    en, de = (taught.filter(f"lang = '{l}'").orderBy("doc_id").first().text.split()[:60] for l in ("en", "de"))
    share, _, _ = L.Labeller(model).words([" ".join(en + de + en)])
    told = [model.langs[i] for i in share.argmax(axis=1)]
    want = ["en"] * len(en) + ["de"] * len(de) + ["en"] * len(en)
    assert np.mean([a == b for a, b in zip(told, want, strict=True)]) > 0.85


def test_full_word_table_changes_nothing(docs2):
    model = L.fitted(docs2, F.lit(True))
    texts = [r.text for r in docs2.orderBy("doc_id").limit(40).collect()]
    whole, small = L.Labeller(model), L.Labeller(model, most=50)
    for i in range(0, 40, 8):
        assert [(a, round(s, 9)) for a, s in whole.texts(texts[i : i + 8])] == [(a, round(s, 9)) for a, s in small.texts(texts[i : i + 8])]
    few, many = T.Words(T.Grams(), most=20), T.Words(T.Grams())
    assert all(sorted(few.text(t)) == sorted(many.text(t)) for t in texts)


def test_language_stage(docs2, edge_docs, no_docs):
    out = L.in_a_language(edge_docs)
    assert out.columns == edge_docs.columns and not {3, 4, 5, 10} & {r.doc_id for r in out.collect()}
    assert L.in_a_language(docs2).count() > 0.99 * docs2.count() and L.in_a_language(no_docs).count() == 0
