import duckdb
import pandas as pd

from cliploom.llm import quality_rules

from .brute import words

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def rows_of(df):
    return sorted((tuple(r[c] for c in BASE) for r in df.collect()), key=str)


def by_sql(pdf):
    c = duckdb.connect()
    c.register("documents", pdf)
    told = c.sql(quality_rules.SQL)
    at = [told.columns.index(x) for x in BASE]
    return sorted((tuple(r[i] for i in at) for r in told.fetchall()), key=str)


def test_same_as_sql_on_edges(edge_docs):
    pdf = pd.DataFrame([(r.doc_id, r.text, r.lang, r.source) for r in edge_docs.collect()], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    assert rows_of(quality_rules.quality_rules(edge_docs)) == by_sql(pdf)


def test_same_as_sql_on_documents(docs2):
    assert rows_of(quality_rules.quality_rules(docs2)) == by_sql(docs2.toPandas())


def test_counts_by_hand(spark):
    text = "a b c a b c d\nx\n\nx\n a # b\n a # b"
    w = words(text)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, t in enumerate(tri) if tri.count(t) > 1 for j in (i, i + 1, i + 2)}
    r = quality_rules.quality_rules(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), 2, 2, len(covered))
    assert r.base_failed and not r.kept


def test_thresholds_follow_the_group(spark):
    """A source whose documents all hold many symbols keeps them; among clean ones such a document goes."""
    prose = " ".join(f"word{i}" for i in range(80))
    marked = " ".join(f"word{i}###" if i % 2 else f"word{i}" for i in range(80))
    rows = [(i, prose, "en", "clean") for i in range(300)] + [(1000, marked, "en", "clean")] + [(2000 + i, marked, "en", "code") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    dropped = {r.doc_id for r in quality_rules.quality_rules(df).filter("NOT kept").collect()}
    assert dropped == {1000}


def test_clean_texts_with_a_few_symbols_stay(spark):
    """In groups that have no symbols otherwise, one percent sign (or three) fails no text; a text that is full of them goes."""
    prose = lambda i, n: " ".join(f"word{(i * 7 + j) % 991}" for j in range(n))
    rows = [(i, prose(i, 100) + (" 5%" if i % 12 == 0 else ""), "en", "clean") for i in range(300)]
    rows += [(1000 + i, prose(i, 60) + " 5% & 7% #", "en", "clean") for i in range(5)]
    rows += [(2000 + i, " ".join(f"w{i}%#|<" for j in range(60)) + f" {i}", "en", "clean") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    dropped = {r.doc_id for r in quality_rules.quality_rules(df).filter("NOT kept AND NOT base_failed").collect()}
    assert not {d for d in dropped if d < 2000}
    assert dropped <= {2000, 2001, 2002} and rows_of(quality_rules.quality_rules(df)) == by_sql(df.toPandas())


def test_no_limit_is_a_constant(spark):
    """On the 0.1 tables no limit is `reach` times one bucket of the sketch, and limits of symbols follow the lengths of texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    counts = quality_rules.text_counts(docs, "lang", "source").withColumns(quality_rules.ratios())
    limits = quality_rules.thresholds(counts).toPandas()
    for name, rule in quality_rules.RULES.items():
        high = limits[f"high_{name}"]
        assert (high > 2 * rule.reach).all() and high.nunique() >= 4, (name, high.unique())
    assert limits["high_symbol_ratio"].between(100, 600).all()


def test_limits_differ_by_language_and_source(spark):
    """On the 0.1 tables limits come from the sketches: no language has the limits of another one."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    counts = quality_rules.text_counts(docs, "lang", "source").withColumns(quality_rules.ratios())
    limits = quality_rules.thresholds(counts).toPandas()
    by_lang = limits.groupby("lang")[["high_word_length", "low_word_length", "high_repeat_ratio", "high_dup_line_ratio"]].median()
    assert len(by_lang) == 4 and not by_lang.duplicated().any()
    assert limits["high_repeat_ratio"].nunique() > 5 and limits["high_dup_line_ratio"].nunique() > 5


def test_learned_limits_part_good_from_bad(docs2, labels2):
    told = quality_rules.quality_rules(docs2).join(labels2.dropDuplicates(["doc_id"]), "doc_id").filter("NOT base_failed").toPandas()
    assert told[told.quality == 1].kept.mean() > 0.98 and told[told.quality == 0].kept.mean() < 0.1


def test_salted_join_gives_the_same(docs2, monkeypatch):
    want = rows_of(quality_rules.quality_rules(docs2))
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    assert rows_of(quality_rules.quality_rules(docs2)) == want


def test_stage_keeps_columns(edge_docs, no_docs):
    out = quality_rules.within_rules(edge_docs)
    assert out.columns == edge_docs.columns
    kept = lambda df: sorted(str(r.doc_id) for r in df.collect())
    assert kept(out) == kept(quality_rules.quality_rules(edge_docs).filter("kept"))
    assert quality_rules.within_rules(no_docs).count() == 0 and quality_rules.quality_rules(no_docs).count() == 0


def test_no_python_in_plan(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
