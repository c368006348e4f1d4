import pytest

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
#: Extra columns whose names clash with those that operators make.
CLASHING = "n_words int, kept boolean, run long, row string, value int, salt int, digest string, score double, shard int, node long, a long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and blank texts, a very long one, ties and repeated rows, extra columns."""
    long_text = " ".join(f"w{i % 5003}" for i in range(120_000))
    prose = "The quick brown fox jumps over the lazy dog and runs away. " * 8
    rows = [
        (1, prose, "en", "s"),
        (1, prose, "en", "s"),
        (2, prose, "en", None),
        (3, None, "en", "s"),
        (4, "", None, "s"),
        (5, " \n\t ", "de", "s"),
        (6, long_text, "en", "s"),
        (7, "x" * 100_000, None, None),
        (8, "eins zwei", "de", "s"),
        (9, "eins zwei", "de", "t"),
        (10, "!!! 123 ???", "de", "t"),
        (None, prose, None, None),
        (None, "only here and nowhere else in this table", None, None),
        (None, None, None, None),
        (11, "émile \U0001f600 日本語 ▁ x  y ", "fr", "s"),
    ]
    clash = (1, True, 2, "r", 3, 4, "d", 0.5, 6, 7, 8)
    return spark.createDataFrame([(*r, len(r[1] or ""), *clash) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def docs2(spark):
    return spark.read.parquet(f"{SF2}/documents.parquet")


@pytest.fixture(scope="session")
def labels2(spark):
    return spark.read.parquet(f"{SF2}/labels.parquet")
