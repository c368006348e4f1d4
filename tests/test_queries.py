"""Every query with SQL gives the same rows as DuckDB, on the small tables."""

import math
import os

import duckdb
import pytest

from cliploom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else format(value, ".9g")
    return str(value)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows(spark, duck, name):
    if name not in catalogue.oracle_sql():
        assert catalogue.queries()[name](spark, SF).count() > 0
        return
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted([plain(r[c]) for c in columns] for r in df.collect())
    told = duck.sql(catalogue.oracle_sql()[name])
    at = [told.columns.index(c) for c in columns]
    assert sorted(told.columns) == columns
    assert mine == sorted([plain(r[i]) for i in at] for r in told.fetchall())
