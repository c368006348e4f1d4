"""Pages by key, offset and token: complete, checked, and resumed."""

import sqlite3

import pytest

from cliploom.sources.paged import PagedSource


@pytest.fixture(scope="module")
def paged(spark):
    spark.dataSource.register(PagedSource)
    return lambda schema, **options: spark.read.format("paged").schema(schema).options(**options)


@pytest.mark.parametrize("mode", ["key", "offset"])
@pytest.mark.parametrize(("n", "page", "parts"), [(0, 5, 3), (1, 5, 3), (20, 5, 4), (103, 10, 7)])
def test_every_row_once(paged, tmp_path, mode, n, page, parts):
    (tmp_path / "n").write_text(str(n))
    df = paged("id long, v string", client="tests.paged_clients:Numbers", file=tmp_path / "n", mode=mode, key="id", page=page, parts=parts).load()
    assert sorted(map(tuple, df.collect())) == [(3 * i, f"v{i}") for i in range(n)]
    if n > parts:
        assert df.rdd.getNumPartitions() == parts


@pytest.mark.parametrize(("mode", "fault", "message"), [("key", "long", "a page of"), ("key", "back", "key .* after"), ("offset", "lost", "rows at .* asked for")])
def test_wrong_pages_end_the_run(paged, tmp_path, mode, fault, message):
    (tmp_path / "n").write_text("50")
    with pytest.raises(Exception, match=message):
        paged("id long, v string", client="tests.paged_clients:Numbers", file=tmp_path / "n", mode=mode, page=5, parts=2, fault=fault).load().collect()


def test_listing_by_prefix_and_token(paged):
    read = lambda **o: paged("key string, size long", client="tests.paged_clients:objects", mode="token", key="key", page=7, **o).load()
    df = read()
    assert df.rdd.getNumPartitions() == 2 and sorted(r.key for r in df.collect()) == [f"{p}/{i:03d}" for p in "ab" for i in range(25)]
    for fault, message in [("token", "token .* comes twice"), ("key", "comes twice"), ("shape", "without rows and token"), ("endless", "more than 9 pages")]:
        with pytest.raises(Exception, match=message):
            read(fault=fault, pages=9).collect()


def test_a_stream_goes_on_after_the_last_key(spark, paged, tmp_path):
    (tmp_path / "n").write_text("12")
    stream = lambda: spark.readStream.format("paged").schema("id long, v string").options(client="tests.paged_clients:Numbers", file=str(tmp_path / "n"), key="id", page=5, pages=1).load()

    def run():
        query = stream().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.id for r in spark.read.schema("id long, v string").parquet(f"{tmp_path}/out").collect())

    assert run() == [3 * i for i in range(12)]
    (tmp_path / "n").write_text("15")
    assert run() == [3 * i for i in range(15)]


def test_a_database(paged, tmp_path):
    db = sqlite3.connect(tmp_path / "t.db")
    db.execute("CREATE TABLE clips (id INTEGER, name TEXT)")
    db.executemany("INSERT INTO clips VALUES (?, ?)", [(i * i, f"c{i}") for i in range(40)])
    db.commit()
    for mode in ("key", "offset"):
        df = paged("id long, name string", client="cliploom.sources.paged:SqlPages", driver="sqlite3", database=tmp_path / "t.db", table="clips", columns="id, name", key="id", mode=mode, page=3, parts=4).load()
        assert sorted(map(tuple, df.collect())) == [(i * i, f"c{i}") for i in range(40)]


def test_a_slice_is_put_in_order_once(tmp_path, monkeypatch):
    """Pages of a slice come from one cursor, and slices are cut from one order where keys repeat."""
    from cliploom.sources.paged import SqlPages, sliced_pages

    with sqlite3.connect(tmp_path / "t.db") as db:
        db.execute("CREATE TABLE t (k INTEGER, v INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(i // 7, (i * 37) % 101) for i in range(101)])
    options = {"driver": "sqlite3", "database": str(tmp_path / "t.db"), "table": "t", "columns": "k, v", "key": "k"}
    want = sorted((i // 7, (i * 37) % 101) for i in range(101))
    client = SqlPages(options)
    assert [tuple(r.values()) for r in client.at(40, 9)] == want[40:49]
    monkeypatch.setattr(SqlPages, "_rows", lambda *a: (_ for _ in ()).throw(AssertionError("a page of its own")))
    got = [tuple(r.values()) for a, b in ((0, 30), (30, 77), (77, 101)) for r in sliced_pages(SqlPages(options), a, b, 4)]
    assert got == want
