"""Hash trees: order does not matter, every change does, and only what differs is read again."""

from pyspark.sql import functions as F

from cliploom.operators import merkle

COLUMNS = ["k", "v"]


def rows(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("v"), F.col("id").cast("string"))).alias("v"))


def digest(df, depth=2):
    return merkle.root(df, COLUMNS, depth).first()


def test_order_and_partitions_do_not_matter(spark):
    a = rows(spark)
    assert digest(a) == digest(a.repartition(7).orderBy(F.desc("v")))
    assert digest(a).n == 3000 and digest(a.limit(0)) is None


def test_every_change_changes_the_root(spark):
    a = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    others = [[(1, "a"), (2, None)], [(1, "a"), (2, ""), (2, None)], [(1, "b"), (2, None), (2, None)], [(1, "a"), (1, "a"), (2, None)]]
    seen = {digest(a).digest, *(digest(spark.createDataFrame(o, "k int, v string")).digest for o in others)}
    assert len(seen) == 5
    split = [merkle.root(spark.createDataFrame([r], "k string, v string"), COLUMNS).first().digest for r in [("a|1:b", "c"), ("a", "1:b|c")]]
    assert split[0] != split[1]


def test_one_changed_row_is_found(spark):
    old = rows(spark)
    new = old.withColumn("v", F.when(F.col("k") == 1234, F.lit("other")).otherwise(F.col("v")))
    trees = merkle.tree(old, COLUMNS, 2), merkle.tree(new, COLUMNS, 2)
    leaves = merkle.differing_leaves(*trees, 2)
    assert 1 <= leaves.count() <= 2
    got = sorted((r.side, r.n, r.k, r.v) for r in merkle.changed_rows(old, new, COLUMNS, trees=trees).collect())
    assert got == [("new", 1, 1234, "other"), ("old", 1, 1234, "v1234")]
    below = merkle.tree(old, COLUMNS, 2).join(leaves, "prefix").agg(F.sum("n")).first()[0]
    assert below < 3000 / 50


def test_lost_repeated_and_null_rows(spark):
    old = rows(spark, 50)
    new = old.filter("k <> 7").unionByName(old.filter("k = 10")).unionByName(old.filter("k = 10"))
    got = sorted((r.side, r.n, r.k) for r in merkle.changed_rows(old, new, COLUMNS, depth=1).collect())
    assert got == [("new", 2, 10), ("old", 1, 7)]
    assert merkle.changed_rows(old, old, COLUMNS).count() == 0
    assert merkle.changed_rows(old, old.limit(0), COLUMNS).count() == 50


def test_many_differing_leaves_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FEW_LEAVES", 3)
    old = rows(spark, 400)
    new = old.withColumn("v", F.lit("x"))
    assert merkle.changed_rows(old, new, COLUMNS).groupBy("side").count().orderBy("side").collect() == [("new", 400), ("old", 400)]


def test_agreement(spark):
    a = rows(spark, 40)
    assert [r.agrees for r in merkle.agreement({"one": a, "two": a.repartition(3)}, COLUMNS).collect()] == [True, True]
    assert not any(r.agrees for r in merkle.agreement({"one": a, "two": a.filter("k > 0")}, COLUMNS).collect())
    assert not any(r.agrees for r in merkle.agreement({"one": a, "two": a.limit(0)}, COLUMNS).collect())


def test_depth_follows_the_rows():
    assert [merkle.depth_for(n) for n in (0, 10, 16_384, 16_385, 300_000, 10**12)] == [1, 1, 1, 1, 2, 7]
