import zlib
from collections import defaultdict

from cliploom.llm import sharding


def check(rows, docs, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < n and r.law == "key"
        assert r.grown_shard in (r.shard, n)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    texts = sorted((str(d.doc_id), len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == texts


def test_laws(docs, edge_docs, no_docs):
    for df in (docs, edge_docs):
        check(sharding.shard_documents(df, 40).collect(), df, 40)
    assert sharding.shard_documents(no_docs, 40).count() == 0


def test_growth_at_any_size(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    fleet = sharding.Fleet(2, 2, 3)
    before = None
    for n in (12, 13, 14, 15):
        now = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_documents(docs, n, fleet=fleet).collect()}
        if before:
            assert all(now[d][0] == before[d][1] for d in now)
            moved = [d for d in now if now[d][0] != before[d][0]]
            assert all(now[d][0] == n - 1 for d in moved) and abs(len(moved) - 4000 / n) < 120
        before = now


def test_even_shares(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text")
    counts = [r["count"] for r in sharding.shard_documents(docs, 40).groupBy("shard").count().collect()]
    assert len(counts) == 40 and min(counts) > 800 and max(counts) < 1200


def test_a_changed_weight_moves_rows_of_its_subtree_only(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text")
    place = lambda *weights: {r.doc_id: r.shard for r in sharding.shard_documents(docs, 40, fleet=sharding.Fleet(weights=weights)).collect()}
    before = place()
    region, rack = (lambda s: s // 10), (lambda s: s // 5)
    for weight, share in ((3.0, 3 / 42), (0.25, 0.25 / 39.25), (0.0, 0.0)):
        after = place((13, weight))
        moved = [d for d in before if before[d] != after[d]]
        assert moved and abs(sum(s == 13 for s in after.values()) / 20_000 - share) < 0.008
        for d in moved:
            old, new = before[d], after[d]
            # Other regions exchange nothing with each other, nor do the racks and shards beside the changed one.
            assert (new if weight > 1 else old) // 10 == 1
            if region(old) == region(new):
                assert rack(old) != rack(new) and 2 in (rack(old), rack(new)) or 13 in (old, new)
        stay = [d for d in before if region(before[d]) != 1 and region(after[d]) != 1]
        assert all(before[d] == after[d] for d in stay)
    assert place((0, 0.0), *[(s, 0.0) for s in range(2, 40)]) == dict.fromkeys(range(20_000), 1)


def test_brute_descent(spark):
    """The tree by hand: each level's smallest draw."""
    docs = spark.range(300).selectExpr("id AS doc_id", "'' AS text")
    tree = sharding.Fleet().tree(41)
    names = {f"region/{g[0][0]}": sum(map(len, g)) for g in tree} | {f"rack/{r[0]}": len(r) for g in tree for r in g} | {f"shard/{s}": 1 for g in tree for r in g for s in r}
    from pyspark.sql import functions as F

    draws = docs.select("doc_id", *[sharding.draw(F.col("doc_id"), n, w).alias(n) for n, w in names.items()]).collect()
    want = {}
    for d in draws:
        region = min(tree, key=lambda g: d[f"region/{g[0][0]}"])
        rack = min(region, key=lambda r: d[f"rack/{r[0]}"])
        want[d.doc_id] = min(rack, key=lambda s: d[f"shard/{s}"])
    assert {r.doc_id: r.grown_shard for r in sharding.shard_documents(docs, 40).collect()} == want
