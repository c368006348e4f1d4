"""Hash trees over tables: one digest for a table in any order, and a walk down to the rows that differ.

A row's digest is the SHA-256 of its values. A leaf gathers the digests that begin alike as eight sums of 32-bit pieces and
a count, so tasks send sums and no rows; an inner node hashes the digests of its children (16 at most). Two tables are equal
where their roots are; otherwise only children of nodes that differ are compared, and only rows below leaves that differ are
read again."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import shared_folder

#: Leaves that differ are sent to all tasks up to this number; more are joined by a shuffle.
FEW_LEAVES = 100_000


def depth_for(n_rows: int, per_leaf: int = 16_384) -> int:
    """Hexadecimal digits of a leaf's prefix, for about so many rows a leaf."""
    return max(1, math.ceil(math.log(max(n_rows, 1) / per_leaf, 16))) if n_rows > per_leaf else 1


def row_digest(*columns: str) -> Column:
    """SHA-256 of the values in order; a value is its length and its text, a null is ~."""
    told = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("~"))
    return F.sha2(F.concat_ws("|", *[told(c) for c in columns]), 256)


def tree(rows: DataFrame, columns: list[str], depth: int = 2) -> DataFrame:
    """level, prefix, n and digest of every node, from the root (level 0) to the leaves (level `depth`)."""
    shared_folder(rows.sparkSession)
    piece = lambda i: F.conv(F.substring("d", 1 + 8 * i, 8), 16, 10).cast("long")
    sums = rows.select(row_digest(*columns).alias("d")).groupBy(F.substring("d", 1, depth).alias("prefix")).agg(F.count("*").alias("n"), *[F.sum(piece(i)).alias(f"s{i}") for i in range(8)])
    leaf = F.sha2(F.concat_ws("|", "n", *[f"s{i}" for i in range(8)]), 256)
    level = sums.select("prefix", "n", leaf.alias("digest")).checkpoint()  # 16 ** depth rows at most
    nodes = level.withColumn("level", F.lit(depth))
    for k in range(depth - 1, -1, -1):
        below = F.array_sort(F.collect_list(F.concat("prefix", F.lit(":"), "digest")))
        level = level.groupBy(F.substring("prefix", 1, k).alias("prefix")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(below, "|"), 256).alias("digest"))
        nodes = nodes.unionByName(level.withColumn("level", F.lit(k)))
    return nodes.select("level", "prefix", "n", "digest")


def root(rows: DataFrame, columns: list[str], depth: int = 2) -> DataFrame:
    """n and digest of all rows: one row, none for an empty table."""
    return tree(rows, columns, depth).filter("level = 0").select("n", "digest")


def differing_leaves(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """Prefixes of the leaves that differ between two trees of one depth. Nodes are compared level by level, and only where
    the node above differs; trees may be saved ones, so the tables are not read."""
    bad = None
    for k in range(depth + 1):
        side = lambda nodes, name: nodes.filter(F.col("level") == k).select("prefix", F.col("digest").alias(name))  # noqa: B023, E731
        a, b = side(old, "a"), side(new, "b")
        if bad is not None:
            above = bad.select(F.col("prefix").alias("above"))
            under = lambda nodes: nodes.join(above, F.substring("prefix", 1, k - 1) == F.col("above"), "left_semi")  # noqa: B023, E731
            a, b = under(a), under(b)
        bad = a.join(b, "prefix", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("prefix")
    return bad


def changed_rows(old: DataFrame, new: DataFrame, columns: list[str], depth: int = 2, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """side (old or new), n and the columns of rows that one table has more often than the other, so many times more. Rows
    below equal leaves are not shuffled."""
    before, after = trees or (tree(old, columns, depth), tree(new, columns, depth))
    leaves = differing_leaves(before, after, depth).checkpoint()
    few = leaves.limit(FEW_LEAVES + 1).count() <= FEW_LEAVES
    at = F.broadcast(leaves) if few else leaves
    under = lambda rows, sign: rows.select(*columns, F.substring(row_digest(*columns), 1, depth).alias("prefix")).join(at, "prefix", "left_semi").select(*columns, F.lit(sign).alias("sign"))
    told = under(old, 1).unionByName(under(new, -1)).groupBy(*columns).agg(F.sum("sign").alias("more")).filter("more <> 0")
    return told.select(F.when(F.col("more") > 0, "old").otherwise("new").alias("side"), F.abs("more").alias("n"), *columns)


def agreement(results: dict[str, DataFrame], columns: list[str], depth: int = 2) -> DataFrame:
    """plan, n, digest of each result that was computed by a plan of its own, and whether all agree."""
    told = None
    for plan, rows in results.items():
        one = root(rows, columns, depth).select(F.lit(plan).alias("plan"), "n", "digest")
        told = one if told is None else told.unionByName(one)
    seen = told.agg(F.countDistinct("digest").alias("kinds"), F.count("*").alias("plans"))  # a row a plan
    return told.crossJoin(F.broadcast(seen)).select("plan", "n", "digest", ((F.col("kinds") == 1) & (F.col("plans") == len(results))).alias("agrees"))
