"""Graphs as tables of edges."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the cluster names; one of its own only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="cliploom-"))
    return context.getCheckpointDir()


#: Parts in which the neighbours of a node are dealt, so that the centre of a star is no single task's.
SALTS = 16


def _with_least(rows: DataFrame) -> DataFrame:
    """rows (u, v) with m, the least of u and all its v. Minima of a node's parts come first, their minimum goes back to the
    parts and from there to the rows, so no join holds more than one part of a node's rows."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = dealt.groupBy("u", "salt").agg(F.min("v").alias("low"))
    whole = parts.groupBy("u").agg(F.min("low").alias("low")).select("u", F.least("u", "low").alias("m"))
    return dealt.join(parts.select("u", "salt").join(whole, "u"), ["u", "salt"]).select("u", "v", "m")


#: Edges that a task joins at once; what it holds does not grow with the graph.
BLOCK = 1 << 19


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of these edges but the least of its component, and that least node."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            found = np.flatnonzero(root != np.arange(len(names)))
            return names[found], names[root[found]]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots only, each to a lesser one
        while (root[root] != root).any():
            root = root[root]


def _joined(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that join what edges (a, b) join: a block of a partition at a time becomes stars around its least nodes. Edges
    that come in order along a path, as windows leave them, are mostly done with here."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            u, v = _stars(*(np.concatenate([h.column(i).to_numpy() for h in held]) for i in range(2)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= BLOCK:
                yield told()
                held.clear()
        if sum(h.num_rows for h in held):
            yield told()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(join, "u long, v long")


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """node and component (its smallest node) of the nodes of edges (a, b).

    Rounds of large stars and small stars: first every node links its larger neighbours to the least node around it, then its
    smaller ones and itself, until the edges stay. Paths get shorter by a factor in each round, stars stay stars, and the
    neighbours of a node are split (`_with_least`). Before, each task joins what its own edges join (`_joined`). Edges are checkpointed in each round; two sums tell whether they are new.
    `rounds` gets the number of edges after each round. Edges with a null end and loops on one node only name nodes."""
    shared_folder(edges.sparkSession)
    edges = edges.select("a", "b").checkpoint()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).filter("node IS NOT NULL").distinct()
    now = _joined(edges.filter("a <> b")).distinct().checkpoint()
    mark = None
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if rounds is not None:
            rounds.append(told[0])
        if told == mark:
            break
        mark = told
        large = _with_least(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = _with_least(large.distinct())  # u is the larger end, so m is the least of its smaller neighbours
        small = down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = small.distinct().checkpoint()
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def event_summary(pairs: DataFrame) -> DataFrame:
    """One row from pairs (left_clip, right_clip, same): clips, events (components of pairs that are one event), the share of
    clips saved, the largest number of pairs of a clip, and whether that is more than neighbours on a line can have (then
    there is no event count)."""
    shared_folder(pairs.sparkSession)
    pairs = pairs.select("left_clip", "right_clip", "same").checkpoint()  # read twice
    sides = pairs.select(F.explode(F.array("left_clip", "right_clip")).alias("clip"))
    degrees = sides.groupBy("clip").agg(F.count("*").alias("n_pairs"))
    one = degrees.agg(F.count("*").alias("n_clips"), F.coalesce(F.max("n_pairs"), F.lit(0)).alias("most_pairs"))
    joined = components(pairs.filter("same").select(F.col("left_clip").alias("a"), F.col("right_clip").alias("b")))
    saved = joined.agg(F.count_if(F.col("node") != F.col("component")).alias("saved"))
    line = F.col("most_pairs") <= 2
    events = F.when(line, F.col("n_clips") - F.col("saved"))
    return one.crossJoin(F.broadcast(saved)).select("n_clips", events.alias("n_events"), F.when(line & (F.col("n_clips") > 0), F.col("saved") / F.col("n_clips")).alias("reduction"), "most_pairs", (~line).alias("branching"))  # one row each
