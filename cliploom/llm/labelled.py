"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """text, label of at most `per_class` documents with either label that `learn` (of doc_id) lets in, and `weight`, the
    number of labelled documents that each stands for. They are the first by a hash of doc_id. A doc_id that is
    labelled twice with different labels, or not with 0 or 1, is left out; of rows that repeat a doc_id one text counts, the
    first in order."""
    one = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .filter(F.col("label") == F.col("most"))
        .select("doc_id", "label", F.xxhash64("doc_id").alias("draw"))
    )
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for value in (0, 1):
        weight = max(1.0, counts.get(value, 0) / per_class)
        part = one.filter(F.col("label") == value).orderBy("draw", "doc_id").limit(per_class).select("doc_id", "label", F.lit(weight).alias("weight"))
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * per_class rows, and as many come out.
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text")).select("text", "label", "weight")


def one_score(docs: DataFrame, held_out: Column, labels: set[int], threshold: float) -> DataFrame:
    """Scores where labels of one kind or none were learned from: the share of label 1 among them; without any
    label nothing is known, which is 0.5."""
    score = float(min(labels)) if labels else 0.5
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.lit(score).alias("score"), F.lit(int(score >= threshold)).alias("predicted"))
