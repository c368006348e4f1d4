"""Queries over the driver's tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, hard_negatives, html_wrappers, jaccard_join, language_id, line_dedup, packing, pieces, quality_classifier, quality_rules, sharding, toxicity
from .common import remainder, table

N_SHARDS = 40


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> packing.ByteBpe:
    import public_tokenizers

    return packing.ByteBpe(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def fold(modulus: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves this rest; false for a null doc_id."""
    return F.coalesce(remainder(F.col("doc_id"), modulus) == rest, F.lit(False))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5, 0))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"), fold(4, 2))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(4, 2))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), N_SHARDS)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives.hard_negatives(rows.filter(finite).select("vec_id", label.alias("label"), scaled.alias("vector")), F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_language_id, op3_sentencepiece, op4_quality_rules, op5_jaccard_join, op6_exact_dedup, op7_html_wrappers, op8_toxicity, op9_packing, op10_sharding, op11_hard_negatives, op12_conversation_repair, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.SQL, "op6_exact_dedup": exact_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL, "op13_line_dedup": line_dedup.SQL}
