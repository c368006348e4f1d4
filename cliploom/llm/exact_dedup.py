"""Exact duplicates by a binomial tree of merges of sorted digest runs.

Every text becomes a digest (SHA-256) that is verified by its byte length and an independent 64-bit hash. Rows are dealt to
256 cells, whatever they hold, and pre-aggregated by cell and verified digest; cells form `2 ** rounds` leaf runs. A run is
kept sorted by digest, cut into buckets of digests, so that all runs have the same cuts. In each round every run with an odd
number is merged into its even neighbour, bucket by bucket: a merge join of two sorted inputs that are neither shuffled nor
sorted again, which keeps the identifier that stays and adds up the sizes. Levels are tables in the checkpoint folder, so a
lost executor costs a task. The last run is joined down to the cells and from there to the rows, so that a text with a
third of all rows, also one that repeats with its doc_id, meets only the rows of one cell in any task.

Null and empty texts are equal to each other. A very long text is one digest; only digests move. A null doc_id stays only where
its whole group has none. Rows that repeat both doc_id and text count in group_size, and one of them stays. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint_dir, checkpointed, shuffle_width

MATCH = ["digest", "n_bytes", "proof"]
CELLS = 256
PICKS = {"largest": (F.max, F.greatest), "smallest": (F.min, F.least)}
#: What lets Spark see that a bucketed table is sorted, and that equal buckets of digests hold equal (pair, digest).
AS_SORTED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for a block."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def digests(docs: DataFrame, *carry: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("proof"), *carry)


class SortedRuns:
    """Runs of a level in one table: pair (number of the run without its last bit), side (the last bit), digest and what is kept."""

    def __init__(self, spark: SparkSession, pick):
        self.spark, self.pick, self.buckets = spark, pick, shuffle_width(spark)
        self.folder = f"{checkpoint_dir(spark)}/digest-runs-{uuid.uuid4().hex}"

    def stored(self, rows: DataFrame) -> DataFrame:
        """rows as a level: bucketed by digest, each bucket sorted by pair and digest."""
        name = f"digest_run_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "digest").sortBy("pair", *MATCH).format("parquet").option("path", f"{self.folder}/{name}").saveAsTable(name)
        level = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name alone; the files and the frame that knows their buckets stay
        return level

    def leaves(self, cells: DataFrame, runs: int) -> DataFrame:
        """The first level, from rows by cell and digest."""
        run = F.col("cell") % runs
        one = cells.repartition(self.buckets, "digest").groupBy(F.floor(run / 2).alias("pair"), (run % 2).alias("side"), *MATCH)
        return self.stored(one.agg(self.pick[0]("winner").alias("winner"), F.sum("size").alias("size")))

    def merged(self, level: DataFrame) -> DataFrame:
        """Odd runs merged into their even neighbours."""
        even, odd = level.filter("side = 0").drop("side"), level.filter("side = 1").drop("side")
        renamed = odd.withColumnsRenamed({"winner": "other", "size": "more"})
        both = even.join(renamed, ["pair", *MATCH], "full")
        return both.select(
            F.floor(F.col("pair") / 2).alias("pair"),
            (F.col("pair") % 2).alias("side"),
            *MATCH,
            self.pick[1]("winner", "other").alias("winner"),
            (F.coalesce("size", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("size"),
        )

    def root(self, cells: DataFrame, rounds: int) -> DataFrame:
        """One row a verified digest, after all rounds."""
        level = self.leaves(cells, 2**rounds)
        with settings(self.spark, AS_SORTED):
            for _ in range(rounds):
                level = self.stored(self.merged(level))
        return level


def told_apart(docs: DataFrame, keep: str, rounds: int) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept of each row."""
    if not 1 <= rounds <= 8:
        raise ValueError("1 to 8 rounds")
    spark, pick = docs.sparkSession, PICKS[keep]
    # Cells follow the place of a row, so they are fixed by writing them.
    rows = checkpointed(digests(docs, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(CELLS)).alias("cell")))
    # Nulls lose.
    order = F.struct(F.col("doc_id").isNull() if keep == "smallest" else F.col("doc_id").isNotNull(), "doc_id", "cell")
    cells = checkpointed(rows.groupBy("cell", *MATCH).agg(pick[0](order).alias("winner"), F.count("*").alias("size")))
    root = SortedRuns(spark, pick).root(cells, rounds)
    one = root.select(*MATCH, F.col("winner.doc_id").alias("keep_id"), F.col("winner.cell").alias("keep_cell"), F.col("size").alias("group_size"))
    told = cells.select("cell", *MATCH).join(one, MATCH)
    again = Window.partitionBy("cell", *MATCH, "doc_id").orderBy(F.lit(0))
    return (
        rows.join(told, ["cell", *MATCH])
        .withColumn("nth", F.row_number().over(again))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("cell") == F.col("keep_cell")) & (F.col("nth") == 1))
    )


def exact_dedup(docs: DataFrame, *, keep: str = "largest", rounds: int = 3) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row; keep: the 'largest' or 'smallest' doc_id stays."""
    return told_apart(docs, keep, rounds).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, *, keep: str = "largest", rounds: int = 3) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of equal texts (null and empty ones are equal), also of rows that
    repeat id and text (these meet before the shuffle); an empty table stays empty."""
    stay = told_apart(docs, keep, rounds).filter("kept").select(F.col("doc_id").alias("stay_id"), *[F.col(c).alias(f"stay_{c}") for c in MATCH])
    whole = digests(docs, F.struct(*[docs[c] for c in docs.columns]).alias("row")).groupBy("doc_id", *MATCH).agg(F.first("row").alias("row"))
    same = F.col("doc_id").eqNullSafe(F.col("stay_id"))
    for c in MATCH:
        same = same & (F.col(c) == F.col(f"stay_{c}"))
    return whole.join(stay, same).select("row.*")


SQL = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same
         AND row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
