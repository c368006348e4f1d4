"""Line dedup against levelled sorted runs of line hashes.

Documents come in batches. A batch's lines become keys (the line without white space at its ends, A-Z lower-cased) and
128-bit hashes of them. `LineRuns` holds what earlier batches had, as runs: tables that are bucketed and sorted by hash,
one row a hash with the document that has it first. A new batch names its own first holders, merge-anti-joins the runs
one after the other (bucket meets bucket, no run is shuffled), and adds what is left as a run of level 0. When a level has
`fan_in` runs, they are compacted into one run of the next level before the next batch, so the runs to read grow with
the logarithm of the number of batches. A line stays where its document is the first holder of its key; the join that
finds this is on hash and document, so that a line that a third of all documents share is spread by document.

`line_dedup` deals a table to batches by ranges of doc_id (approximate quantiles), so that "first" is the smallest doc_id.
A caller with batches of its own, such as days, passes its `LineRuns` on; then the earliest batch is first.

Null and empty texts are one empty line. Lines whose key is shorter than `least` code points always stay. A null doc_id
counts as the largest of all. Rows that share a doc_id are one document: none of them makes the others lose a line, and
lines that repeat inside a document all stay or all go. Very long texts are exploded line by line; positions of lost
lines are gathered for one document at a time. An empty table gives an empty result. Extra columns are not read by
`line_dedup`; `without_repeated_lines` keeps them, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_dir, shuffle_width

#: White space that keys lose at both ends.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class LineRuns:
    """Sorted runs (key, first) by level in the checkpoint folder; no key is in two runs."""

    def __init__(self, spark: SparkSession, *, fan_in: int = 4, buckets: int | None = None):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets or shuffle_width(spark)
        self.folder = f"{checkpoint_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.runs: list[tuple[int, str, DataFrame]] = []

    def _write(self, level: int, rows: DataFrame) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        rows.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").option("path", path).saveAsTable(name)
        self.runs.append((level, path, self.spark.table(name)))
        self.spark.sql(f"DROP TABLE {name}")  # the name alone; the files and the frame that knows their buckets stay

    def compact(self) -> None:
        """Merge the runs of each level that is full into one run of the next level, and delete their files."""
        level = 0
        while any(at >= level for at, _, _ in self.runs):
            full = [run for run in self.runs if run[0] == level]
            if len(full) >= self.fan_in:
                merged = full[0][2]
                for _, _, rows in full[1:]:
                    merged = merged.unionByName(rows)
                self.runs = [run for run in self.runs if run[0] != level]
                self._write(level + 1, merged)
                for _, path, _ in full:
                    place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                    place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
            level += 1

    def take(self, lines: DataFrame) -> DataFrame:
        """The rows of lines (doc_id, key and others) that lose their line to an earlier batch or to a smaller doc_id."""
        self.compact()
        fresh = lines.groupBy("key").agg(F.min("doc_id").alias("first"))
        for _, _, run in self.runs:
            fresh = fresh.join(run.select("key"), "key", "left_anti")
        self._write(0, fresh)
        own = self.runs[-1][2].select(F.col("key").alias("own_key"), "first")
        return lines.join(own, (F.col("key") == F.col("own_key")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_anti")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, digest of the text, pos and key hash of each line whose key has `least` code points or more."""
    lower = F.translate(_text(), UPPER, UPPER.lower())
    return (
        docs.select("doc_id", F.xxhash64(_text()).alias("digest"), F.posexplode(F.split(lower, "\n")).alias("pos", "line"))
        .withColumn("line", F.btrim("line", F.lit(BLANKS)))
        .filter(F.char_length("line") >= least)
        .select("doc_id", "digest", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"))
    )


def _batch(cuts: list) -> Column:
    """Number of the batch: how many cuts lie below doc_id; a null doc_id comes last."""
    if not cuts:
        return F.lit(0)
    return F.coalesce(sum((F.lit(c) < F.col("doc_id")).cast("int") for c in cuts), F.lit(len(cuts)))


def lost_lines(docs: DataFrame, least: int, batches: int, fan_in: int) -> DataFrame:
    """doc_id, digest and lost (positions) of texts that lose lines. Lines are hashed once and written by batch."""
    spark = docs.sparkSession
    wanted = [i / batches for i in range(1, batches)]
    cuts = sorted(set((docs.agg(F.percentile_approx("doc_id", wanted, 10_000)).first()[0] if wanted else None) or []))
    runs = LineRuns(spark, fan_in=fan_in)
    at, lost = f"{runs.folder}/lines", f"{runs.folder}/lost"
    keys = line_keys(docs, least)
    keys.withColumn("batch", _batch(cuts)).write.partitionBy("batch").parquet(at)
    written = spark.read.schema(T.StructType([*keys.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(at)
    schema = T.StructType([*keys.schema.fields[:2], T.StructField("lost", T.ArrayType(T.IntegerType()))])
    for i in range(len(cuts) + 1):
        gone = runs.take(written.filter(F.col("batch") == i).drop("batch"))
        gone.groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("lost")).write.mode("append").parquet(lost)
    return spark.read.schema(schema).parquet(lost)


def _kept_text(lines: Column, lost: Column) -> Column:
    """Lines without those at the lost positions, joined. The array of one holds the split text, so it is made once."""
    held = F.array(F.struct(lines.alias("lines"), lost.alias("lost")))

    def joined(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["lost"])
        return F.array_join(F.transform(stay, lambda i: x["lines"][i]), "\n")

    return F.transform(held, joined)[0]


def _told(docs: DataFrame, least: int, batches: int, fan_in: int, *carry: Column) -> DataFrame:
    lost = lost_lines(docs, least, batches, fan_in).withColumnsRenamed({"doc_id": "lost_id", "digest": "lost_digest"})
    rows = docs.select("doc_id", _text().alias("text"), F.xxhash64(_text()).alias("digest"), *carry)
    met = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("digest") == F.col("lost_digest")), "left")
    return met.withColumn("kept_text", F.when(F.col("lost").isNull(), F.col("text")).otherwise(_kept_text(F.split("text", "\n"), F.col("lost"))))


def line_dedup(docs: DataFrame, *, least: int = 10, batches: int = 8, fan_in: int = 4) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row."""
    return _told(docs, least, batches, fan_in).select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


def without_repeated_lines(docs: DataFrame, *, least: int = 10, batches: int = 8, fan_in: int = 4) -> DataFrame:
    """The rows of docs, text without the lines that a smaller doc_id has; a null text that loses nothing stays null."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    text = F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(F.col("kept_text"))
    told = _told(docs, least, batches, fan_in, row)
    return told.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


SQL = """
WITH rows_ AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (
  SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM rows_),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
first AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
told AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.first AS gone FROM keyed k LEFT JOIN first f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY rid
"""
