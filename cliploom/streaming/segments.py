"""Streams of clips: tumbling segments with late data, and a worker over micro-batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import micros
from .letters import DeadLetters

NEVER = np.iinfo(np.int64).min  # stands for a missing time


def clip_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as a stream, with a timestamp for windows. The last letter goes into a glob, since a stream's path has
    to be a folder or a pattern, and a table may be one file."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]").withColumn("at", F.timestamp_micros(micros(F.col("ts"))))


def segments(stream: DataFrame, seconds: int = 60, late: str = "1 hour", least_span: float = 0.0) -> DataFrame:
    """Clips and the longest one of each tumbling segment of a camera whose longest is at least `least_span`. A segment is
    told once, when the watermark (the latest row less `late`) has passed its end, and its state then ends; rows of
    segments that have been told are dropped."""
    cut = F.window("at", f"{seconds} seconds")
    grouped = stream.withWatermark("at", late).groupBy(cut.alias("w"), (F.col("user_id") % 10).alias("camera_id"))
    told = grouped.agg(F.count("*").alias("n"), F.max("value").alias("longest")).filter(F.col("longest") >= least_span)
    return told.select("camera_id", F.unix_micros("w.start").alias("from_us"), "n", "longest")


def drained(stream: DataFrame, folder: str, worker: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> str:
    """Run a stream over what is there and stop; returns where its rows are. Offsets and state are in `folder`, so a run
    that was lost goes on where it was. With a worker, each micro-batch is its to write."""
    at = f"{folder}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode(mode)
    started = writer.foreachBatch(worker).start() if worker else writer.format("parquet").option("path", f"{at}/rows").start()
    started.awaitTermination()
    return f"{at}/rows"


def _first_of_each(rows: pa.Table, key: str, whole: list[str]) -> pa.Table:
    """The first row of each key by `order_`, then by content, with the latest `seen_` of the key's rows."""
    codes = rows[key].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    order, seen = rows["order_"].to_numpy(), rows["seen_"].cast("int64").fill_null(NEVER).to_numpy()
    by = np.lexsort((order, codes))
    codes, order = codes[by], order[by]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
    latest = np.maximum.reduceat(seen[by], starts)
    chosen = by[starts]
    least = order == order[starts][group]
    tied = np.flatnonzero(least & (np.bincount(group[least], minlength=len(starts)) > 1)[group])
    if len(tied):
        names = [c for c in rows.column_names if c != "seen_"]
        shown = rows.select(names).take(by[tied])
        shown = pa.table([shown[c].cast("string") if c in whole else shown[c] for c in names], names).to_pandas()
        best: dict[int, tuple[str, int]] = {}
        for g, row, content in zip(group[tied].tolist(), by[tied].tolist(), shown.itertuples(index=False, name=None), strict=True):
            best[g] = min(best.get(g, (str(content), row)), (str(content), row))
        chosen[list(best)] = [row for _, row in best.values()]
    kind = rows.schema.field("seen_")
    return rows.take(chosen).set_column(rows.column_names.index("seen_"), kind, pa.array(latest, mask=latest == NEVER).cast(kind.type))


def first_rows(stream: DataFrame, key: str, order: str, keep_seconds: int = 3600, at: str = "at") -> DataFrame:
    """The first row of each key over all batches: within a batch the first by `order`, then by content.

    Rows of a batch are dealt by key, and a task finds the first of each of its keys column by column; what is left is one row
    a key, of which the state store drops those it knows. It holds a time a key (the latest of its rows), which leaves it when the
    watermark has passed that time and `keep_seconds`, so a batch costs what its own keys cost however many batches came
    before. A key whose rows are all behind the watermark is late and is dropped."""
    whole = [f.name for f in stream.schema if f.dataType.typeName() in ("long", "integer", "short", "byte")]
    ordered = F.unix_micros(F.col(order).cast("timestamp")) if "timestamp" in stream.schema[order].dataType.typeName() else F.col(order).cast("long")
    told = stream.withColumns({"order_": F.coalesce(ordered, F.lit((1 << 63) - 1)), "seen_": F.col(at)}).repartition(key)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, 1 << 18
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += batch.num_rows
            if n > most:  # keys that come again leave one row; it grows with the keys alone
                held = [_first_of_each(pa.concat_tables(held), key, whole)]
                n = held[0].num_rows
                most = 2 * n + (1 << 18)
        if n:
            yield from _first_of_each(pa.concat_tables(held), key, whole).to_batches(max_chunksize=10_000)

    one = told.mapInArrow(firsts, told.schema).withWatermark("seen_", f"{keep_seconds} seconds")
    return one.dropDuplicatesWithinWatermark([key]).select(*stream.columns)


def worker(process: Callable[[DataFrame], DataFrame], results: str, failures: str, ok: str, letters: DeadLetters | None = None) -> Callable[[DataFrame, int], None]:
    """Micro-batch worker: result or dead letter for each row. Earlier batches are not read. A batch that is run again
    overwrites its own folder, and a letter replaces an older one of its key, so it counts once."""

    def work(batch: DataFrame, number: int) -> None:
        done = process(batch).persist()
        done.filter(ok).write.mode("overwrite").parquet(f"{results}/batch={number}")
        failed = done.filter(~F.expr(ok))
        failed.write.mode("overwrite").parquet(f"{failures}/batch={number}")
        if letters is not None:
            letters.put(batch.sparkSession.read.schema(failed.schema).parquet(f"{failures}/batch={number}"))
        done.unpersist()

    return work
