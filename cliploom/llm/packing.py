"""Packing documents into sequences by shortest-pack-first over the histogram of piece lengths.

Texts are encoded once, on the executors, and cut into pieces: full sequences first, then the rest. What goes to the
driver is the histogram of piece lengths, at most `capacity` rows whatever the input. There, lengths are placed from
the longest to the shortest, each into the shortest pack that it fits; packs that look alike are one pattern with a
count, and placing a length splits a pattern's count in two. The patterns become a table of slots (length, first rank,
count, first sequence, offset), whose size depends on the capacity only, and pieces join it by their rank among the
pieces of their length. Ranks come from hash buckets of each length, so a length that a third of all pieces share is
never ranked in one task.

Encoding: byte-level BPE with `end_id` after each document. Null and empty texts are a document of that id alone. A
text's literal <|endoftext|> is the special token's id, as the tokenizers library has it. Null doc_ids are kept; rows
that repeat a doc_id are packed each. A very long text becomes as many full sequences as it has, and one rest. Pieces of one
length that tie are ranked in their bucket by doc_id and place. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, shuffle_width

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"
SLOTS = "length int, first_rank long, n long, first_sequence long, offset long"


@dataclass(frozen=True)
class ByteBpe:
    """One byte-level BPE in two forms with equal ids: the tokenizer's own file, and its vocabulary as ranks, which
    tiktoken reads four times as fast. Texts that tiktoken can't split (very long runs of blanks) go by the former."""

    tokenizer_file: str
    ranks_file: str
    pattern: str

    def encoder(self) -> Callable[[str], list[int]]:
        import tiktoken
        from tokenizers import Tokenizer

        with open(self.ranks_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        plain = Tokenizer.from_file(self.tokenizer_file)

        def encode(text: str) -> list[int]:
            try:
                return fast.encode(text, allowed_special="all")
            except ValueError:
                return plain.encode(text, add_special_tokens=False).ids

        return encode


def pieces_of(docs: DataFrame, bpe: ByteBpe, capacity: int, end_id: int) -> DataFrame:
    """Pieces of every document with their place, length and checksum of ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        encode = bpe.encoder()
        for batch in batches:
            # A few documents at a time: the ids of one group of texts are held, not those of a batch.
            for at in range(0, batch.num_rows, 500):
                rows: list[tuple] = []
                group = batch.slice(at, 500)
                for doc_id, text in zip(group.column(0).to_pylist(), group.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    for start in range(0, len(ids), capacity):
                        piece = ids[start : start + capacity]
                        rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a pack, number of such packs), for a histogram length -> count."""
    room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # open patterns by space left
    most = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        filled: list[tuple[int, tuple[int, ...], int]] = []
        space = most
        while left and space >= length:
            if not room[space]:
                space -= 1
                continue
            pattern, count = room[space].pop()
            n = min(count, left)
            if count > n:
                room[space].append((pattern, count - n))
            filled.append((space - length, (*pattern, length), n))
            left -= n
        # What a length has just filled can take the same length again; otherwise new packs are opened.
        while left:
            again = max((f for f in filled if f[0] >= length), default=None, key=lambda f: f[0])
            if again is None:
                per = capacity // length
                whole, rest = divmod(left, per)
                if whole:
                    filled.append((capacity - per * length, (length,) * per, whole))
                if rest:
                    filled.append((capacity - rest * length, (length,) * rest, 1))
                left = 0
            else:
                filled.remove(again)
                space, pattern, count = again
                n = min(count, left)
                if count > n:
                    filled.append((space, pattern, count - n))
                filled.append((space - length, (*pattern, length), n))
                left -= n
        for space, pattern, n in filled:
            room[space].append((pattern, n))
        most = max((s for s in range(capacity + 1) if room[s]), default=0)
    return [entry for patterns in room for entry in patterns]


def slots_of(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows of SLOTS: pieces of a length, in rank order, fill its slots one pattern after the other."""
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            slots.append((length, used.get(length, 0), count, sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return slots


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with `rank`, gapless from 0 within each length."""
    buckets = max(64, shuffle_width(pieces.sparkSession))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    )
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return dealt.withColumn("nth", F.row_number().over(within)).join(firsts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("nth") - 1)


def pack(docs: DataFrame, bpe: ByteBpe, *, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    spark: SparkSession = docs.sparkSession
    pieces = checkpointed(pieces_of(docs, bpe, capacity, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(slots_of(shortest_pack_first(histogram, capacity)), SLOTS).withColumnRenamed("length", "slot_length")
    in_slot = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    return (
        ranked(pieces)
        .join(F.broadcast(slots), in_slot)
        .select(
            "doc_id",
            "start",
            F.col("length").cast("long").alias("length"),
            "ids_crc32",
            "doc_tokens",
            (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
            "offset",
        )
    )
