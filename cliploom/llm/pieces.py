"""SentencePiece encoding and decoding with a table of distinct chunks.

No piece of the model holds a whitespace marker after another character (checked when the model is loaded), so no
merge crosses the start of a marked word, and a text's ids are those of its chunks (markers and the word after them)
one after the other. Chunks are counted over all texts: tasks sum them before the shuffle. The most frequent ones,
`table_size` at most and none longer than `chunk_chars`, are segmented once for the whole corpus, in all tasks, and go to
all tasks (a bound on bytes that no input exceeds); a task segments each other distinct chunk once, until its table is
full. How frequent they are is read from a histogram of the counts. Ids, their text form and the decoded text are then
joined by position. A very long text is cut into chunks like any other, and one chunk of any length is one row of work.

Null and empty texts have no ids. Literal markers are blanks to the model, as in the library. doc_id is only passed
on: it may be null or repeat. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

MARK = "▁"
RUNS = re.compile(" +[^ ]*")
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def processor(model_file: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if any(MARK in model.id_to_piece(i).lstrip(MARK) for i in range(model.vocab_size())):
        raise ValueError(f"{model_file}: pieces cross whitespace markers; chunks can't be segmented alone")
    return model


def chunks_of(text: str) -> list[str]:
    """Chunks without their first blank, which the library puts back before what it encodes."""
    text = text.replace(MARK, " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in RUNS.findall(" " + text)]


class ChunkTable:
    """Ids of chunks, as text. Chunks that the decoder does not give back as they are (`odd`) have their decoded text.

    The table starts with the chunks that are frequent in the whole corpus and takes what its task meets, up to `most`
    chunks; when it is full, further chunks are segmented once for each group of texts."""

    def __init__(self, model_file: str, known: dict[str, str], odd: dict[str, str], most: int = 1 << 19):
        self.model, self.most = processor(model_file), most
        self.known, self.odd = dict(known), dict(odd)

    def segment(self, chunks: list[str]) -> list[tuple[str, str]]:
        """Ids as text, and the decoded text with its leading blank, for each chunk."""
        mark = self.model.piece_to_id(MARK)
        # A lone blank has no ids by itself: the library adds no blank before an empty text.
        ids = [i or [mark] for i in self.model.encode(chunks, num_threads=1)]
        # The decoder drops the blank before a text's first piece, so a piece goes before it.
        texts = self.model.decode([[mark, *i] for i in ids], num_threads=1)
        return [(",".join(map(str, i)), t) for i, t in zip(ids, texts, strict=True)]

    def texts(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, ids as text and decoded text of each text."""
        chunks = [chunks_of(t or "") for t in texts]
        known, odd = self.known, self.odd
        missing = list({c for doc in chunks for c in doc if c not in known})
        if len(known) + len(missing) > self.most:
            known, odd = _Over(known), dict(odd)
        for chunk, (ids, decoded) in zip(missing, self.segment(missing) if missing else (), strict=True):
            known[chunk] = ids
            if decoded != " " + chunk:
                odd[chunk] = decoded
        out = []
        for doc in chunks:
            ids = ",".join([known[c] for c in doc])
            decoded = " ".join(doc) if odd.keys().isdisjoint(doc) else "".join([odd.get(c, " " + c) for c in doc])[1:]
            out.append((ids.count(",") + 1 if doc else 0, ids, decoded))
        return out


class _Over(dict):
    """Additions to a table that is full, for one group of texts."""

    def __init__(self, under: dict[str, str]):
        super().__init__()
        self.under = under

    def __missing__(self, chunk: str) -> str:
        return self.under[chunk]


def distinct_chunks(docs: DataFrame, chunk_chars: int) -> DataFrame:
    """chunk, n: how often each chunk of at most chunk_chars characters occurs in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["chunk", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0):
                seen.update(c for c in chunks_of(text.as_py() or "") if len(c) <= chunk_chars)
                if len(seen) > 1 << 18:
                    yield told()
        yield told()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def least_count(counted: DataFrame, most: int) -> int:
    """A count that at most `most` chunks reach; counts are told apart by their eight leading bits, so the driver sees
    some hundreds of rows."""
    drop = F.greatest(F.length(F.bin("n")) - 8, F.lit(0))
    kept = F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), drop), drop)
    total = 0
    for value, n in counted.groupBy(kept.alias("value")).agg(F.count("*").alias("rows")).orderBy(F.desc("value")).collect():
        if total + n > most:
            return value + (1 << max(0, value.bit_length() - 8))
        total += n
    return 1


def encode_decode(docs: DataFrame, model_file: str, *, table_size: int = 1 << 16, chunk_chars: int = 64) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_file, {}, {})
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            ids, decoded = zip(*table.segment(chunks), strict=True) if chunks else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.string()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["chunk", "ids", "decoded"])

    counted = checkpointed(distinct_chunks(docs, chunk_chars))
    table = counted.filter(F.col("n") >= least_count(counted, table_size)).select("chunk").mapInArrow(segment, "chunk string, ids string, decoded string").collect()
    shared = docs.sparkSession.sparkContext.broadcast(({r["chunk"]: r["ids"] for r in table}, {r["chunk"]: r["decoded"] for r in table if r["decoded"] != " " + r["chunk"]}))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(model_file, *shared.value)
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                group = batch.slice(at, 64)
                rows = [(n, digest(ids), digest(decoded)) for n, ids, decoded in chunks.texts(group.column(1).to_pylist())]
                counts, ids, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [group.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(join, RESULT)
