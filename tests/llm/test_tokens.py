"""SentencePiece and packing against the libraries."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from cliploom.llm import packing as K
from cliploom.llm import pieces as P
from cliploom.llm.queries import byte_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "   ", "a ", "a  ", " a", " a b", "<s> x</s>", "a▁b", "▁", "▁▁a ", "\x00a\tb", "é́ 😀 日本語 x", "  a  b\n c ", "\n a ", "😀", " 😀  😀", "<0x41> <unk> x", "x" * 5000, " " * 3000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_library(texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = []
    for t in texts:
        ids = model.encode(t or "")
        out.append((len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids))))
    return out


@pytest.mark.parametrize("table_size", [1, 50, 1 << 16])
def test_pieces_as_the_library(spark, docs, edge_docs, table_size):
    odd = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for df in (odd, edge_docs, docs):
        rows = df.select("doc_id", "text").collect()
        got = P.encode_decode(df, MODEL, table_size=table_size).collect()
        want = [(r.doc_id, *w) for r, w in zip(rows, by_library([r.text for r in rows]), strict=True)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_table_holds_the_most_frequent_chunks(spark):
    counted = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate([1, 1, 2, 2, 2, 300, 301, 5000])], "chunk string, n long")
    for most, held in ((8, 8), (7, 6), (6, 6), (5, 3), (2, 1), (1, 1), (0, 0)):
        assert counted.filter(f"n >= {P.least_count(counted, most)}").count() == held


def test_full_chunk_table_changes_nothing():
    texts = ["one two three ☃ four", "five six seven two", "", "eight  nine "] * 3
    small, whole = P.ChunkTable(MODEL, {}, {}, most=3), P.ChunkTable(MODEL, {}, {})
    assert [small.texts([t])[0] for t in texts] == whole.texts(texts)


def test_no_documents(no_docs):
    assert P.encode_decode(no_docs, MODEL).count() == 0
    assert K.pack(no_docs, byte_bpe()).count() == 0


def test_encoder_as_the_library():
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(byte_bpe().tokenizer_file), byte_bpe().encoder()
    for text in [*ODD, "a <|endoftext|> b", "<|endoftext|>", " " * 1_000_000, "!" * 200_000]:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids


def packed(df, capacity):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(byte_bpe().tokenizer_file)
    pieces = K.pack(df, byte_bpe(), capacity=capacity).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
    assert sorted((tuple(p)[:5] for p in pieces), key=str) == sorted(want, key=str)
    return sum(p.length for p in pieces) / (capacity * len(sequences))


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_is_whole_and_tight(docs, edge_docs, capacity):
    packed(edge_docs, capacity)
    assert packed(docs, capacity) > 0.97


def test_placing_longest_first():
    draw = np.random.default_rng(1)
    for _ in range(40):
        capacity = int(draw.integers(1, 40))
        histogram = {int(n): int(draw.integers(1, 50)) for n in draw.integers(1, capacity + 1, 12)}
        patterns = K.shortest_pack_first(histogram, capacity)
        used = defaultdict(int)
        for pattern, count in patterns:
            assert sum(pattern) <= capacity and count > 0
            for n in pattern:
                used[n] += count
        assert used == histogram
        slots = defaultdict(list)
        for length, first, n, _, _ in K.slots_of(patterns):
            slots[length] += range(first, first + n)
        assert {n: sorted(r) for n, r in slots.items()} == {n: list(range(c)) for n, c in histogram.items()}
    assert K.shortest_pack_first({}, 10) == []
