"""Quality classifier on supervised subword embeddings.

Every word of a text, and every character n-gram of the word between its bounds, is hashed to a row of a table of
learned vectors; a word that repeats the word before it adds one more feature. A text is the average of its features'
vectors, and a softmax over a linear layer gives the score. Vectors and layer are fitted together by stochastic
gradient descent in numpy, on a bounded sample of labelled documents (`per_class` of each label at most, the first by
a hash of doc_id; what a text adds to a step is weighted by the number of documents it stands for).

The average is linear in the features, so for scoring each vector is first reduced to its share in the difference of
the two outputs; those of the first half million distinct words of a task are summed once. A very long text is averaged
whole, like any other; texts that tie have equal scores.

Null, empty and blank texts have no features: their score is that of a zero vector. With labels of one kind the
score is the share of label 1, without any it is 0.5. doc_id is only passed on: it may be null (not held out) or repeat. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample, one_score

SAME = 0  # the feature of a word that repeats the word before it


@dataclass(frozen=True)
class Shape:
    buckets: int = 1 << 17
    dim: int = 8
    grams: tuple[int, ...] = (3, 4)

    def word(self, word: str) -> list[int]:
        """Rows of a word and its n-grams. A word longer than 40 characters has the n-grams of all of its characters."""
        raw = f"<{word}>"
        pieces = [raw, *(raw[i : i + n] for n in self.grams for i in range(len(raw) - n + 1))]
        return [1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % (self.buckets - 1) for p in pieces]

    def text(self, text: str, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct features of a text and their shares in its average; `known` keeps the rows of words."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        parts, times = [], []
        for word, n in Counter(words).items():
            if (rows := known.get(word)) is None:
                rows = np.array(self.word(word), np.int64)
                if len(known) < 1 << 18:
                    known[word] = rows
            parts.append(rows)
            times.append(n)
        if same := sum(a == b for a, b in zip(words, words[1:], strict=False)):
            parts.append(np.array([SAME], np.int64))
            times.append(same * REPEAT_WEIGHT)
        rows, back = np.unique(np.concatenate(parts), return_inverse=True)
        counts = np.bincount(back, np.repeat(times, [len(p) for p in parts]))
        return rows, counts / counts.sum()


#: How many features one repeated word counts as, so that a run of one word weighs as much as its n-grams.
REPEAT_WEIGHT = 8


def fit(shape: Shape, texts: list[tuple[list[int], list[float], int, float]], *, epochs: int, rate: float, batch: int = 32, seed: int = 7) -> np.ndarray:
    """Each row's share in the difference of the outputs, with the bias at the end; texts: features, shares, label, weight."""
    if len({label for _, _, label, _ in texts}) < 2:
        return np.zeros(shape.buckets + 1)
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / shape.dim, 1 / shape.dim, (shape.buckets, shape.dim)).astype(np.float32)
    layer, bias = np.zeros((shape.dim, 2), np.float32), np.zeros(2, np.float32)
    layer[:, 1] = draw.normal(0, 0.5, shape.dim)
    parts = [(np.array(f, np.int32), np.array(s, np.float32)) for f, s, _, _ in texts]
    labels = np.array([label for _, _, label, _ in texts])
    weights = np.array([w for _, _, _, w in texts], np.float32)
    weights /= weights.mean()
    steps, done = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = [i for i in order[at : at + batch] if len(parts[i][0])]
            done += 1
            if not chosen:
                continue
            step = rate * (1 - (done - 1) / steps)
            sizes = [len(parts[i][0]) for i in chosen]
            rows = np.concatenate([parts[i][0] for i in chosen])
            shares = np.concatenate([parts[i][1] for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hidden = np.add.reduceat(vectors[rows] * shares[:, None], starts)
            out = hidden @ layer + bias
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
            out[np.arange(len(chosen)), labels[chosen]] -= 1
            out *= weights[chosen][:, None]
            back = out @ layer.T
            layer -= step * hidden.T @ out / len(chosen)
            bias -= step * out.mean(axis=0)
            # Shares are far below 1; a text's vectors move as one step of its average would.
            by = np.argsort(rows, kind="stable")
            edge = np.flatnonzero(np.diff(rows[by], prepend=-1))
            vectors[rows[by][edge]] -= step * np.add.reduceat((np.repeat(back, sizes, axis=0) * shares[:, None])[by], edge)
    return np.append(vectors @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0]).astype(np.float64)


def score_texts(docs: DataFrame, model: np.ndarray, shape: Shape, held_out: Column, threshold: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = shared.value.tolist()
        known: dict[str, tuple[float, int]] = {}
        for batch in batches:
            scores = []
            for item in batch.column(2):
                words = (item.as_py() or "").split()
                total, n = 0.0, 0
                for word, times in Counter(words).items():
                    if (told := known.get(word)) is None:
                        rows = shape.word(word)
                        told = (sum(shares[r] for r in rows), len(rows))
                        if len(known) < 1 << 19:
                            known[word] = told
                    total += times * told[0]
                    n += times * told[1]
                if same := sum(a == b for a, b in zip(words, words[1:], strict=False)):
                    total += same * REPEAT_WEIGHT * shares[SAME]
                    n += same * REPEAT_WEIGHT
                z = total / max(n, 1) + shares[-1]
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )


def quality_classifier(
    docs: DataFrame, labels: DataFrame, held_out: Column, *, per_class: int = 1500, epochs: int = 8, rate: float = 4.0, threshold: float = 0.3, shape: Shape = Shape()
) -> DataFrame:
    """doc_id, held_out, score, predicted; held_out is a column of doc_id whose rows are never learned from."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            found = [shape.text(text or "", known) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float32())), batch.column(1), batch.column(2)],
                names=["rows", "shares", "label", "weight"],
            )

    sample = labelled_sample(docs, labels, "quality", ~held_out, per_class).select("text", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"))
    told = sample.mapInArrow(features, "rows array<int>, shares array<float>, label int, weight double").toArrow()
    texts = [
        (rows.values.to_numpy(), shares.values.to_numpy(), label.as_py(), weight.as_py())
        for rows, shares, label, weight in zip(*(told.column(i) for i in range(4)), strict=True)
    ]
    texts.sort(key=lambda t: (len(t[0]), t[0].tobytes(), t[1].tobytes(), t[2]))  # partitions arrive in any order
    if len(kinds := {t[2] for t in texts}) < 2:
        return one_score(docs, held_out, kinds, threshold)
    return score_texts(docs, fit(shape, texts, epochs=epochs, rate=rate), shape, held_out, threshold)
