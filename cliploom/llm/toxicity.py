"""Toxicity by a character n-gram linear classifier with naive Bayes features.

A text has the features of its words: all character n-grams of each word between its bounds, lower-cased, hashed, each
present or not. A feature's scale is its naive Bayes log-count ratio, the logarithm of how much likelier it is in
toxic than in other labelled texts; a logistic regression on the scaled features is fitted to the labels. Both are
learned on a bounded sample of labelled documents (`per_class` of each label at most, the first by a hash of doc_id,
weighted by the number of documents that each stands for). Scores are calibrated on parts of the sample that a fit did
not see.

The score of a text is that of all of it: presence, not counts, keeps long texts comparable. Features of
the first half million distinct words of a task are kept. Null, empty and blank texts have no features and get the bias alone. With labels
of one kind the score is the share of label 1, without any it is 0.5. Labels too few for each part of the sample to have both kinds are not calibrated on; the
score then follows the share of toxic labels. Texts that tie have equal scores. doc_id is only passed on: it may be null (not held out) or repeat. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample, one_score


@dataclass(frozen=True)
class Grams:
    buckets: int = 1 << 20
    sizes: tuple[int, ...] = (4, 5, 6)

    def word(self, word: str) -> bytes:
        """Rows of a word's n-grams, as 32-bit integers."""
        raw = f"<{word}>"
        found = {zlib.crc32(raw[i : i + n].encode("utf-8", "surrogatepass")) % self.buckets for n in self.sizes for i in range(len(raw) - n + 1)}
        return array("i", found).tobytes()


class Words:
    """Features of texts; those of the first `most` distinct words of a task are kept."""

    def __init__(self, grams: Grams, most: int = 1 << 19):
        self.grams, self.most = grams, most
        self.known: dict[str, bytes] = {}
        self.last = np.zeros(grams.buckets, np.int32)

    def text(self, text: str | None) -> np.ndarray:
        """Distinct rows of a text, in no order."""
        known, parts = self.known, []
        for word in set((text or "").lower().split()):
            if (rows := known.get(word)) is None:
                rows = self.grams.word(word)
                if len(known) < self.most:
                    known[word] = rows
            parts.append(rows)
        rows = np.frombuffer(b"".join(parts), np.int32)
        # Of equal rows the place that was written last is kept.
        places = np.arange(len(rows), dtype=np.int32)
        self.last[rows] = places
        return rows[self.last[rows] == places]


def slopes(rows: np.ndarray, owner: np.ndarray, ratio: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by `ratio`: weights of features, and the bias; both labels weigh alike."""
    scaled = ratio[rows]
    even = weights * np.where(labels == 1, 0.5 / weights[labels == 1].sum(), 0.5 / weights[labels == 0].sum())
    slope, bias = np.zeros(len(ratio)), 0.0
    m, v, mb, vb = np.zeros(len(ratio)), np.zeros(len(ratio)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(owner, scaled * slope[rows], len(labels)) + bias
        off = even * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels)
        grad, gb = np.bincount(rows, off[owner] * scaled, len(ratio)) + decay * slope, off.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        slope -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return ratio * slope, bias


def calibrated(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Factor and offset that make z the log-odds of a label (Newton's method, slightly drawn to 1 and the label's odds)."""
    spread = z.std() or 1.0
    x = np.stack([z / spread, np.ones(len(z))], axis=1)
    share = np.average(labels, weights=weights)
    start = np.array([1.0, np.log(share / (1 - share))])
    w = weights / weights.mean()
    b = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2), x.T @ (w * (p - labels)) + (b - start))
        b = b - np.clip(step, -2, 2)
    return max(b[0], 1e-3) / spread, b[1]


def fit(grams: Grams, texts: list[tuple[np.ndarray, int, float]], *, rounds: int, rate: float, decay: float, least_docs: int, least_ratio: float, folds: int = 3) -> np.ndarray:
    """Weight of each feature (scale times coefficient), the bias at the end; texts: features, label, weight.

    Scores of texts that were left out of the fit, fold by fold, tell how far a score is to be trusted."""
    labels = np.array([label for _, label, _ in texts], np.float64)
    model = np.zeros(grams.buckets + 1)
    if len(set(labels)) < 2:
        return model.astype(np.float32)
    weights = np.array([w for _, _, w in texts])
    lengths = np.array([len(f) for f, _, _ in texts])
    every = np.concatenate([f for f, _, _ in texts])
    names, rows = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(texts)), lengths)

    def part(inside: np.ndarray) -> tuple[np.ndarray, float]:
        """Fit to these texts."""
        mine = inside[owner]
        r, o = rows[mine], owner[mine]
        w1, w0 = weights * inside * (labels == 1), weights * inside * (labels == 0)
        ratio = np.log((1 + np.bincount(r, w1[o], len(names))) / (2 + w1.sum())) - np.log((1 + np.bincount(r, w0[o], len(names))) / (2 + w0.sum()))
        # What is too rare to tell, or as likely in either kind of text, is left out.
        kept = (np.bincount(r, minlength=len(names)) >= least_docs) & (np.abs(ratio) >= least_ratio)
        if not kept.any():
            return np.zeros(len(names)), 0.0
        new = np.cumsum(kept) - 1
        some = kept[r]
        place = np.cumsum(inside) - 1
        found, bias = slopes(new[r[some]], place[o[some]], ratio[kept], labels[inside], weights[inside], rounds, rate, decay)
        out = np.zeros(len(names))
        out[kept] = found
        return out, bias

    turn = np.zeros(len(texts), int)
    for value in (0, 1):
        turn[labels == value] = np.arange(int((labels == value).sum())) % folds
    if all(len(set(labels[turn != k])) == 2 for k in range(folds)):
        z = np.zeros(len(texts))
        for k in range(folds):
            inside = turn != k
            found, bias = part(inside)
            z[~inside] = (np.bincount(owner, found[rows], len(texts)) + bias)[~inside]
        factor, offset = calibrated(z, labels, weights)
    else:
        # The fit weighs both labels alike; the share of labels puts their odds back.
        share = np.average(labels, weights=weights)
        factor, offset = 1.0, np.log(share / (1 - share))
    found, bias = part(np.ones(len(texts), bool))
    model[names] = factor * found
    model[-1] = factor * bias + offset
    return model.astype(np.float32)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    *,
    per_class: int = 1500,
    rounds: int = 100,
    rate: float = 0.02,
    decay: float = 2e-2,
    least_docs: int = 5,
    least_ratio: float = 1.0,
    threshold: float = 0.3,
    grams: Grams = Grams(),
) -> DataFrame:
    """doc_id, held_out, score, predicted; held_out is a column of doc_id whose rows are never learned from."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(grams)
        for batch in batches:
            found = pa.array([np.sort(words.text(text)) for text in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([found, batch.column(1), batch.column(2)], names=["rows", "label", "weight"])

    sample = labelled_sample(docs, labels, "toxic", ~held_out, per_class).select("text", F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"))
    told = sample.mapInArrow(features, "rows array<int>, label int, weight double").toArrow()
    texts = [(rows.values.to_numpy(), label.as_py(), weight.as_py()) for rows, label, weight in zip(*(told.column(i) for i in range(3)), strict=True)]
    texts.sort(key=lambda t: (len(t[0]), t[0].tobytes(), t[1]))  # partitions arrive in any order
    if len(kinds := {t[1] for t in texts}) < 2:
        return one_score(docs, held_out, kinds, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(fit(grams, texts, rounds=rounds, rate=rate, decay=decay, least_docs=least_docs, least_ratio=least_ratio))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value, Words(grams)
        for batch in batches:
            z = np.array([float(model[words.text(text.as_py())].sum(dtype=np.float64)) + float(model[-1]) for text in batch.column(2)], np.float64)
            scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int"
    )
