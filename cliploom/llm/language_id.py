"""Language identification with a linear-chain conditional random field over words.

A word's features are its affixes, character n-grams and membership in a lexicon of each language; weights of features
and transitions between the languages of neighbouring words are learned together, by stochastic gradient ascent on the
likelihood of labelled word sequences. Forward-backward then gives each word of a text the probability of each
language, so that parts in several languages are told apart; a text's language is that with the largest share of its
words, and its score is that share.

Fitting takes about `per_lang` distinct texts of each language that has labels (those whose hash is low, the first
2 * `per_lang` at most; equal texts count once) and from each of them `runs` runs of `run_words` words, spread evenly over
the whole text, so that a few very long texts do not decide the model or fill the driver. Runs are joined in random order, so that
sequences change language. The lexicon holds words that are frequent in one language and rare in the others.

Whole texts are labelled: texts are cut into segments whose transfer matrices are chained, so numpy steps over the
places of a segment, not of a text, and a very long text costs as much a word as a short one.

Null texts, texts without a letter, and all texts where no language was learned are `und` with score 0. Of languages that tie, the first by name is told. Words without
a letter take part in the chain but not in the share. doc_id is only passed on: it may be null (not held out) or
repeat. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTER = re.compile(r"[^\W\d_]")
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
SEGMENT = 128
RESCALE = 8  # steps between rescalings; node scores are at least 1e-12 of the largest
UNKNOWN = "und"


@dataclass
class Field:
    """A fitted model: weights of features and of transitions by language."""

    langs: list[str]
    weights: np.ndarray  # hashed features, then one row for each language's lexicon
    transitions: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the features of words, and the number of the word that each is of; none for a word without a letter.
        Affixes are the n-grams at the bounds, whose marks tell them from those inside."""
        size = np.uint64(len(self.weights) - len(self.langs))
        cores = [EDGES.sub("", w).lower() for w in words]
        lengths = np.array([len(c) + 2 if c else 0 for c in cores], np.int64)
        ends = np.cumsum(lengths)
        codes = np.frombuffer("".join([f"<{c}>" for c in cores if c]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), lengths)
        last = np.repeat(ends, lengths) - 1
        here = np.arange(len(codes))
        rows, owners, value = [], [], codes
        for n in (2, 3, 4):
            value = value[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] if len(value) else value
            inside = here[: len(value)] + n - 1 <= last[: len(value)]
            mixed = (value[inside] + np.uint64(n)) * np.uint64(0xFF51AFD7ED558CCD)
            rows.append(((mixed ^ (mixed >> np.uint64(29))) % size).astype(np.int64))
            owners.append(owner[: len(value)][inside])
        known = [(i, lang) for i, c in enumerate(cores) if (lang := self.lexicon.get(c)) is not None]
        rows.append(np.array([int(size) + lang for _, lang in known], np.int64))
        owners.append(np.array([i for i, _ in known], np.int64))
        return np.concatenate(rows), np.concatenate(owners)

    def node(self, words: list[str]) -> np.ndarray:
        rows, owner = self.features(words)
        return np.stack([np.bincount(owner, self.weights[rows, i], len(words)) for i in range(len(self.langs))], axis=1).astype(np.float32)


def forward_backward(nodes: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
    """Probability of each state at each place, for sequences of these lengths laid end to end; nodes are log scores.

    `into` (places x states x states), if given, gets the probability of each pair of states at a place and the one before
    it; what it gets at a sequence's first place means nothing."""
    total, k = nodes.shape
    if not total:
        return np.zeros((0, k))
    node = np.exp(nodes - nodes.max(axis=1, keepdims=True)).astype(np.float64) + 1e-12
    step, begin = np.exp(transitions), np.exp(start)
    parts = -(-lengths // SEGMENT)
    firsts = np.cumsum(lengths) - lengths  # place of each sequence's first word
    part_first = np.cumsum(parts) - parts  # number of each sequence's first segment
    owner = np.repeat(np.arange(len(lengths)), parts)
    inner = np.arange(len(owner)) - part_first[owner]
    at = firsts[owner] + inner * SEGMENT
    size = np.minimum(SEGMENT, lengths[owner] - inner * SEGMENT)
    order = np.argsort(-size, kind="stable")
    longest = size[order]
    active = lambda t: int(np.searchsorted(-longest, -t, side="left"))  # noqa: E731  how many have more than t words

    enter = np.tile(begin, (len(owner), 1))  # before a segment's first word
    leave = np.ones((len(owner), k))  # after its last
    if (parts > 1).any():
        # Transfer matrix of each segment that has a neighbour: what its words do to a vector on either side.
        many = order[parts[owner[order]] > 1]
        sizes = size[many]
        move = np.zeros((len(many), k, k))
        move[:, np.arange(k), np.arange(k)] = node[at[many]]
        for t in range(1, int(sizes.max())):
            n = int(np.searchsorted(-sizes, -t, side="left"))
            move[:n] = (move[:n].reshape(-1, k) @ step).reshape(n, k, k) * node[at[many[:n]] + t][:, None, :]
            if t % RESCALE == 0:
                move[:n] /= move[:n].sum(axis=(1, 2), keepdims=True)
        place = np.zeros(len(owner), np.int64)
        place[many] = np.arange(len(many))
        unit = lambda v: v / v.sum(axis=1, keepdims=True)
        for j in range(1, int(parts.max())):
            own = part_first[parts > j] + j
            enter[own] = unit(np.einsum("ni,nij->nj", enter[own - 1], move[place[own - 1]]) @ step)
        for j in range(int(parts.max()) - 2, -1, -1):
            own = part_first[parts > j + 1] + j
            leave[own] = unit(np.einsum("nij,nj->ni", move[place[own + 1]], leave[own + 1]) @ step.T)
    ahead = np.empty((total, k))
    value = enter[order]
    for t in range(int(longest[0])):
        n = active(t)
        value = value[:n] * node[at[order[:n]] + t]
        if t % RESCALE == 0:
            value /= value.sum(axis=1, keepdims=True)
        ahead[at[order[:n]] + t] = value
        value = value @ step
    behind = leave[order]
    if into is not None:
        into[1:] = ahead[:-1, :, None] * step
    for t in range(int(longest[0]) - 1, -1, -1):
        n = active(t)
        spot = at[order[:n]] + t
        ahead[spot] *= behind[:n]
        if into is not None:
            into[spot] *= (node[spot] * behind[:n])[:, None, :]
        behind[:n] = (node[spot] * behind[:n]) @ step.T
        if t % RESCALE == 0:
            behind[:n] /= behind[:n].sum(axis=1, keepdims=True)
    if into is not None:
        into /= into.sum(axis=(1, 2), keepdims=True)
    return ahead / ahead.sum(axis=1, keepdims=True)


def fit(runs: list[tuple[str, list[str]]], *, buckets: int, epochs: int, rate: float, decay: float, batch: int = 64, seed: int = 7) -> Field:
    """Fit to runs of words that are in one language each."""
    langs = sorted({lang for lang, _ in runs})
    k = len(langs)
    number = {lang: i for i, lang in enumerate(langs)}
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
    for lang, words in runs:
        for word in words:
            if core := EDGES.sub("", word).lower():
                counts[core][number[lang]] += 1
    lexicon = {w: int(c.argmax()) for w, c in counts.items() if c.sum() >= 5 and c.max() >= 0.9 * c.sum()}
    model = Field(langs, np.zeros((buckets + k, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    if k < 2:
        return model
    draw = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64) for _, words in runs]
    every, of = model.features(list(vocabulary))
    by = np.argsort(of, kind="stable")
    rows = np.split(every[by], np.cumsum(np.bincount(of, minlength=len(vocabulary)))[:-1])
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        order = draw.permutation(len(runs))
        # A sequence is one run, or two or three joined.
        cuts = np.split(order, np.cumsum(draw.integers(1, 4, len(order)))[: len(order)])
        sequences = [c for c in cuts if len(c)]
        for first in range(0, len(sequences), batch):
            chosen = sequences[first : first + batch]
            flat = [r for c in chosen for r in c]
            words = np.concatenate([ids[r] for r in flat])
            truth = np.concatenate([np.full(len(ids[r]), number[runs[r][0]]) for r in flat])
            lengths = np.array([sum(len(ids[r]) for r in c) for c in chosen])
            distinct, back = np.unique(words, return_inverse=True)
            features = np.concatenate([rows[w] for w in distinct])
            owner = np.repeat(np.arange(len(distinct)), [len(rows[w]) for w in distinct])
            nodes = np.stack([np.bincount(owner, model.weights[features, i], len(distinct)) for i in range(k)], axis=1)[back]
            pair = np.ones((len(nodes), k, k))
            share = forward_backward(nodes, lengths, model.transitions, model.start, pair)
            off = -share
            off[np.arange(len(truth)), truth] += 1
            by_word = np.stack([np.bincount(back, off[:, i], len(distinct)) for i in range(k)], axis=1)
            np.add.at(model.weights, features, (step * by_word[owner] / len(chosen)).astype(np.float32))
            model.weights *= 1 - step * decay
            heads = np.cumsum(lengths) - lengths
            inside = np.setdiff1d(np.arange(1, len(truth)), heads)
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[inside - 1], truth[inside]), 1)
            model.transitions += 0.1 * step * (seen - pair[inside].sum(axis=0)) / max(1, len(inside))
            model.start += 0.1 * step * off[heads].mean(axis=0)
    return model


class Labeller:
    """Labels texts; node scores of the first `most` distinct words of a task are kept, others made for each group."""

    def __init__(self, model: Field, most: int = 1 << 19):
        self.model, self.most = model, most
        self.known: dict[str, int] = {}
        self.nodes = np.zeros((0, len(model.langs)), np.float32)
        self.lettered = np.zeros(0, bool)

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each language for each word of all texts, whether it has a letter, and words a text."""
        known = self.known
        docs = [(text or "").split() for text in texts]
        lengths = np.array([len(d) for d in docs], np.int64)
        before = len(known)
        missing = list({w for d in docs for w in d if w not in known})
        if missing:
            found = self.model.node(missing)
            known.update(zip(missing, range(before, before + len(missing)), strict=True))
            self.nodes = np.concatenate([self.nodes[:before], found])
            self.lettered = np.concatenate([self.lettered[:before], [LETTER.search(w) is not None for w in missing]])
        flat = np.array([known[w] for d in docs for w in d], np.int64)
        share = forward_backward(self.nodes[flat], lengths[lengths > 0], self.model.transitions, self.model.start)
        lettered = self.lettered[flat]
        if len(known) > self.most:
            for word in missing:
                del known[word]
        return share, lettered, lengths

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.model.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        share, lettered, lengths = self.words(texts)
        owner = np.repeat(np.arange(len(texts)), lengths)
        counted = np.bincount(owner, lettered, len(texts))
        sums = np.stack([np.bincount(owner, share[:, i] * lettered, len(texts)) for i in range(len(self.model.langs))], axis=1)
        best = sums.argmax(axis=1)
        return [(self.model.langs[b], min(1.0, float(sums[i, b] / counted[i]))) if counted[i] else (UNKNOWN, 0.0) for i, b in enumerate(best)]

    def column(self, texts: pa.Array, chars: int) -> list[tuple[str, float]]:
        """texts() of a column, some `chars` characters at a time, or one long text."""
        found, group, size = [], [], 0
        for text in texts:
            group.append(text.as_py())
            size += len(group[-1] or "")
            if size >= chars:
                found += self.texts(group)
                group, size = [], 0
        return found + (self.texts(group) if group else [])


def fitted(
    docs: DataFrame,
    learn: Column,
    *,
    per_lang: int = 200,
    runs: int = 6,
    run_words: int = 40,
    buckets: int = 1 << 16,
    epochs: int = 4,
    rate: float = 0.5,
    decay: float = 1e-4,
) -> Field:
    """A field that is learned from a bounded sample of the documents that `learn` lets in."""
    taught = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row for each language. The estimate does not depend on the order of rows.
    counts = taught.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n")).orderBy("lang").collect()
    if not counts:
        return fit([], buckets=buckets, epochs=0, rate=rate, decay=decay)
    low = 1 << 30
    limit = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(low, low * per_lang // max(1, r["n"]))))])
    drawn = taught.select("lang", F.col("text").cast("string").alias("text")).withColumn("draw", F.pmod(F.xxhash64("text", F.lit("learn")), F.lit(low)))
    first = Window.partitionBy("lang").orderBy("draw", "text")
    some = drawn.filter(F.col("draw") < limit[F.col("lang")]).distinct()
    picked = some.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= 2 * per_lang).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                n = min(runs, -(-len(words) // run_words))
                for i in range(n):
                    first = i * len(words) // n
                    langs.append(lang)
                    found.append(words[first : first + run_words])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.string()))], names=["lang", "words"])

    told = picked.mapInArrow(cut, "lang string, words array<string>").toArrow()
    return fit(sorted(zip(told.column(0).to_pylist(), told.column(1).to_pylist(), strict=True)), buckets=buckets, epochs=epochs, rate=rate, decay=decay)


def language_id(docs: DataFrame, held_out: Column, *, batch_words: int = 500_000, **fitting: float) -> DataFrame:
    """doc_id, held_out, lang_pred, score; held_out is a column of doc_id whose rows are never learned from. `fitting`:
    parameters of fitted()."""
    model = fitted(docs, ~held_out, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            found = labeller.column(batch.column(2), 6 * batch_words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        label, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def in_a_language(docs: DataFrame, *, least_score: float = 0.4, batch_words: int = 500_000) -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with at least this score. All rows with a
    language are learned from. Rows that repeat stay or go together; null texts and those without a letter go, as do all
    where no row has a language; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, F.lit(True)))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for batch in batches:
            found = labeller.column(batch.column(at), 6 * batch_words)
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
