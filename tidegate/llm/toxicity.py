"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A document is a bag of sentences.  A sentence's probability is the logistic function of a
bias and the weights of its words; a word's weight is the sum of its features: the word
itself and its character n-grams with word bounds.  A document is toxic unless no sentence
is (noisy-or): 1 - prod(1 - p).  Document labels alone train the sentence scorer, and the
scored sentences then say where the offence lies.

The model is fitted in one task on a bounded sample of labelled rows: at most SAMPLE_ROWS
of each class, those with the smallest hashes of their ids, with their whole texts.
Classes are weighted back to their shares among all labelled rows, which are counted in
full.  Only features that go with the labels in the sample are used, the FEATURES most
telling ones at most, so the model is a short list.  It travels with the tasks, and every
document is scored where it lies.

Edge cases: a null or empty text is one empty sentence and gets the bias alone.  Labels of
documents that are missing, null, or neither 0 nor 1 are not used; of several labels of one
doc_id the largest counts, and of several rows with that id the least text is learned.
Without labels of both classes the score is the share of label 1 among those there are, 0
without any.  An empty table gives no rows; extra columns are ignored, as are lang, source
and ids in any score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 50_000
GRAMS = (3, 4, 5, 6)
SAMPLE_ROWS = 4_000  # of each class
ROUNDS = 120
RATE = 0.08
PENALTY = 1e-5
LEAST_DOCUMENTS = 4  # of the sample, for a feature to be used
LEAST_CHI_SQUARE = 12.0  # of a feature's presence in documents against their labels
MEMO_WORDS = 400_000
FOLDS = 5

_TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
_ENDS = frozenset(".!?\n")
_SENTENCE = re.compile(r"[^.!?\n]+")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; fold 0 is held out.  A null id is in fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(1))


def features(word: str) -> set[str]:
    """The word as a whole, and its character n-grams with its bounds."""
    bounded = f"<{word}>"
    grams = {bounded[i : i + n] for n in GRAMS for i in range(len(bounded) - n + 1)}
    grams.add(f"={word}")
    return grams


def tokens(text: str | None) -> list[str]:
    """Words in lower case, and the marks that end sentences."""
    return _TOKEN.findall((text or "").lower())


@dataclass
class Model:
    """Weights of the features and the bias of a sentence."""

    bias: float
    weights: dict[str, float]
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.begins = {g[: GRAMS[0]] for g in self.weights if g[0] != "="}

    def _word(self, word: str) -> float:
        """Sum over the features of a word; most places in it begin none with a weight."""
        bounded, begins, least = f"<{word}>", self.begins, GRAMS[0]
        places = [i for i in range(len(bounded) - least + 1) if bounded[i : i + least] in begins]
        found = {bounded[i : i + n] for i in places for n in GRAMS if i + n <= len(bounded)}
        found.add(f"={word}")
        return sum(sorted(filter(None, map(self.weights.get, found))))

    def _values(self, found: list[str]) -> np.ndarray:
        known = self.memo.get
        values = [known(t) for t in found]
        if None in values:
            if len(self.memo) > MEMO_WORDS:
                self.memo.clear()
            self.memo.update((end, float("nan")) for end in _ENDS)
            for t in found:
                if t not in self.memo:
                    self.memo[t] = self._word(t)
            values = [self.memo[t] for t in found]
        return np.array(values, dtype=np.float64)

    def sentence_logits(self, text: str | None) -> np.ndarray:
        values = self._values(tokens(text))
        ends = np.isnan(values)
        if not len(values) or ends.all():
            return np.array([self.bias])
        values[ends] = 0.0
        # Words between two marks are a sentence; marks in a row end it once.
        word = np.flatnonzero(~ends)
        new = np.append(True, np.diff(np.cumsum(ends)[word]) > 0)
        return self.bias + np.add.reduceat(values[word], np.flatnonzero(new))

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Start, end and score of the sentences that reach `least`, the worst first.

        A toxic document none of whose sentences does so gets its worst one.
        """
        found = []
        for m in _SENTENCE.finditer(text or ""):
            if tokens(m.group()):
                z = float(self.sentence_logits(m.group())[0])
                found.append((m.start(), m.end(), 1.0 / (1.0 + np.exp(-z))))
        found.sort(key=lambda x: (-x[2], x[0]))
        return [x for i, x in enumerate(found) if i == 0 or x[2] >= least]

    def score(self, text: str | None) -> float:
        return float(-np.expm1(-np.logaddexp(0.0, self.sentence_logits(text)).sum()))


class _Bags:
    """Sample of documents as arrays: features of word types, words of sentences, bags."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        types: dict[str, int] = {}
        words: list[int] = []
        sentence_starts: list[int] = []
        bag_starts: list[int] = []
        for text in texts:
            bag_starts.append(len(sentence_starts))
            sentence_starts.append(len(words))
            for t in tokens(text):
                if t in _ENDS:
                    if sentence_starts[-1] < len(words):
                        sentence_starts.append(len(words))
                else:
                    words.append(types.setdefault(t, len(types)))
            if sentence_starts[-1] == len(words) and len(sentence_starts) - 1 > bag_starts[-1]:
                sentence_starts.pop()
        self.words = np.array(words, dtype=np.int64)
        self.sentence_starts = np.array(sentence_starts, dtype=np.int64)
        self.bag_starts = np.array(bag_starts, dtype=np.int64)
        self.sentence = np.repeat(np.arange(len(sentence_starts)), np.diff(np.append(self.sentence_starts, len(words))))
        self.bag = np.repeat(np.arange(len(texts)), np.diff(np.append(self.bag_starts, len(sentence_starts))))
        self.types = len(types)
        numbers: dict[str, int] = {}
        grams = [[numbers.setdefault(g, len(numbers)) for g in sorted(features(t))] for t in types]
        telling = self._telling(grams, len(numbers), labels)
        names = list(numbers)
        self.names = [names[g] for g in telling]
        place = np.full(len(numbers), -1, dtype=np.int64)
        place[telling] = np.arange(len(telling))
        self.grams = place[np.array([g for gs in grams for g in gs], dtype=np.int64)]
        self.type = np.repeat(np.arange(len(types)), [len(g) for g in grams])
        self.grams, self.type = self.grams[self.grams >= 0], self.type[self.grams >= 0]

    def _telling(self, grams: list[list[int]], size: int, labels: np.ndarray) -> np.ndarray:
        """Features whose presence in documents goes with the documents' labels."""
        seen = np.zeros((2, size))
        owner = self.bag[self.sentence]
        cuts = np.searchsorted(owner, np.arange(len(labels) + 1))
        for number, (start, end) in enumerate(zip(cuts, cuts[1:])):
            present = {g for t in set(self.words[start:end].tolist()) for g in grams[t]}
            seen[int(labels[number] > 0), list(present)] += 1
        n = np.array([(labels <= 0).sum(), (labels > 0).sum()], dtype=np.float64)
        total = seen.sum(axis=0)
        expected = total * n[1] / n.sum()
        spread = expected * (1 - total / n.sum()) * n[0] / n.sum()
        chi = (seen[1] - expected) ** 2 / np.maximum(spread, 1e-9)
        found = np.flatnonzero((total >= LEAST_DOCUMENTS) & (chi >= LEAST_CHI_SQUARE))
        return np.sort(found[np.argsort(-chi[found], kind="stable")[:FEATURES]])

    def logits(self, weights: np.ndarray, bias: float) -> np.ndarray:
        value = np.bincount(self.type, weights[self.grams], self.types) if self.types else np.zeros(0)
        return bias + np.bincount(self.sentence, value[self.words], len(self.sentence_starts))

    def gradient(self, by_sentence: np.ndarray) -> np.ndarray:
        by_type = np.bincount(self.words, by_sentence[self.sentence], self.types)
        return np.bincount(self.grams, by_type[self.type], len(self.names))


def fit(texts: list[str], labels: list[int], class_weights: tuple[float, float] = (1.0, 1.0), rounds: int = ROUNDS) -> Model:
    """Noisy-or likelihood of the document labels, by full-batch Adam."""
    y = np.array(labels, dtype=np.float64)
    bags = _Bags(texts, y)
    weight = np.where(y > 0, class_weights[1], class_weights[0])
    weight /= weight.sum()
    w = np.zeros(len(bags.names))
    bias = -4.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        z = bags.logits(w, bias)
        total = np.clip(np.bincount(bags.bag, np.logaddexp(0.0, z), len(y)), 1e-9, 500.0)
        slope = np.where(y > 0, -1.0 / np.expm1(total), 1.0) * weight
        by_sentence = slope[bags.bag] / (1.0 + np.exp(-np.clip(z, -500.0, 500.0)))
        g = np.append(bags.gradient(by_sentence) + PENALTY * w, by_sentence.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= change[:-1]
        bias -= change[-1]
    return Model(float(bias), dict(zip(bags.names, w.tolist())))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, held_out: bool = True) -> Model:
    """Model from a bounded sample of the labelled documents outside fold 0.

    `held_out=False` learns from all folds.  The model, not the sample, comes to the driver.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out:
        usable = usable.where(fold(F.col("doc_id")) != 0)
    usable = usable.select(F.col("doc_id").cast("bigint").alias("id"), "toxic")
    usable = usable.groupBy("id").agg(F.max("toxic").cast("int").alias("y"))
    texts = documents.select(documents["doc_id"].cast("bigint").alias("id"), documents["text"].alias("text"))
    # Labels of documents that are not in the table cannot be learned from.
    usable = usable.join(texts.select("id"), "id", "left_semi")
    count = {r.y: r.n for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        share = 1.0 if 1 in count else 0.0
        return Model(float("inf") if share else float("-inf"), {})
    chosen = [usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionAll(chosen[1]))  # at most 2 * sample ids
    rows = texts.join(few, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    shares = tuple(count[y] / min(sample, count[y]) for y in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(
            (i, y, t) for b in batches for i, y, t in zip(*[b.column(c).to_pylist() for c in ("id", "y", "text")])
        )
        model = fit([t for _, _, t in found], [y for _, y, _ in found], shares)
        names, weights = list(model.weights), list(model.weights.values())
        yield pa.RecordBatch.from_pylist(
            [{"bias": model.bias, "names": names, "weights": weights}],
            schema=pa.schema(
                [("bias", pa.float64()), ("names", pa.list_(pa.string())), ("weights", pa.list_(pa.float64()))]
            ),
        )

    rows = rows.select("id", "y", F.coalesce("text", F.lit("")).alias("text"))
    got = rows.repartition(1).mapInArrow(run, "bias double, names array<string>, weights array<double>").first()
    return Model(got.bias, dict(zip(got.names, got.weights)))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the offending sentences of toxic documents.

    Sentences are given as start, end (code points, end exclusive) and score.
    """
    bias, weights = model.bias, model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(bias, weights)
        for batch in batches:
            texts = batch.column("text")
            scores = [own.score(t.as_py()) for t in texts]
            found = [own.offending(t.as_py()) if s >= 0.5 else [] for t, s in zip(texts, scores)]
            sentences = [[{"start": a, "end": b, "score": p} for a, b, p in f] for f in found]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(sentences, kind),
                ],
                names=["doc_id", "score", "predicted", "offending"],
            )

    rows = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"].alias("text"))
    return rows.mapInArrow(
        run,
        "doc_id bigint, score double, predicted int, offending array<struct<start: bigint, end: bigint, score: double>>",
    )


def without_toxic(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of `documents` scored below 0.5, with all their columns."""
    bias, weights = model.bias, model.weights
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(bias, weights)
        for batch in batches:
            clean = [own.score(t.as_py()) < 0.5 for t in batch.column(place)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
