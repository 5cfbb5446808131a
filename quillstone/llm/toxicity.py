"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words and their stems (the first STEMS bytes), pairs of
neighbouring words, and pairs with one word between, each hashed to a slot of
BITS bits. A slot has a coordinate for each of LEVELS, which counts as present when the
text has the feature at least so often. Every coordinate has its own learning
rate, and the L1 term keeps most weights at zero, so the model is a few
thousand numbers at most and is broadcast.

Learning: at most SAMPLE_ROWS rows of each class, those with the smallest hash
of the id, and of these as many as begin within SAMPLE_CHARS characters, are learned from in
EPOCHS passes. This bounded sample is one task's work: averaging the weights of parts of
it costs recall, most of all where few rows are toxic. Rows with a null label or text are
not learned. The settings were chosen by cross-validation within training rows
(tests/llm/choose_settings.py); held-out rows were read once, for the figures in the README.
Defined results: a null or empty text has the bias alone, as does any text
without known features; without rows of both classes every score is 0; rows of the
sample with equal hashes go by label and text; whole texts of every length are scored; repeated rows get
one score each; an empty table gives an empty one. Only the id and the text are read, so other columns
do no harm.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, record_batch, sliced, smallest_by_hash
from .language import plain

BITS = 20
#: Bound of the rows of each class that are learned from.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 24_000_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 6.0, 0.0
#: Lengths of the stems that stand beside a longer word, for its inflected forms.
STEMS = (3, 4, 5, 6, 7, 8)
LEVELS = (1, 2, 4, 8)
#: Distinct words whose hashes a task keeps.
WORDS_KEPT = 300_000
THRESHOLD = 0.7

_MASK = np.uint64((1 << BITS) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _slots(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _B
    return ((h >> np.uint64(40)) & _MASK).astype(np.int32)


class Words(dict):
    """word -> its row in two tables: the word's hash, and the hashes of its stems (0 for a stem as long as the word)."""

    def __init__(self):
        super().__init__()
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.hashes, self.stems = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self.hashes)
        self.hashes.append(zlib.crc32(word))
        self.stems.extend([zlib.crc32(word[:k]) + 1 if len(word) > k else 0 for k in STEMS])
        return row

    def slots(self, text: str | None) -> np.ndarray:
        """The slots of every n-gram, skip-gram and stem of the text, repeats included."""
        if len(self) > WORDS_KEPT:
            self.empty()
        words = plain(text or "").split()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        h = np.frombuffer(self.hashes, np.uint64)[rows] if len(words) else np.zeros(0, np.uint64)
        stems = np.frombuffer(self.stems, np.uint64).reshape(-1, len(STEMS))[rows] if len(words) else np.zeros((0, len(STEMS)), np.uint64)
        of = [_slots(s[s > 0] * _C + np.uint64(k)) for k, s in zip(STEMS, stems.T)]
        return np.concatenate([*of, _slots(h * _A), _slots(h[:-1] * _A + h[1:] * _C + _B), _slots(h[:-2] * _A + h[2:] * _C + _C)])


def coordinates(slots: np.ndarray) -> np.ndarray:
    """One coordinate for each slot and each of LEVELS that its count in the text reaches."""
    found, counts = np.unique(slots, return_counts=True)
    return np.concatenate([found[counts >= least] + np.int32(level << BITS) for level, least in enumerate(LEVELS)])


@dataclass(frozen=True)
class Model:
    """coordinates (ascending), their weights, and the bias; there are none in an untrained model."""

    coordinates: np.ndarray
    weights: np.ndarray
    bias: float

    def used(self) -> np.ndarray:
        """For each slot whether any of its coordinates has a weight."""
        out = np.zeros(1 << BITS, bool)
        out[self.coordinates & ((1 << BITS) - 1)] = True
        return out

    def score(self, slots: np.ndarray) -> float:
        """The score of a text by its slots, of which unused ones may be missing."""
        at = coordinates(slots)
        place = np.minimum(np.searchsorted(self.coordinates, at), len(self.coordinates) - 1)
        total = self.bias
        if len(at) and len(self.coordinates):
            total += float(self.weights[place][self.coordinates[place] == at].sum(dtype=np.float64))
        return 0.0 if total < -700 else 1 / (1 + math.exp(-total))


def balanced(rows: list[tuple[int, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """The rows of both classes in turn, those of the smaller class again and again."""
    split = [[r for r in rows if r[0] == label] for label in (0, 1)]
    return [part[k % len(part)] for k in range(max(map(len, split))) for part in split]


def ftrl(rows: list[tuple[int, np.ndarray]]) -> dict[int, float]:
    """coordinate -> weight (-1: the bias) after EPOCHS passes over rows of (label, coordinates)."""
    bias = len(LEVELS) << BITS
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for label, found in rows:
            at = np.append(found, bias)
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - rate * w
            n[at] += g * g
    at = np.nonzero(np.abs(z) > L1)[0]
    return {-1 if i == bias else int(i): float(w) for i, w in zip(at, weights(at))}


def train(df: DataFrame, labels: DataFrame, training: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Weights from labelled rows for which training holds (a condition on the id)."""
    known = labels.where(training & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = smallest_by_hash(known, "label", SAMPLE_ROWS, F.xxhash64("id"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")
    gathered = rows.repartition(1).sortWithinPartitions(F.xxhash64("id", "text"), "label", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, chars, held = Words(), {0: 0, 1: 0}, []
        for batch in sliced(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chars[label] < SAMPLE_CHARS:
                    chars[label] += len(text)
                    held.append((label, coordinates(words.slots(text))))
        if len({label for label, _ in held}) == 2:
            found = ftrl(balanced(held))
            yield record_batch({"coordinate": (list(found), pa.int32()), "weight": (list(found.values()), pa.float64())})

    fitted = durable(gathered.select("label", "text").mapInArrow(run, "coordinate int, weight double"))
    found = {r["coordinate"]: r["weight"] for r in fitted.collect()}
    if not found:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), -math.inf)
    bias = found.pop(-1, 0.0)
    at = np.array(sorted(found), np.int32)
    return Model(at, np.array([found[s] for s in at.tolist()], np.float32), bias)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the model's size is bounded by its bits."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = held.value, Words()
        used = model.used()
        for batch in sliced(batches):
            slots = map(words.slots, batch.column(1).to_pylist())
            yield record_batch({"doc_id": (batch.column(0), None), "score": ([model.score(s[used[s]]) for s in slots], pa.float64())})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
