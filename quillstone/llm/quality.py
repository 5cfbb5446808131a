"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms of a text are its lower-cased words, hashed to WORD_TERMS, and triples of
neighbouring runs of three character classes (capitals, small letters, digits, blanks, line ends, and
each punctuation mark by itself; a class that repeats counts once), hashed to
RUN_TERMS, with a few terms for words and lines that repeat. Their weighted frequencies are
projected on the DIMENSIONS leading singular vectors of a bounded labelled sample. The sample's vectors
and labels are broadcast; for every document the cosine with each of them is computed in
blocks, and the NEIGHBOURS most similar vote with weights by similarity.

Learning: at most SAMPLE_ROWS rows of each label, those with the smallest hash of
the id. Rows with a null label or text are not learned. The settings were chosen by
cross-validation within training rows (tests/llm/choose_settings.py); held-out rows were read once, for
the figures in the README.
Defined results: null counts as empty; a text without terms, and every text when
nothing could be learned, gets the share of label 1 in the sample (0.5 without a
sample); cosines are compared to six places, and of equal ones the sample row with the smaller hash
of id and text votes; whole texts of every length are counted; repeated rows get one score each; an
empty table gives an empty one. Only the id and the text are read, so other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import record_batch, sliced, smallest_by_hash

WORD_TERMS = 2048
RUN_TERMS = 2048
REPEAT_TERMS = 8
TERMS = WORD_TERMS + RUN_TERMS
#: Weight of the words beside the runs.
WORD_WEIGHT = 0.25
DIMENSIONS = 48
NEIGHBOURS = 15
SAMPLE_ROWS = 1500
#: Documents whose cosines are held at once.
BLOCK_ROWS = 256
SHARPNESS = 8.0
THRESHOLD = 0.5


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for c in range(256):
        ch = chr(c)
        out[c] = 1 if "A" <= ch <= "Z" else 2 if "a" <= ch <= "z" or c >= 128 else 3 if "0" <= ch <= "9" else 4 if ch in " \t\x0b\x0c\r" else 5 if ch == "\n" else 6 + c
    return out


_CLASS = _classes()


def term_counts(text: str | None) -> np.ndarray:
    """How often each term is in the text."""
    data = (text or "").encode("utf-8", "replace")
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    kinds = kinds[np.append(True, kinds[1:] != kinds[:-1])] if len(kinds) else kinds
    runs = (kinds[:-2] * np.uint32(40503) + kinds[1:-1] * np.uint32(2654435761) + kinds[2:] * np.uint32(97531)) if len(kinds) > 2 else kinds
    runs ^= runs >> np.uint32(15)
    runs *= np.uint32(2246822519)
    words = data.lower().split()
    n = len(words)
    hashed = np.fromiter(map(crc32, words), np.uint32, n) % np.uint32(WORD_TERMS)
    out = np.zeros(TERMS + REPEAT_TERMS, np.float32)
    out[:WORD_TERMS] = np.bincount(hashed, minlength=WORD_TERMS)
    out[WORD_TERMS:TERMS] = np.bincount(runs >> np.uint32(21), minlength=RUN_TERMS)
    again = [sum(map(eq, words, words[1:])), sum(map(eq, words, words[2:])), n - len(set(words))]
    lines = [line for line in data.split(b"\n") if line.strip()]
    again.append((len(lines) - len(set(lines))) * n / max(1, len(lines)))
    out[TERMS : TERMS + len(again)] = again
    return out


def weighted(counts: np.ndarray) -> np.ndarray:
    """Square roots of frequencies, words and runs each by their own sum, by document: rows of unit length, or zero."""
    words = counts[:, :WORD_TERMS].sum(axis=1, keepdims=True)
    runs = counts[:, WORD_TERMS:TERMS].sum(axis=1, keepdims=True)
    shares = np.sqrt(counts / np.maximum(1.0, runs))
    shares[:, :WORD_TERMS] = WORD_WEIGHT * np.sqrt(counts[:, :WORD_TERMS] / np.maximum(1.0, words))
    return shares / np.maximum(1e-12, np.linalg.norm(shares, axis=1, keepdims=True))


@dataclass(frozen=True)
class Model:
    """Term weights, the projection, and the sample's unit vectors with their labels."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        x = (weighted(counts) * self.idf) @ self.basis
        return (x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), prior)
        cosines = np.round(self.project(counts) @ self.vectors.T, 6)
        k = min(NEIGHBOURS, cosines.shape[1])
        least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
        above, equal = cosines > least, cosines == least
        near = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        weight = np.where(near, np.exp(SHARPNESS * (cosines - 1.0)), 0.0).astype(np.float64)
        votes = (weight @ self.labels.astype(np.float64)) / weight.sum(axis=1)
        return np.where(counts.any(axis=1), votes, prior).astype(np.float64)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    """The model of a bounded sample, ordered so that the result does not depend on how it arrived."""
    if not len(labels):
        return Model(np.ones(TERMS + REPEAT_TERMS, np.float32), np.zeros((TERMS + REPEAT_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float32))
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    x = weighted(counts) * idf
    # leading right singular vectors by subspace iteration on a fixed start
    start = np.random.default_rng(7).standard_normal((x.shape[1], min(DIMENSIONS + 8, len(x)))).astype(np.float32)
    basis = start
    for _ in range(5):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
    basis = (basis @ turn.T)[:, :DIMENSIONS].astype(np.float32)
    model = Model(idf, basis, np.zeros((0, 1), np.float32), labels.astype(np.float32))
    return Model(idf, basis, model.project(counts), model.labels)


def train(df: DataFrame, labels: DataFrame, training: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from labelled rows for which training holds (a condition on the id)."""
    known = labels.where(training & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    chosen = smallest_by_hash(known, "label", SAMPLE_ROWS, F.xxhash64("id"))
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(chosen), "id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [term_counts(t) for t in batch.column(1).to_pylist()]
            at = [np.nonzero(c)[0].astype(np.int32) for c in found]
            yield record_batch({"label": (batch.column(0), None), "key": (batch.column(2), None), "at": (at, pa.list_(pa.int32())), "n": ([c[k] for c, k in zip(found, at)], pa.list_(pa.float32()))})

    sample = sorted(tuple(r) for r in rows.select("label", "text", F.xxhash64("id", "text").alias("key")).mapInArrow(run, "label int, key long, at array<int>, n array<float>").collect())
    sample.sort(key=lambda r: r[1])
    counts = np.zeros((len(sample), TERMS + REPEAT_TERMS), np.float32)
    for row, (_, _, at, n) in zip(counts, sample):
        row[at] = n
    return fit(counts, np.array([r[0] for r in sample]))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; the broadcast model is bounded by the sample and the dimensions."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            scores = [held.value.scores(np.array([term_counts(t) for t in texts[a : a + BLOCK_ROWS]])) for a in range(0, len(texts), BLOCK_ROWS)]
            yield record_batch({"doc_id": (batch.column(0), None), "score": (np.concatenate(scores) if scores else [], pa.float64())})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")
