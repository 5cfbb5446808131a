"""Order MinHash fingerprints, sensitive to edit distance.

Every k-mer of code points is numbered by its occurrence in the text, and each
numbered k-mer is hashed. An entry of the signature has its own hash function
over its own share of the numbered k-mers (a fixed share by hash, the same for
every text): the TUPLE smallest are taken, put back in text order, and hashed
together. Texts near in edit distance keep both the k-mers and their order, so
the share of equal entries falls with edit distance, not only with overlap.

Defined results: null counts as empty; texts of fewer than K characters have one
k-mer, the text; the empty text has none, and two texts without any
entry are alike (1); texts of every length are read whole; rows that repeat an id are
ordered by their text's hash, greatest first, then by the text; null ids come last; a
single row is its own neighbour; an empty table gives an empty one. Only the id and the text are
read, so other columns do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import range_of, record_batch, shuffle_partitions, sliced

K = 8
TUPLE = 2
SHARES = 8
PER_SHARE = 8
_ENTRIES = SHARES * PER_SHARE
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.uint64(0)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_FACTORS = _multipliers(PER_SHARE)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def kmer_hashes(points: np.ndarray) -> np.ndarray:
    """A polynomial hash of each run of K code points (of all of them, if fewer)."""
    h, width, power = points.astype(np.uint64) + np.uint64(1), 1, _BASE
    if len(h) < K:
        total = np.uint64(0)
        for c in h:
            total = total * _BASE + c
        return np.array([total], np.uint64) if len(h) else h
    while width < K:
        h = h[:-width] * power + h[width:]
        width, power = width * 2, power * power
    return h


def numbered(h: np.ndarray) -> np.ndarray:
    """Each hash mixed with the count of its earlier occurrences."""
    order = np.argsort(h)
    s = h[order]
    same = np.empty(len(s), bool)
    same[:1] = False
    np.equal(s[1:], s[:-1], out=same[1:])
    out = h.copy()
    if same.any():
        member = same.copy()
        member[:-1] |= same[1:]
        group = np.cumsum(~same)[member]
        at = order[member]
        again = np.lexsort((at, group))
        group, at = group[again], at[again]
        first = np.r_[True, group[1:] != group[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
        out[at] += (np.arange(len(group)) - start).astype(np.uint64) * _BASE
    return _mixed(out)


def signature(text: str) -> np.ndarray:
    """The entries; 0 where a share of the text's k-mers is empty."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(_ENTRIES, np.uint64)
    with np.errstate(over="ignore"):
        if not len(h := kmer_hashes(points)):
            return out
        h = numbered(h)
        share = (h & np.uint64(SHARES - 1)).astype(np.uint8)
        for s in range(SHARES):
            own = h[share == s]
            if not len(own):
                continue
            for f in range(PER_SHARE):
                x = own * _FACTORS[f]
                x ^= x >> np.uint64(31)
                if len(own) > TUPLE:
                    first = int(x.argmin())
                    held = x[first]
                    x[first] = np.uint64(2**64 - 1)
                    second = int(x.argmin())
                    a, b = (held, x[second]) if first < second else (x[second], held)
                    total = a * _BASE + b
                else:
                    total = np.uint64(0)
                    for v in x:
                        total = total * _BASE + v
                out[s * PER_SHARE + f] = (total ^ (total >> np.uint64(29))) | np.uint64(1)
    return out


def text_of(entries: np.ndarray) -> str:
    """The fingerprint as text: 32 bits of each entry in hex."""
    return (entries >> np.uint64(32)).astype(">u4").tobytes().hex() if entries.any() else "0" * (8 * _ENTRIES)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal entries among those that either text has."""
    have = (a != _EMPTY) | (b != _EMPTY)
    n = int(have.sum())
    return float(((a == b) & have).sum() / n) if n else 1.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc, text: str, own: np.ndarray, following: str, next_own: np.ndarray):
    changed = edited(text, following)
    other = own if changed == text else signature(changed)
    return (doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), text_of(own), text_of(other), likeness(own, other), likeness(own, next_own))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield record_batch({"doc_id": (batch.column(0), None), "fingerprint": ([text_of(signature(t or "")) for t in batch.column(1).to_pylist()], pa.string())})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of a neighbour comparison: (part, helper, doc_id, text), by part in descending id.

    Ids are cut into ranges by approximate quantiles, an id of very many rows
    further by its texts' hashes; the first row of each range is also sent, as a helper,
    to the end of the range before (the first of all to the last). A range is
    one partition, and the texts are shuffled once.
    """
    n = shuffle_partitions(df.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.col(id_col).cast("long")
    rows = df.select(doc.alias("doc_id"), text.alias("text"), F.coalesce(doc, F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("tie"))
    cuts = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bounds = np.sort(np.array(cuts or [], np.int64))
    last = len(bounds)

    @F.pandas_udf("int")
    def part(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(last - range_of(bounds, keys.to_numpy(np.int64), ties.to_numpy(np.int64))).astype("int32")

    # one row for each range: its first, the greatest (key, tie)
    heads = sorted(tuple(r) for r in rows.groupBy(part("key", "tie").alias("part")).agg(F.max(F.struct("key", "tie")).alias("h")).select("part", "h.key", "h.tie").collect())
    head_key, head_tie, before = (np.zeros(last + 1, np.int64) for _ in range(3))
    for k, (p, key, tie) in enumerate(heads):
        head_key[p], head_tie[p], before[p] = key, tie, heads[k - 1][0]

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series, ties: pd.Series) -> pd.Series:
        keys, ties = keys.to_numpy(np.int64), ties.to_numpy(np.int64)
        of = last - range_of(bounds, keys, ties)
        first = (head_key[of] == keys) & (head_tie[of] == ties)
        return pd.Series([[p, b] if f else [p] for p, b, f in zip(of.tolist(), before[of].tolist(), first.tolist())])

    placed = rows.select("doc_id", "text", "key", "tie", F.posexplode(places("key", "tie")).alias("helper", "part"))
    return placed.repartitionById(last + 1, "part").sortWithinPartitions("helper", F.desc("key"), F.desc("tie"), "text").select("part", "helper", "doc_id", "text")


def compare_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint against its edited text's and the next row's, in descending id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc, text, signature of the row that waits for the next one
        for batch in sliced(batches):
            out = []
            for part, helper, doc, text in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if held is None or held[0] != part:
                    held = None if helper else (part, doc, text, signature(text))
                    continue
                own = signature(text)
                out.append(_row(*held[1:], text, own))
                held = None if helper else (part, doc, text, own)
            if out:
                yield record_batch({name: (list(v), _TYPES[name]) for name, v in zip(_TYPES, zip(*out))})

    return with_next(df, id_col, text_col).mapInArrow(run, SCHEMA)
