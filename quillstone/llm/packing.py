"""Packing of tokenized documents into fixed windows by lexical retrieval.

Documents are dealt to shards by a lexical key, the smallest hash of their words, so
that documents with words in common meet more often than by chance whatever their
place in the input; the rows of a key that many documents share are spread over as
many ranges as they fill. A task reads its range in the order of the keys and gathers
shards of SHARD_TOKENS tokens.
A shard has a BM25 inverted index of its own, over token ids: for a seed document it
ranks the shard's unused documents, which fill the seed's window in that order;
the one that does not fit is cut, and its rest is the next seed. Whole windows of
long documents stand alone. What a shard leaves unfinished goes on in the next, so
only the end of a task is short: it is cut into sequences whose lengths are
powers of two, which need no padding. Texts are shuffled once.

Defined results: null counts as empty, and an empty document is its end token;
texts of every length are read whole; repeated rows are documents of their own; equal
scores go by place in the shard; an empty table gives an empty one. Only the id and the
text are read, so other columns do no harm. Sequence ids are unique but not dense.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters, vocabulary_bytes
from .common import range_of, record_batch, shuffle_partitions, sliced

WINDOW = 2048
SHARD_TOKENS = 2_000_000
#: Share of the rows whose keys cut the ranges; it only decides how even they are.
BOUNDS_SAMPLE = 0.05
END = 1
K1, B = 1.2, 0.75
#: A term in more than this share of a shard's pieces has a whole row of weights instead of a list.
DENSE = 1 / 16
#: Ranked pieces that are sorted at once.
FIRST = 32
#: Fixed value: how byte-level vocabularies of this family cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Blank-separated pieces with a character whose class differs between versions of Unicode's tables.
_UNSETTLED = re.compile(r" ?[^ ]*[^\x00-\u024f][^ ]*")
#: White space before a blank: there the blank need not begin a part.
_RUN = re.compile("[ \n\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")


def settled(text: str) -> bool:
    """Whether a text has only characters up to U+024F, which every version of Unicode's tables classes alike."""
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return max(text) <= "\u024f"


class Encoder:
    """Token ids of texts. It holds the vocabulary and nothing of the texts.

    A blank that no white space precedes always begins a new part, so text can be cut
    there: pieces with characters that the fast encoder may class otherwise go to the
    vocabulary's own library.
    """

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        letter = {c: b for b, c in enumerate(byte_letters())}
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letter[c] for c in token): n for token, n in spec["model"]["vocab"].items() if token not in added and all(c in letter for c in token)}
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = tokenizers.Tokenizer.from_str(vocabulary.decode())
        self.exact.no_truncation()
        self.exact.no_padding()

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")

    def _fast(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def ids(self, text: str) -> np.ndarray:
        if self.special and self.special.search(text):
            return self._exact(text)
        if settled(text):
            return self._fast(text)
        if text[-1] == " " or _RUN.search(text):
            return self._exact(text)
        out, at = [], 0
        for m in _UNSETTLED.finditer(text):
            out += [self._fast(text[at : m.start()]), self._exact(m[0])]
            at = m.end()
        return np.concatenate([*out, self._fast(text[at:])])


class Index:
    """BM25 over the token ids of a shard's pieces."""

    def __init__(self, pieces: list[np.ndarray]):
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        keys = np.concatenate(pieces).astype(np.int64) * n + np.repeat(np.arange(n, dtype=np.int64), lengths)
        pairs, counts = np.unique(keys, return_counts=True)
        del keys
        self.docs = (pairs % n).astype(np.int32)
        of = pairs // n
        self.terms, self.starts, df = np.unique(of, return_index=True, return_counts=True)
        self.ends = self.starts + df
        idf = np.log((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(1.0, lengths.mean()))
        self.weights = (np.repeat(idf, df) * counts * (K1 + 1) / (counts + norm[self.docs])).astype(np.float32)
        self.useful = idf > 0
        self.n = n
        # the useful terms of every piece, and rows of weights for those that many pieces have
        term = np.repeat(np.arange(len(df), dtype=np.int32), df)
        order = np.argsort(self.docs, kind="stable")
        order = order[self.useful[term[order]]]
        self.own = np.split(term[order], np.cumsum(np.bincount(self.docs[order], minlength=n))[:-1])
        common = np.nonzero(self.useful & (df > max(8, DENSE * n)))[0]
        self.row = np.full(len(df), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        for k, t in enumerate(common):
            self.rows[k, self.docs[self.starts[t] : self.ends[t]]] = self.weights[self.starts[t] : self.ends[t]]

    def ranked(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused pieces with a positive score for the seed piece, best first, ties by position."""
        at = self.own[seed]
        rows = self.row[at]
        scores = self.rows[rows[rows >= 0]].sum(axis=0).astype(np.float64)
        at = at[rows < 0]
        starts, sizes = self.starts[at], self.ends[at] - self.starts[at]
        take = np.arange(sizes.sum()) + np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) if len(at) else at
        scores += np.bincount(self.docs[take], weights=self.weights[take], minlength=self.n)
        scores[~unused] = 0
        found = np.nonzero(scores > 0)[0]
        scores = scores[found]
        while len(found):  # few are asked for, so they are sorted a few at a time
            least = -np.partition(-scores, FIRST - 1)[FIRST - 1] if len(found) > FIRST else 0.0
            best = scores >= least
            yield from found[best][np.argsort(-scores[best], kind="stable")].tolist()
            found, scores = found[~best], scores[~best]


class Packer:
    """Sequences of one task."""

    def __init__(self, task: int, window: int):
        self.window, self.sequence = window, task << 33
        self.open: list[tuple] = []  # pieces of the unfinished sequence
        self.filled = 0
        self.shard: list[tuple] = []  # (doc, doc_tokens, start, ids)
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self._write(doc, len(ids), start, ids[start : start + self.window], 0)
            self.sequence += 1
        if whole < len(ids):
            self.shard.append((doc, len(ids), whole, ids[whole:]))
            self.held += len(ids) - whole
        if self.held >= SHARD_TOKENS:
            self.pack()

    def _write(self, doc, total: int, start: int, ids: np.ndarray, offset: int) -> None:
        self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.sequence, offset))

    def _place(self, doc, total: int, start: int, ids: np.ndarray) -> bool:
        """Puts a piece into the open window and what does not fit into the next; true if a window was filled."""
        room = self.window - self.filled
        self.open.append((doc, total, start, ids[:room]))
        self.filled += min(room, len(ids))
        if self.filled < self.window:
            return False
        self._close(self.open)
        self.open, self.filled = [], 0
        if len(ids) > room:
            self._place(doc, total, start + room, ids[room:])
        return True

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, total, start, ids in pieces:
            self._write(doc, total, start, ids, offset)
            offset += len(ids)
        self.sequence += 1

    def pack(self) -> None:
        """Places every piece of the shard."""
        if not self.shard:
            return
        index = Index([ids for *_, ids in self.shard])
        unused = np.ones(len(self.shard), bool)
        seed, at = None, 0
        while True:
            if seed is None:  # no window has begun with a cut piece: the next unused one starts
                while at < len(unused) and not unused[at]:
                    at += 1
                if at == len(unused):
                    break
                seed = at
                unused[seed] = False
                if self._place(*self.shard[seed]):
                    seed = seed if self.filled else None
                    continue
            following = None
            for near in index.ranked(seed, unused):
                unused[near] = False
                if self._place(*self.shard[near]):
                    following = near if self.filled else None
                    break
            seed = following
        self.shard, self.held = [], 0

    def finish(self) -> None:
        """The rest of the task as sequences whose lengths are powers of two, longest first."""
        self.pack()
        pieces, left = self.open[::-1], self.filled
        while left:
            size, taken = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc, total, start, ids = pieces.pop()
                taken.append((doc, total, start, ids[:size]))
                if len(ids) > size:
                    pieces.append((doc, total, start + size, ids[size:]))
                size -= min(size, len(ids))
            self._close(taken)
        self.open, self.filled = [], 0


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def by_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row, dealt to partitions by the smallest hash of the text's words and in its order."""
    n = shuffle_partitions(df.sparkSession)
    text = F.col(text_col).cast("string")
    words = F.split(F.lower(text), " ")
    # 52 bits: percentile_approx() works on doubles, and a frequent key has to equal its bounds
    key = F.shiftright(F.coalesce(F.array_min(F.transform(words, lambda w: F.xxhash64(w))), F.lit(0)), 12)
    some = df.sample(BOUNDS_SAMPLE, seed=11).select(key.alias("key"))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), key.alias("key"), F.xxhash64(text, F.col(id_col)).alias("tie"))
    cuts = some.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    bounds = np.sort(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def part(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(range_of(bounds, keys.to_numpy(np.int64), ties.to_numpy(np.int64))).astype("int32")

    return rows.withColumn("part", part("key", "tie")).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("key", F.xxhash64("text"), "doc_id").select("doc_id", "text")


def pack(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (all long)."""
    data = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(data.value).ids, Packer(TaskContext.get().partitionId(), window)
        end = np.array([END], "<u4")

        def written() -> pa.RecordBatch:
            columns = zip(*packer.out) if packer.out else [()] * len(NAMES)
            batch = record_batch({name: (list(values), pa.int64()) for name, values in zip(NAMES, columns)})
            packer.out = []
            return batch

        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(doc, np.concatenate([encode(text or ""), end]))
            yield written()
        packer.finish()
        yield written()

    return by_words(df, id_col, text_col).mapInArrow(run, ", ".join(f"{n} long" for n in NAMES))
