"""Byte-pair encoding of whole texts with a public vocabulary, and decoding.

The vocabulary marks word ends, folds case and drops white space: text is put
in composed form, lower-cased character by character, and cut into words by the
vocabulary's pattern; each word's UTF-8 bytes, the last with the end mark, are
merged by rank.

Merging a short word works on two contiguous arrays, the part boundaries and the rank of
every adjacent pair: scan for the smallest rank, delete the boundary between
the two parts, refresh the ranks on either side. A word of more than LONG_WORD
bytes, for which repeated scans would cost its square, keeps the same ranks in a
heap. What a blank-separated piece encodes to is kept in a table of bounded size.

Defined results: null counts as empty; the empty text has no ids. The special
strings of the vocabulary are found in the raw text, as its library does.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch

LONG_WORD = 96
#: Most pieces whose encoding a task keeps.
PIECES_KEPT = 300_000
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in vocabularies of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


#: White space as Unicode's property has it; Python's own \\s holds four control characters more.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Letters and numbers new in Unicode 16, for Pythons with older tables.
_NEW = {
    "L": "\\u1c89-\\u1c8a\\ua7cb-\\ua7cd\\ua7da-\\ua7dc\\U000105c0-\\U000105f3\\U00010d4a-\\U00010d65\\U00010d6f-\\U00010d85"
    "\\U00010ec2-\\U00010ec4\\U00011380-\\U00011389\\U0001138b\\U0001138e\\U00011390-\\U000113b5\\U000113b7\\U000113d1\\U000113d3"
    "\\U00011bc0-\\U00011be0\\U00013460-\\U000143fa\\U00016100-\\U0001611d\\U00016d40-\\U00016d6c\\U00018cff"
    "\\U0001e5d0-\\U0001e5ed\\U0001e5f0",
    "N": "\\U00010d40-\\U00010d49\\U000116d0-\\U000116e3\\U00011bf0-\\U00011bf9\\U00016130-\\U00016139\\U00016d70-\\U00016d79"
    "\\U0001ccf0-\\U0001ccf9\\U0001e5f1-\\U0001e5fa",
}


#: Small letters that came with Unicode 16 and 17, by capital (and by first capital of a run).
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITALS = re.compile("[" + "".join(map(chr, _SMALL)) + "]")


def _category(letter: str) -> str:
    """The code points of a general category, as of Unicode 16, as ranges for a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == letter
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out) + (_NEW[letter] if unicodedata.unidata_version < "16" else "")


def with_classes(pattern: str) -> str:
    """A vocabulary's pattern with its letters, numbers and white space spelled out for Python's expressions."""
    letters, numbers = _category("L"), _category("N")
    for name, ranges in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", _SPACE)):
        bare = pattern.replace(f"[{name}]", f"[{ranges}]")
        pattern = bare.replace(name, ranges)
    return pattern


class Vocabulary:
    """Tables of one vocabulary file; made once in a task from the file's bytes."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.ids |= self.special
        self.tokens = {n: t for t, n in self.ids.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # a pair of ids as one number -> rank; rank -> id of what the pair makes
        self.ranks = {self.ids[a] << 20 | self.ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = re.compile(with_classes(split["pattern"]["Regex"]))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.last = [self.ids[c + self.end] for c in letters]

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if _CAPITALS.search(text):
            text = text.translate(_SMALL)
        # one character at a time: no rule here looks at a character's place in its word
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        parts = [self.inner[b] for b in word]
        parts[-1] = self.last[word[-1]]
        return self._merge_long(parts) if len(parts) > LONG_WORD else self._merge_short(parts)

    def _merge_short(self, parts: list[int]) -> list[int]:
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(a << 20 | b, _NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != _NEVER:
            at = ranks.index(least)
            parts[at] = made[least]
            del parts[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] << 20 | parts[at + 1], _NEVER)
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] << 20 | parts[at], _NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, rank_of = len(parts), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(rank, at, parts[at], parts[at + 1]) for at in range(n - 1) if (rank := rank_of(parts[at] << 20 | parts[at + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, a, b = heapq.heappop(heap)
            right = after[at]
            if parts[at] != a or right < 0 or parts[right] != b:
                continue  # one of the two has been merged since
            parts[at], parts[right] = self.made[rank], -1
            after[at] = after[right]
            if after[right] >= 0:
                before[after[right]] = at
            for x, y in ((before[at], at), (at, after[at])):
                if x >= 0 and y >= 0 and (rank := rank_of(parts[x] << 20 | parts[y])) is not None:
                    heapq.heappush(heap, (rank, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of a text without special strings."""
        return self.encode_normal(self.normal(piece))

    def encode_normal(self, text: str) -> list[int]:
        """The ids of a text in normal form: plain words need no cutting."""
        if text.isascii() and text.isalpha():
            return self.merge(text.encode())
        return [i for word in self.words.findall(text) for i in self.merge(word.encode("utf-8", "surrogatepass"))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.specials.split(text)):
            out += [self.special[part]] if k % 2 else self.encode_piece(part) if part else []
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space: this vocabulary has no decoder of its own."""
        return " ".join(self.tokens[i] for i in ids)


class Pieces(dict):
    """piece -> (ids as text, tokens as text), for blank-separated pieces in normal form; what does not fit is not kept."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[str, str]:
        found = self.texts(self.vocabulary.encode_normal(piece))
        if len(self) < PIECES_KEPT and len(piece) < LONG_WORD:
            self[piece] = found
        return found

    def texts(self, ids: list[int]) -> tuple[str, str]:
        return " ".join(map(str, ids)), self.vocabulary.decode(ids)

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """(count, ids joined by a space, decoded text). Blanks and line feeds always separate words."""
        text = text or ""
        if self.vocabulary.specials.search(text):
            ids = self.vocabulary.encode(text)
            return len(ids), *self.texts(ids)
        found = [self[p] for p in self.vocabulary.normal(text).replace("\n", " ").split(" ") if p]
        ids = " ".join([a for a, _ in found if a])
        return (ids.count(" ") + 1 if ids else 0), ids, " ".join([b for a, b in found if a])


@lru_cache(maxsize=1)
def pieces(vocabulary: bytes) -> Pieces:
    """One for each worker process, whose tasks share what it keeps."""
    return Pieces(Vocabulary(vocabulary))


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def round_trip(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    The driver reads the vocabulary file (a few MB whatever the input) and
    broadcasts its bytes.
    """
    data = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = pieces(data.value).round_trip
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            done = [(n, sha(ids), sha(back)) for n, ids, back in map(encoded, batch.column(1).to_pylist())]
            n, ids, back = zip(*done) if done else ((), (), ())
            yield record_batch({"doc_id": (batch.column(0), None), "n_tokens": (list(n), pa.int64()), "ids_sha256": (list(ids), pa.string()), "decoded_sha256": (list(back), pa.string())})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row."""
    data = df.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(data.value).vocabulary
        for batch in batches:
            yield record_batch({"doc_id": (batch.column(0), None), "ids": ([vocabulary.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")
