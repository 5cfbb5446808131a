"""Language identification by compression.

Each language has a raw-content zstandard dictionary of text in it. A text is cut
into blocks, every block is compressed with every dictionary, and the language
whose blocks are smallest in sum is chosen. A text whose two best languages
are close is rejected.

Learning: at most SAMPLE_ROWS rows of each language, the ones with the smallest
hash of id and text, give an excerpt of at most EXCERPT_CHARS characters each, all of
which the dictionary holds. Null languages are not learned. The settings were not tuned:
they were set once and the held-out accuracy is reported as it came.
Defined results: null text, or text without a letter (Unicode's category L),
gets 'und', score 0, and is rejected; with no learned language every text does;
of languages with equal sizes the one whose dictionary holds most of the text's
words is chosen, then the one that sorts first. Whole texts are compressed; repeated
rows get one answer each; an empty table gives an empty one; columns that have
the names of results are replaced, accepted() keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped_by_place, record_batch, sliced, smallest_by_hash

#: Bounds of what is learned from, for each language.
SAMPLE_ROWS = 400
EXCERPT_CHARS = 600
BLOCK_BYTES = 16 * 1024
LEVEL = 6
#: Least share by which the best language has to be smaller than the next.
MARGIN = 0.01

#: ASCII letters and all bytes of other characters stay; the rest separates words.
_KEPT = bytes(c if 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def plain(text: str) -> bytes:
    """The text's words in lower case, with one space before and after each."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_KEPT).split()) + b" "


@dataclass(frozen=True)
class LanguageModel:
    """language -> dictionary content."""

    contents: dict[str, bytes]


def train(df: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Dictionaries from the rows for which training holds; bounded by rows and characters for each language."""
    rows = df.where(training & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(lang_col).alias("language"), F.col(text_col).alias("text"))
    at = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - EXCERPT_CHARS)).cast("int")
    pieces = rows.select("id", "language", F.substring(F.col("text"), at + 1, F.lit(EXCERPT_CHARS)).alias("piece"), F.xxhash64("id", "text").alias("key"))
    chosen = smallest_by_hash(pieces, "language", SAMPLE_ROWS, F.col("key")).select("language", "key", "piece")
    by: dict[str, list[tuple[int, str]]] = {}
    for language, key, piece in chosen.collect():
        by.setdefault(language, []).append((key, piece))
    return LanguageModel({k: b"".join(plain(p)[1:] for _, p in sorted(v)) for k, v in sorted(by.items())})


class Compressors:
    """Prepared once in a task."""

    def __init__(self, model: LanguageModel):
        self.languages = sorted(model.contents)
        self.tools = []
        for language in self.languages:
            held = zstandard.ZstdCompressionDict(model.contents[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

        self.contents = model.contents

    def words_held(self, language: str, text: str) -> int:
        """How many of the text's words are in the dictionary: only ties of very short texts ask for this."""
        return sum(b" " + w + b" " in self.contents[language] for w in plain(text).split())

    def sizes(self, text: str) -> list[int]:
        data = plain(text)
        blocks = [data[a : a + BLOCK_BYTES] for a in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(tool.compress(b)) for b in blocks) for tool in self.tools]

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, True
        ranked = sorted(zip(self.sizes(text), self.languages))
        best = ranked[0][0]
        margin = 1.0 if len(ranked) < 2 else (ranked[1][0] - best) / ranked[1][0]
        tied = [language for size, language in ranked if size == best]
        chosen = tied[0] if len(tied) == 1 else max(tied, key=lambda language: self.words_held(language, text))
        return chosen, min(1.0, 0.5 + 2.5 * margin), margin < MARGIN


def broadcast(df: DataFrame, model: LanguageModel):
    """The model for the tasks: bounded by the languages' samples."""
    return df.sparkSession.sparkContext.broadcast(model)


def identify(df: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with lang_pred, score and rejected for every row; kept columns of these names are replaced."""
    keep = [F.col(f"`{c}`") for c in keep if c not in ("lang_pred", "score", "rejected")]
    fields = df.select(*keep).schema
    out = fields.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    held = broadcast(df, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(held.value)
        for batch in sliced(batches):
            found = [tools.identify(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            n = batch.num_columns - 1
            columns = {f"c{k}": (batch.column(k), None) for k in range(n)}
            language, score, rejected = zip(*found)
            yield record_batch(columns | {f"c{n}": (list(language), pa.string()), f"c{n + 1}": (list(score), pa.float64()), f"c{n + 2}": (list(rejected), pa.bool_())})

    return mapped_by_place(df.select(*keep, F.col(text_col).cast("string").alias("text")), run, out)


def accepted(df: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of df, columns as they are, whose language was found with enough margin."""
    at = df.columns.index(text_col)
    held = broadcast(df, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = Compressors(held.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array([not tools.identify(t)[2] for t in batch.column(at).to_pylist()], pa.bool_()))

    return mapped_by_place(df, run, df.schema)
