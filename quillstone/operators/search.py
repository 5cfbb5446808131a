"""Vector and full-text lookups behind the corresponding index configurations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, metric: str) -> Column:
    """Greater is nearer: cosine, dotProduct, or euclidean (the distance with its sign turned)."""
    if metric == "dotProduct":
        return dot(a, b)
    if metric == "euclidean":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(df: DataFrame, id_col: str, vector: str, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """(id, score) of the k rows nearest to a query vector: exact, one pass, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(F.col(id_col), similarity(F.col(vector), q, metric).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


#: Query vectors that a task holds, rows that pass by it, and scores that it takes at once.
QUERY_BLOCK, ROW_BLOCK, SCORES = 16384, 16384, 1 << 21
#: Pairs whose scores are computed exactly at once.
PAIRS = 16384


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Of pairs, one a row, rounded so that equal vectors tie."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        if metric == "euclidean":
            s = -np.sqrt(((q - v) ** 2).sum(axis=1))
        else:
            s = (q * v).sum(axis=1)
            if metric != "dotProduct":
                s = s / (np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1))
        return np.where(np.isnan(s), -np.inf, np.round(s, 12))


class _Best:
    """The k best rows of each of a block of queries so far.

    A product of matrices gives the scores roughly. Only pairs that may
    be among the k best, rounding errors allowed for, are scored exactly.
    """

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        self.scores, self.ids, self.found = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64), np.zeros((len(q), k), bool)
        self.norms = np.linalg.norm(q, axis=1)
        self.left = self.q if metric in ("dotProduct", "euclidean") else self._unit(q)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return v / np.linalg.norm(v, axis=1)[:, None]

    def _possible(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that may be among the best, and then some; what isn't a number stays."""
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            norms = np.linalg.norm(v, axis=1)
            most, least = norms.max(), np.where(self.found.all(axis=1), self.scores[:, -1], -np.inf)
            if self.metric == "euclidean":  # by the square of the distance
                rough = self.left @ v.T
                rough *= 2
                rough -= (self.norms**2)[:, None]
                rough -= norms**2
                least, slack = -(least**2), 1e-9 * (self.norms**2 + most**2) + 4e-12 * (self.norms + most) + 1e-23
            elif self.metric == "dotProduct":
                rough, slack = self.left @ v.T, 1e-9 * self.norms * most + 4e-12
            else:
                rough, slack = self.left @ self._unit(v).T, 1e-9
            if len(v) >= self.k and not self.found.all():  # k rows of these are a bound as well
                least = np.maximum(least, np.partition(rough, -self.k, axis=1)[:, -self.k])
            return np.nonzero(~(rough < (least - slack)[:, None]))

    def add(self, ids: np.ndarray, v: np.ndarray) -> None:
        step = max(1, SCORES // len(self.q))
        for n in range(0, len(v), step):
            self._add(ids[n : n + step], v[n : n + step])

    def _add(self, ids: np.ndarray, v: np.ndarray) -> None:
        at, row = self._possible(v)
        if not len(at):
            return
        s = np.concatenate([_scores(self.q[at[n : n + PAIRS]], v[row[n : n + PAIRS]], self.metric) for n in range(0, len(at), PAIRS)])
        asked = np.unique(at)
        was = self.found[asked]
        at = np.concatenate([np.repeat(asked, was.sum(axis=1)), at])
        s, i = np.concatenate([self.scores[asked][was], s]), np.concatenate([self.ids[asked][was], ids[row]])
        order = np.lexsort((i, -s, at))
        at, s, i = at[order], s[order], i[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        at, place = at[kept], place[kept]
        self.scores[at, place], self.ids[at, place], self.found[at, place] = s[kept], i[kept], True


def _vectors(column: pa.Array) -> np.ndarray:
    """A row a vector; vectors of several lengths are an error, and so are missing numbers."""
    flat = column.flatten()
    if flat.null_count or len(set(column.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors differ in length or lack numbers")
    return flat.to_numpy().astype(float).reshape(len(column), -1 if len(flat) else 0)


def nearest_each(df: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, id, score) of the k rows nearest to each row of queries: exact, ties by id; ids are bigint.

    Queries and rows are dealt into blocks, and each pair of blocks meets in one
    task: it holds the queries, the rows pass by, and the k best a query stay.
    These are merged. A task holds no more for a larger table. Rows without a
    vector are left out.
    """
    n_rows, n_queries = (max(1, -(-d.count() // most)) for d, most in ((df, ROW_BLOCK), (queries, QUERY_BLOCK)))

    def dealt(d: DataFrame, row: bool) -> DataFrame:
        own, other = (n_rows, n_queries) if row else (n_queries, n_rows)
        mine = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        found = d.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.lit(row).alias("row"))
        found = found.select("*", mine.alias("mine"), theirs.alias("theirs"))
        return found.select("id", "v", "row", ((F.col("mine") * n_queries + F.col("theirs")) if row else (F.col("theirs") * n_queries + F.col("mine"))).alias("cell"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best = [], None
        for batch in batches:
            row = batch.column("row").to_numpy(zero_copy_only=False)
            asked, passing = batch.filter(pa.array(~row)), batch.filter(pa.array(row))
            if asked.num_rows:
                held.append((asked.column("id").to_numpy(), _vectors(asked.column("v"))))
            if passing.num_rows and held:
                if best is None:  # the queries come first
                    best = _Best(np.concatenate([v for _, v in held]), k, metric)
                best.add(passing.column("id").to_numpy(), _vectors(passing.column("v")))
        if best is not None:
            at = np.nonzero(best.found)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i for i, _ in held])[at[0]]), pa.array(best.ids[at]), pa.array(best.scores[at])], names=["query_id", "id", "score"])

    cells = dealt(queries, False).unionByName(dealt(df, True)).repartitionById(n_rows * n_queries, "cell").sortWithinPartitions("row").drop("cell")
    found = cells.mapInArrow(run, "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def tokenized(c: Column, ngram: int | None = None, stop_words: Sequence[str] = ()) -> Column:
    """The tokens of a text: lower-case words between white space, or character n-grams of them."""
    words = F.filter(F.split(F.lower(c), r"\s+"), lambda w: (w != "") & (~w.isin(*stop_words) if stop_words else F.lit(True)))
    if ngram is None:
        return words
    return F.flatten(F.transform(words, lambda w: F.when(F.length(w) >= ngram, F.transform(F.sequence(F.lit(1), F.length(w) - ngram + 1), lambda k: F.substring(w, k, F.lit(ngram)))).otherwise(F.array(w))))


#: Characters of texts that are cut into n-grams at once, and rows that are unpacked for it.
CHARS, ROWS = 1 << 19, 256
_SPACE = re.compile(r"[ \t-\r]")


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about CHARS characters; a longer text is cut at white space."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for n in range(0, batch.num_rows, ROWS):
            part = batch.slice(n, ROWS)
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                start = 0
                while start < len(text):
                    cut = _SPACE.search(text, start + CHARS)
                    end = cut.start() if cut else len(text)
                    ids.append(i)
                    texts.append(text[start:end])
                    size, start = size + end - start + 1, end + 1
                    if size >= CHARS:
                        yield ids, texts
                        ids, texts, size = [], [], 0
    if texts:
        yield ids, texts


def _grams(texts: Sequence[str], group: np.ndarray, n: int, stop_words: Sequence[str] = (), most: int = 1 << 62) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(group, index of a term, tf) by group, and the terms: n-grams of words, and words shorter than that, as tokenized() has them."""
    c = np.frombuffer((" " + " ".join(texts) + " " * n).encode("utf-32-le"), np.uint32)
    of = np.repeat(np.concatenate([group[:1], group, group[-1:]]), [1, *[len(t) + 1 for t in texts], n - 1])
    inside = ~((c == 32) | ((c >= 9) & (c <= 13)))

    def words() -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        return start, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - start

    start, length = words()
    for w in stop_words:
        at = start[length == len(w)]
        for k, x in enumerate(w):
            at = at[c[at + k] == ord(x)]
        inside[at[:, None] + np.arange(len(w))] = False
    start, length = words()
    full = inside[: len(c) - n + 1].copy()
    for k in range(1, n):
        full[:] &= inside[k : len(c) - n + 1 + k]
    full, short = np.flatnonzero(full), length < n
    at = np.concatenate([full, start[short]])
    size = np.concatenate([np.full(len(full), n), length[short]])
    if not len(at):
        return at, at, at, []
    seen = np.zeros(int(c.max()) + 1, bool)
    seen[c] = True
    letter = np.cumsum(seen)[c]  # 0 stands for no letter
    letters, groups = int(letter.max()) + 1, int(of.max()) + 1
    window = lambda x, k: np.where(k < size, x[np.minimum(at + k, len(c) - 1)], 0)
    if letters**n * groups <= most:
        code, kinds = np.zeros(len(at), np.int64), letters**n
        for k in range(n):
            code = code * letters + window(letter, k)
        key = np.sort(of[at] * kinds + code)
    else:  # too many letters for one number
        kind, code = np.unique(np.stack([window(letter, k) for k in range(n)], axis=1), axis=0, return_inverse=True)
        kinds = len(kind)
        key = np.sort(of[at] * kinds + code.ravel())
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf, key = np.diff(np.append(first, len(key))), key[first]
    code, term = np.unique(key % kinds, return_inverse=True)
    digits = code[:, None] // letters ** np.arange(n - 1, -1, -1) % letters if letters**n * groups <= most else kind[code]
    flat = np.concatenate([[0], np.flatnonzero(seen)]).astype("<u4")[digits].tobytes().decode("utf-32-le")
    return key // kinds, term, tf, [flat[k * n : k * n + m] for k, m in enumerate((digits > 0).sum(axis=1))]


def _gram_counts(rows: DataFrame, n: int, stop_words: Sequence[str]) -> DataFrame:
    """(term, id, tf) of rows (id, text) that stand by id within a partition; the last id of a piece waits for the next."""
    schema = T.StructType([T.StructField("term", T.StringType()), rows.schema["id"], T.StructField("tf", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        one = next(batches, None)
        if one is None:
            return
        kind, waiting, held = one.schema.field(0).type, None, Counter()

        def made(terms: pa.Array, ids: pa.Array, tf: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([terms, ids, pa.array(tf, pa.int64())], names=["term", "id", "tf"])

        def waited() -> pa.RecordBatch:
            return made(pa.array(held.keys(), pa.string()), pa.array([waiting] * len(held), kind), np.array([*held.values()], np.int64))

        for ids, texts in _pieces(chain([one], batches)):
            group = np.cumsum([0, *[a != b for a, b in zip(ids, ids[1:], strict=False)]])
            own = [ids[k] for k in np.searchsorted(group, np.arange(group[-1] + 1))]
            of, term, tf, terms = _grams(texts, group, n, stop_words)
            ends = [0, len(of)]
            if held and own[0] == waiting:
                ends[0] = int(np.searchsorted(of, 1))
                for t, m in zip(term[: ends[0]].tolist(), tf[: ends[0]].tolist(), strict=True):
                    held[terms[t]] += m
                if len(own) == 1:
                    continue
            if held:
                yield waited()
            ends[1] = int(np.searchsorted(of, len(own) - 1))
            if ends[1] > ends[0]:
                between = slice(*ends)
                yield made(pa.array(terms, pa.string()).take(pa.array(term[between])), pa.array(own, kind).take(pa.array(of[between])), tf[between])
            waiting, held = own[-1], Counter({terms[t]: m for t, m in zip(term[ends[1] :].tolist(), tf[ends[1] :].tolist(), strict=True)})
        if held:
            yield waited()

    return rows.mapInArrow(run, schema)


def inverted(df: DataFrame, id_col: str, text: str, ngram: int | None = None, stop_words: Sequence[str] = ()) -> DataFrame:
    """(term, id, tf): the inverted index of a text field.

    Texts are dealt by id, so that the terms of an id are counted where its texts
    are: only texts are shuffled, never their terms.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).repartition("id")
    if ngram is not None:
        return _gram_counts(rows.select("id", F.lower("text").alias("text")).sortWithinPartitions("id"), ngram, stop_words)
    terms = rows.select("id", F.explode(tokenized(F.col("text"), stop_words=stop_words)).alias("term"))
    return terms.groupBy("term", "id").agg(F.count("*").alias("tf"))


def document_frequencies(df: DataFrame, id_col: str, text: str, least: int = 1) -> DataFrame:
    """(term, df) of terms in at least so many documents."""
    terms = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokenized(F.col(text)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
