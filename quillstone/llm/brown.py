"""Brown class-based bigram language model.

Words are put into classes by exchange clustering: a word moves to the class that
raises the likelihood of the class bigrams most. The probability of a token is that
of its class after the class of the word before, times that of the word within its
class:

    p(w | v) = p(class(w) | history(v)) * (c(w) + ADD) / (C + ADD * (V + 1))

with C and V the tokens and distinct words of the class; one more word in each
class stands for all unknown ones, so the words' shares in a class sum to one.
Class transitions are smoothed towards the classes' own frequencies.

Clustering has two steps. The core clusters the CLUSTER_WORDS most frequent words, by
themselves, and groups of all other words by their ending (the CLUSTER_ENDINGS
most frequent endings, and one group for the rest) by their bigrams, one move at a time. That
gives every word, known or not, a class to begin with, and the class as which
it is looked back at: its history. Then every word of the training rows takes part by
itself: how often it follows each history is counted over all of them, and
TURNS groups of words, by hash, move in turn, each word to the class that raises the likelihood
most if that gains MOVE_COST at least (what naming a class costs). Within a turn the words are compared with the same
table of class bigrams, so a turn is one parallel pass over the words.

At scale: counts of words, of their histories and of cluster bigrams cover all training
rows and are shuffled as partial sums. The COMMON_WORDS most frequent words are broadcast
with their counts and classes, a bounded table; counts and classes of all other words
of a text are joined. Tables of cluster or class bigrams have a fixed size.

Defined results: null counts as the empty text, which is its end token; texts of every length are
scored whole; rows that repeat id and text are scored once and returned as often as they came; a null
id counts as the empty id in the split; of equally good classes the first is taken;
an empty table gives an empty one. Only the id and the text are read, so other columns do no harm.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, record_batch, shuffle_partitions, sliced

#: The end token: no word holds a blank.
END = b" "
ADD = 0.1
COMMON_WORDS = 300_000
CLUSTER_WORDS = 1024
CLUSTER_ENDINGS = 254
ENDING_BYTES = 3
CLASSES = 128
PASSES = 6
TURNS = 3
#: Counts up to here share the logarithms of a move.
FEW = 8
#: Least gain, as a natural logarithm, for which a word leaves the class it began in.
MOVE_COST = math.log(CLASSES)
#: Tokens a transition's class frequencies count for.
SMOOTHING = 10.0
#: Distinct words a task counts before it hands on partial sums.
HELD_WORDS = 400_000
#: Tokens, or entries of words' histories, that a task works on at once.
HELD_TOKENS = 1_000_000


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text in lower case (A-Z), without the end."""
    return (text or b"").lower().split()


def count_words(df: DataFrame, training: Column, text_col: str = "text") -> DataFrame:
    """(word binary, n) of the training rows' tokens, the end included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            batch = record_batch({"word": (list(held), pa.binary()), "n": (list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                held.update(tokens(text))
                held[END] += 1
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    texts = df.where(training).select(F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int = COMMON_WORDS) -> list[tuple[bytes, int]]:
    """The most frequent words, at most so many, by count; of equal counts all are in or out.

    A histogram of the counts' logarithms gives the least count to take, so no
    task sorts the vocabulary.
    """
    step = F.floor(16 * F.log2("n"))
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()  # under 1024 rows
    least, taken = math.inf, 0
    for r in sorted(sizes, reverse=True):
        taken += r["words"]
        if taken > most:
            break
        least = r["step"]
    chosen = counts.where((step >= least) | (F.col("word") == F.lit(END))).select("word", "n").toArrow() if sizes else None
    found = list(zip(chosen["word"].to_pylist(), chosen["n"].to_pylist())) if chosen is not None else []
    return sorted(found, key=lambda w: (-w[1], w[0]))


@dataclass(frozen=True)
class Clusters:
    """Which cluster a word is in: its own, its ending's, or the last; the end token's is 0."""

    words: dict[bytes, int]
    endings: dict[bytes, int]
    size: int

    def of(self, word: bytes) -> int:
        found = self.words.get(word)
        return self.endings.get(word[-ENDING_BYTES:], self.size - 1) if found is None else found


def clusters(common: list[tuple[bytes, int]], endings: list[bytes]) -> Clusters:
    own = {END: 0}
    for word, _ in common:
        if len(own) > CLUSTER_WORDS:
            break
        own.setdefault(word, len(own))
    ends = {ending: len(own) + k for k, ending in enumerate(endings)}
    return Clusters(own, ends, len(own) + len(ends) + 1)


def frequent_endings(counts: DataFrame) -> list[bytes]:
    """The most frequent endings of words, by tokens: a bounded list."""
    ending = F.when(F.length("word") > ENDING_BYTES, F.expr(f"substring(word, -{ENDING_BYTES}, {ENDING_BYTES})")).otherwise(F.col("word"))
    top = counts.where(F.col("word") != F.lit(END)).groupBy(ending.alias("ending")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(CLUSTER_ENDINGS)
    return [bytes(r["ending"]) for r in top.collect()]


class Lookup(dict):
    """Cluster ids of words; the common words' are kept in one table, others' are looked up each time."""

    def __init__(self, groups: Clusters, common: Iterable[bytes]):
        super().__init__((w, groups.of(w)) for w in common)
        self.groups = groups

    def __missing__(self, word: bytes) -> int:
        return self.groups.of(word)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The tokens of the texts of the first column, whole texts, each with its end, of about HELD_TOKENS at a time."""
    held: list[bytes] = []
    for batch in sliced(batches):
        for text in batch.column(0).to_pylist():
            held += tokens(text)
            held.append(END)
            if len(held) > HELD_TOKENS:
                yield held
                held = []
    if held:
        yield held


def bigram_counts(df: DataFrame, training: Column, groups: Clusters, common: list[tuple[bytes, int]], text_col: str = "text") -> np.ndarray:
    """How often each cluster follows each other one in the training rows: a matrix of fixed size."""
    size = groups.size
    held = df.sparkSession.sparkContext.broadcast((groups, [w for w, _ in common]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(*held.value)
        total = np.zeros(size * size, np.int64)
        for words in _streams(batches):
            path = lookup.ids(words)
            before = np.concatenate([[0], path[:-1]])  # a text begins after the end of another, cluster 0
            total += np.bincount(before * size + path, minlength=len(total))
        at = np.nonzero(total)[0]
        yield record_batch({"pair": (at.astype(np.int32), pa.int32()), "n": (total[at], pa.int64())})

    texts = df.where(training).select(F.col(text_col).cast("binary").alias("text"))
    sums = texts.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(size * size)
    found = sums.toArrow()
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def histories(df: DataFrame, training: Column, groups: Clusters, classes: np.ndarray, common: list[tuple[bytes, int]], text_col: str = "text") -> DataFrame:
    """(word, history, n) of the training rows, the rows of a word together: how often it follows each history class."""
    held = df.sparkSession.sparkContext.broadcast((groups, classes, [w for w, _ in common]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, classes, common = held.value
        number = {w: k for k, w in enumerate(common)}
        words = pa.array(common, pa.binary())
        of_common = classes[np.fromiter(map(groups.of, common), np.int64, len(common))] if common else np.zeros(0, np.int64)
        find = number.get
        for flat in _streams(batches):
            ids = np.fromiter(map(find, flat, repeat(-1)), np.int64, len(flat))
            rare = np.nonzero(ids < 0)[0]
            others = [flat[k] for k in rare.tolist()]
            path = np.zeros(len(ids), np.int64)
            path[ids >= 0] = of_common[ids[ids >= 0]]
            path[rare] = classes[np.fromiter(map(groups.of, others), np.int64, len(others))]
            before = np.concatenate([[0], path[:-1]])  # a text begins after the end of another, class 0
            pairs, n = np.unique(ids[ids >= 0] * CLASSES + before[ids >= 0], return_counts=True)
            yield record_batch({"word": (words.take(pa.array(pairs // CLASSES)), None), "history": (pairs % CLASSES, pa.int32()), "n": (n, pa.int64())})
            counted = Counter(zip(others, before[rare].tolist()))
            if counted:
                names, at = zip(*counted)
                yield record_batch({"word": (list(names), pa.binary()), "history": (list(at), pa.int32()), "n": (list(counted.values()), pa.int64())})

    texts = df.where(training).select(F.col(text_col).cast("binary").alias("text"))
    n = shuffle_partitions(df.sparkSession)
    return texts.mapInArrow(run, "word binary, history int, n long").repartition(n, "word").groupBy("word", "history").agg(F.sum("n").alias("n")).sortWithinPartitions("word", "history")


def _gain(counts: np.ndarray) -> np.ndarray:
    """n log n, with 0 for none."""
    return counts * np.log(np.maximum(counts, 1.0))


def exchange(bigrams: np.ndarray, n_classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each cluster, by exchange clustering of the bigram counts; cluster 0 keeps class 0 alone.

    Starts with the most frequent clusters in turn; ends when a pass moves none.
    """
    size = len(bigrams)
    left, right = bigrams.sum(axis=1), bigrams.sum(axis=0)
    order = [int(i) for i in np.argsort(-(left + right), kind="stable") if i]
    n_classes = max(2, min(n_classes, size))
    of = np.zeros(size, np.int64)
    for k, i in enumerate(order):
        of[i] = 1 + k % (n_classes - 1)
    member = np.zeros((size, n_classes))
    member[np.arange(size), of] = 1.0
    table = member.T @ bigrams @ member
    ahead, behind = bigrams @ member, bigrams.T @ member  # word to class, class to word
    rows, columns = table.sum(axis=1), table.sum(axis=0)

    for _ in range(passes):
        moved = 0
        for i in order:
            was = of[i]
            out, into, self_n = ahead[i].copy(), behind[i].copy(), bigrams[i, i]
            # take the cluster out of its class
            table[was] -= out
            table[:, was] -= into
            table[was, was] += self_n
            rows[was] -= left[i]
            columns[was] -= right[i]
            out[was] -= self_n
            into[was] -= self_n
            # likelihood gained by putting it into each class: only that class's row and column change
            change = (_gain(table + out) - _gain(table)).sum(axis=1) + (_gain(table.T + into) - _gain(table.T)).sum(axis=1)
            own = np.diagonal(table)
            change += _gain(own + out + into + self_n) - _gain(own + out) - _gain(own + into) + _gain(own)
            change -= _gain(rows + left[i]) - _gain(rows) + _gain(columns + right[i]) - _gain(columns)
            change[0] = -np.inf
            now = int(np.argmax(change)) if change.max() > change[was] + 1e-9 * abs(change[was]) else int(was)
            table[now] += out
            table[:, now] += into
            table[now, now] += self_n
            rows[now] += left[i]
            columns[now] += right[i]
            if now != was:
                moved += 1
                of[i] = now
                ahead[:, was] -= bigrams[:, i]
                ahead[:, now] += bigrams[:, i]
                behind[:, was] -= bigrams[i]
                behind[:, now] += bigrams[i]
        if not moved:
            break
    return of


def class_table(bigrams: np.ndarray, of: np.ndarray, n: int = CLASSES) -> np.ndarray:
    """How often each class follows each other one."""
    member = np.zeros((len(of), n))
    member[np.arange(len(of)), of] = 1.0
    return member.T @ bigrams @ member


def moved(table: np.ndarray, owner: np.ndarray, history: np.ndarray, n: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The best class of each word, given the class it is in, its histories, and the table of class bigrams.

    owner, history, n: entries of the words' histories, by word in order. Every word is taken out of its
    class in turn for itself; class 0 is the end token's alone.
    """
    words = np.arange(len(of))
    starts = np.searchsorted(owner, words)
    own, c = of[owner], n[:, None].astype(np.float64)
    now = _gain(table)
    change = np.empty((len(owner), len(table)))
    for few in range(1, FEW + 1):  # most entries are small counts, whose changes are rows of one table
        these = n == few
        change[these] = (_gain(table + few) - now)[history[these]]
    these = n > FEW
    change[these] = _gain(table[history[these]] + c[these]) - now[history[these]]
    held = table[history, own]
    change[np.arange(len(owner)), own] = _gain(held) - _gain(held - n)
    gain = np.add.reduceat(change, starts, axis=0)
    total = np.add.reduceat(n, starts).astype(np.float64)
    sums = table.sum(axis=0)
    cost = _gain(sums + total[:, None]) - _gain(sums)
    cost[words, of] = _gain(sums[of]) - _gain(sums[of] - total)
    gain -= cost
    gain[:, 0] = -np.inf
    best = gain.argmax(axis=1)
    stay = (of == 0) | (gain[words, best] - gain[words, of] <= MOVE_COST)
    return np.where(stay, of, best)


def turn_of(word: Column) -> Column:
    """The turn in which a word may move."""
    return F.pmod(F.xxhash64(word), F.lit(TURNS)).cast("int")


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, owner, history, n) of whole words, a batch at a time, from (word, history, n) rows by word."""
    rest = None
    for batch in batches:
        table = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not table.num_rows:
            continue
        word = table.column(0)
        new = np.append(True, pa.compute.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)) if len(word) > 1 else np.array([True])
        whole = int(np.nonzero(new)[0][-1])  # the last word may go on in the next batch
        rest = table.slice(whole)
        if whole:
            yield _entries(table.slice(0, whole), new[:whole])
    if rest is not None:
        yield _entries(rest, np.arange(rest.num_rows) == 0)


def _entries(table: pa.RecordBatch, new: np.ndarray):
    at = np.nonzero(new)[0]
    return table.column(0).take(pa.array(at)), np.cumsum(new) - 1, table.column(1).to_numpy().astype(np.int64), table.column(2).to_numpy()


def spread_classes(follows: DataFrame, groups: Clusters, classes: np.ndarray, table: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(word, n, class) of every word of histories(), after each has had its turn, and the table of class bigrams then.

    The rows of a turn are kept; beside the words it leaves what each task has changed in the table,
    in rows without a word.
    """
    context = follows.sparkSession.sparkContext
    held = context.broadcast((groups, classes))
    members = None

    for turn in range(TURNS):
        now = context.broadcast(table)

        def change(batches: Iterable[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            groups, classes = held.value
            total = np.zeros(CLASSES * CLASSES, np.int64)
            for words, owner, history, n in _words(batches):
                was = classes[np.fromiter(map(groups.of, words.to_pylist()), np.int64, len(words))]
                of = moved(now.value, owner, history, n, was)
                for sign, k in ((1, of), (-1, was)):
                    total += sign * np.bincount(history * CLASSES + k[owner], weights=n, minlength=len(total)).astype(np.int64)
                yield record_batch({"word": (words, None), "n": (np.bincount(owner, weights=n).astype(np.int64), pa.int64()), "class": (of, pa.int32()), "pair": (pa.nulls(len(words), pa.int32()), None)})
            at = np.nonzero(total)[0]
            yield record_batch({"word": (pa.nulls(len(at), pa.binary()), None), "n": (total[at], pa.int64()), "class": (pa.nulls(len(at), pa.int32()), None), "pair": (at, pa.int32())})

        done = durable(follows.where(turn_of(F.col("word")) == turn).mapInArrow(change, "word binary, n long, class int, pair int"))
        sums = done.where(F.col("word").isNull()).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
        table = table.copy()
        table.ravel()[sums["pair"].to_numpy()] += sums["n"].to_numpy()
        part = done.where(F.col("word").isNotNull()).select("word", "n", "class")
        members = part if members is None else members.unionByName(part)
    return members, table


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 of the smoothed probability of each class after each class."""
    n = len(table)
    share = (table.sum(axis=0) + 1.0) / (table.sum() + n)
    return np.log10((table + SMOOTHING * share) / (table.sum(axis=1, keepdims=True) + SMOOTHING))


@dataclass(frozen=True)
class Model:
    """Everything a task needs: bounded in size whatever the corpus.

    common: the most frequent words with their counts and classes. classes: of clusters, as which words are
    looked back at. steps: log10 of a class after a history.
    """

    groups: Clusters
    classes: np.ndarray
    steps: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    common: list[tuple[bytes, int, int]]
    train_tokens: int
    train_words: int

    def class_denominators(self) -> np.ndarray:
        return self.class_tokens + ADD * (self.class_words + 1)

    def moves(self) -> np.ndarray:
        """log10 of a class after a history, less the size of the class: what a token has beside its own count."""
        return self.steps - np.log10(self.class_denominators())


def train(df: DataFrame, training: Column, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model, and (word, n, class) of all words, which stays distributed."""
    counts = durable(count_words(df, training, text_col))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    common = common_words(counts)
    groups = clusters(common, frequent_endings(counts))
    bigrams = bigram_counts(df, training, groups, common, text_col)
    classes = exchange(bigrams)
    follows = durable(histories(df, training, groups, classes, common, text_col))
    members, table = spread_classes(follows, groups, classes, class_table(bigrams, classes))
    sums = members.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # one row for each class
    by = {r["class"]: (r["n"], r["v"]) for r in sums}
    class_tokens, class_words = (np.array([by.get(k, (0, 0))[j] for k in range(CLASSES)], np.float64) for j in (0, 1))
    least = min((n for w, n in common if w != END), default=0)
    found = members.where((F.col("n") >= least) | (F.col("word") == F.lit(END))).toArrow() if common else None
    known = sorted(zip(*[found[c].to_pylist() for c in ("word", "n", "class")])) if found is not None else []
    return Model(groups, classes, transitions(table), class_tokens, class_words, known, int(totals["n"]), int(totals["v"])), members


def score(df: DataFrame, model: Model, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, perplexity) of every row.

    A task adds up what the broadcast table covers and lists the other words with their
    histories; their counts and classes come by a join on the word, and the sums meet by row.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(model)
    base = math.log10(model.train_tokens + ADD * (model.train_words + 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        moves = m.moves()
        number = {w: k for k, (w, _, _) in enumerate(m.common)}
        history = m.classes[np.array([m.groups.of(w) for w, _, _ in m.common] or [0], np.int64)]
        of_common = np.array([k for _, _, k in m.common] or [0], np.int64)
        logs = np.log10(np.array([n for _, n, _ in m.common] or [1], np.float64) + ADD)
        end = number.get(END)
        end_log = logs[end] if end is not None else math.log10(ADD)
        find = number.get
        for batch in sliced(batches):
            out: list[tuple] = []
            for doc, key, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                words = tokens(text)
                at = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
                rare = np.nonzero(at < 0)[0]
                other = [words[k] for k in rare.tolist()]
                back = history[at]
                back[rare] = m.classes[np.fromiter(map(m.groups.of, other), np.int64, len(other))]
                before = np.concatenate([[0], back])
                here = at >= 0
                emitted = float(logs[at[here]].sum()) + end_log
                steps = float(moves[before[:-1][here], of_common[at[here]]].sum()) + float(moves[before[-1], 0])
                times = Counter(zip(other, before[:-1][rare].tolist(), back[rare].tolist()))
                names, ats, falls = zip(*times) if times else ((), (), ())
                out.append((
                    len(words) + 1, int(here.sum()) + (end is not None), emitted - base * (len(words) + 1), emitted + steps,
                    [b" %s %d" % (str(doc).encode(), key), *names], [0, *ats], [0, *falls], [0, *times.values()],
                ))
            columns = list(zip(*out)) if out else [()] * 8
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            names = ("n_tokens", "n_known", "base_score", "score", "words", "histories", "falls", "times")
            yield record_batch({"doc_id": (batch.column(0), None), "key": (batch.column(1), None)} | {n: (list(c), t) for n, c, t in zip(names, columns, types)})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
    parts = rows.mapInArrow(run, "doc_id long, key long, n_tokens long, n_known long, base_score double, score double, words array<binary>, histories array<int>, falls array<int>, times array<long>")
    # a row's own sums go with a first entry that is no word (it holds blanks), so they meet the join evenly
    own = ["n_tokens", "n_known", "base_score", "score"]
    spread = parts.select("doc_id", "key", *own, F.explode(F.arrays_zip("words", "histories", "falls", "times")).alias("w"))
    spread = spread.select("doc_id", "key", F.col("w.words").alias("word"), F.col("w.histories").alias("history"), F.col("w.falls").alias("fall"), F.col("w.times").alias("times"), *[F.when(F.col("w.times") == 0, F.col(c)).alias(c) for c in own])
    # an unknown word has the class of its ending; the moves are a table of CLASSES squared, by place
    looked = spread.join(members.select("word", F.col("n").alias("c"), "class"), "word", "left").withColumn("at", F.col("history") * CLASSES + F.coalesce("class", "fall"))
    moves = spark.createDataFrame([(k, v) for k, v in enumerate(model.moves().ravel().tolist())], "at int, move double")
    looked = looked.join(F.broadcast(moves), "at")
    emitted = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))
    sums = looked.groupBy("doc_id", "key").agg(
        F.count("n_tokens").alias("copies"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0))).alias("n_known"),
        (F.sum("base_score") + F.sum(emitted)).alias("base_score"),
        (F.sum("score") + F.sum(emitted + F.col("times") * F.col("move"))).alias("score"),
    )
    each = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    each = each.select("doc_id", *[(F.col(c) / F.col("copies")).cast(t).alias(c) for c, t in zip(own, ("long", "long", "double", "double"))])
    return each.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
