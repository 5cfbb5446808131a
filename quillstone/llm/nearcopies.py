"""The SimHash operator as a stage: near copies of five-word shingles and similarity 0.8 or more.

Texts of the same words are folded first. Each text that is left has a fingerprint of
WORDS times 64 SimHash bits over the set of its shingles. The tiled exact comparison of
the simhash module links fingerprints within RADIUS bits: a pair with a Jaccard
index of 0.8 differs in 39 bits on average, standard deviation 5.7, so that the
radius misses about one pair at the boundary in 1,200, and unrelated texts (128
bits, 8) are never linked by chance. Texts that links connect are candidates for one another;
only pairs with a Jaccard index of LEAST or more, computed exactly, are connected.

A group of up to GROUP_ROWS candidates is one task's work. In a larger one
a few members (pivots) are compared with all members first, then every member
that is not connected with most of the group, in blocks of QUERY_ROWS that are
sent to the tasks which stream the group: exact too, no task
holds the group, and for a group of true copies the work is in proportion to its size.

Defined results: texts without words are all alike; fewer words than a shingle
has make one shingle; whole texts are read; an empty table gives an empty one; a null
id names no document. Of a group the row with the smallest id stays, then the one
with the smallest hash of its words, then of its text; of rows that repeat both id
and text, the one whose columns as JSON sort first. Rows that share an id and
belong to different groups stay apart. Columns keep their names and order, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, join_unique, record_batch, shuffle_partitions, sliced
from .simhash import connected, links, shingle_hashes, spanning_labels

WIDTH = 5
LEAST = 0.8
WORDS = 4
RADIUS = 57
#: Bits in which the first words of a pair differ at most (a pair of 0.8: 9.7 on average, standard deviation 2.9).
FIRST = 20
SEED = 43
GROUP_ROWS = 1000
PIVOTS = 16
QUERY_ROWS = 1000
_AT_ONCE = 1 << 14
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes | None) -> tuple[int, np.ndarray]:
    """A hash of the text's words, and the sorted hashes of its shingles."""
    joined, hashes = shingle_hashes(text, WIDTH, SEED)
    return xxhash.xxh64_intdigest(joined, SEED + 1), np.unique(np.array(hashes or [xxhash.xxh64_intdigest(b"", SEED)], np.uint64))


def wide(found: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles: WORDS words, the bits of each from a mixing of its own."""
    out = np.zeros((WORDS, 64), np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(found), _AT_ONCE):
            h = found[at : at + _AT_ONCE]
            for k in range(WORDS):
                if k:
                    h = (h ^ (h >> np.uint64(32))) * _MIX
                    h ^= h >> np.uint64(29)
                out[k] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(out * 2 > len(found), axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have a Jaccard index of LEAST or more."""
    if min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= LEAST * (len(a) + len(b) - both)


def bits_apart(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints ^ one).sum(axis=1)


def components(sets: list[np.ndarray], prints: np.ndarray) -> np.ndarray:
    """For each set the least place of those it is connected with, over alike pairs within RADIUS."""
    labels = np.arange(len(sets))
    for i in range(1, len(sets)):
        apart = bits_apart(prints[:i], prints[i])
        near = np.nonzero(apart <= RADIUS)[0]
        near = near[np.argsort(apart[near], kind="stable")]
        while len(near := near[labels[near] != labels[i]]):
            j, near = near[0], near[1:]
            if alike(sets[i], sets[j]):
                a, b = sorted((labels[i], labels[j]))
                labels[: i + 1][labels[: i + 1] == b] = a
    return labels


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, raw, content, words) of every row: its text's hash, the hash of its words, its fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            content, words = [], []
            for text in batch.column(2).to_pylist():
                h, found = shingles(text)
                content.append(h)
                words.append(wide(found).view(np.int64))
            yield record_batch({"doc_id": (batch.column(0), None), "raw": (batch.column(1), None), "content": (np.array(content, np.uint64).view(np.int64), pa.int64()), "words": (words, pa.list_(pa.int64()))})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("raw"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, raw long, content long, words array<long>")


def _of_small_groups(texts: DataFrame) -> DataFrame:
    """(u, v) that connect the contents of each root, from (root, content, text): a forest; a group is one task's work."""

    def group(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        order = np.array(sorted(held), np.int64)
        sets = [held[c] for c in order.tolist()]
        labels = components(sets, np.array([wide(s) for s in sets]))
        own = np.nonzero(labels != np.arange(len(order)))[0]
        return record_batch({"u": (order[own], pa.int64()), "v": (order[labels[own]], pa.int64())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in sliced(batches):
            for root, content, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if root != now:
                    if held:
                        yield group(held)
                    now, held = root, {}
                held[content] = shingles(text)[1]
        if held:
            yield group(held)

    n = shuffle_partitions(texts.sparkSession)
    return texts.select("root", "content", "text").repartition(n, "root").sortWithinPartitions("root").mapInArrow(run, "u long, v long")


def _against(texts: DataFrame, queries: list[tuple[int, int, bytes]]) -> DataFrame:
    """(u, v): members of large groups alike to queries (root, content, text) of their group, one link for each member and component of queries."""
    by: dict[int, tuple[list[int], list[np.ndarray], np.ndarray]] = {}
    for root in {q[0] for q in queries}:
        own = [q for q in queries if q[0] == root]
        sets = [shingles(text)[1] for _, _, text in own]
        by[root] = [c for _, c, _ in own], sets, np.array([wide(s) for s in sets])
    held = texts.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            us, vs = [], []
            for root, content, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if root not in held.value:
                    continue
                contents, sets, prints = held.value[root]
                _, found = shingles(text)
                for j in np.nonzero(bits_apart(prints, wide(found)) <= RADIUS)[0].tolist():
                    if contents[j] != content and alike(found, sets[j]):
                        us.append(content)
                        vs.append(contents[j])
            if us:
                labels = np.unique(np.array([us, vs]), return_inverse=True)
                u, v = labels[1].reshape(2, -1)
                to = spanning_labels(len(labels[0]), u, v)
                own = np.nonzero(to != np.arange(len(to)))[0]
                yield record_batch({"u": (labels[0][own], pa.int64()), "v": (labels[0][to[own]], pa.int64())})

    return texts.select("root", "content", "text").mapInArrow(run, "u long, v long")


def _of_large_groups(texts: DataFrame) -> DataFrame:
    """(u, v) that connect the contents of each root, from (root, content, text), for groups beyond one task."""
    smallest = texts.groupBy("root").agg(F.expr(f"slice(array_sort(collect_set(case when pmod(xxhash64(content), 64) = 0 then content end)), 1, {PIVOTS})").alias("some"), F.min("content").alias("least"))
    pivots = smallest.select("root", F.explode(F.array_union("some", F.array("least"))).alias("content"))
    asked = texts.join(pivots, ["root", "content"], "left_semi").select("root", "content", "text")
    edges = durable(_blocks_against(texts, asked))
    rooted = connected(edges)
    members = texts.select("root", "content").join(rooted.select(F.col("node").alias("content"), F.col("root").alias("part")), "content", "left").withColumn("part", F.coalesce("part", "content"))
    sizes = members.groupBy("root", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("root").agg(F.max_by("part", F.struct("n", "part")).alias("part"))
    outside = durable(members.join(largest, ["root", "part"], "left_anti").select("content"))
    return edges.union(_blocks_against(texts, texts.join(outside, "content", "left_semi").select("root", "content", "text")))


def _blocks_against(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """_against() for every row of asked, one bounded block of queries after another."""
    asked = durable(asked)
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    found = None
    for k in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("content"), F.lit(blocks)) == k)
        part = durable(_against(texts, [tuple(r) for r in block.collect()]))  # about QUERY_ROWS rows
        found = part if found is None else found.union(part)
    return found


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows' sketches, and (content, first, group): the first row of each content, as (doc_id, raw, n), and the content's group."""
    rows = durable(sketches(df, id_col, text_col))
    each = rows.groupBy("content", "doc_id", "raw").agg(F.count("*").alias("n"), F.min("words").alias("words"))
    distinct = durable(each.groupBy("content").agg(F.min(F.struct("doc_id", "raw", "n")).alias("first"), F.min("words").alias("words")))
    coarse = connected(links(distinct, RADIUS, "content", "words", WORDS, FIRST))
    grouped = durable(coarse.union(coarse.select("root", "root")).distinct().withColumnRenamed("node", "content"))
    members = distinct.select("content", "first.doc_id", "first.raw").join(grouped, "content")
    sizes = durable(grouped.groupBy("root").agg(F.count("*").alias("n")))
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("raw"), F.col(text_col).cast("binary").alias("text"))
    # rows that repeat id and text are one content: any of them has its text
    texts = texts.join(members, ["doc_id", "raw"]).select("root", "content", "text")
    large = [r[0] for r in sizes.where(F.col("n") > GROUP_ROWS).select("root").collect()]  # a few, for each has thousands of texts
    edges = _of_small_groups(texts.where(~F.col("root").isin(large)) if large else texts)
    if large:
        edges = edges.union(_of_large_groups(durable(texts.where(F.col("root").isin(large)))))
    found = connected(edges)
    joined = distinct.select("content", "first").join(found.withColumnRenamed("node", "content"), "content", "left")
    return rows, joined.select("content", "first", F.coalesce("root", "content").alias("group"))


def near_copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row; component_id is the smallest id it is connected with."""
    rows, of = near_copies(df, id_col, text_col)
    smallest = durable(of.groupBy("group").agg(F.min("first.doc_id").alias("component_id"), F.count("*").alias("n")))
    each = join_unique(of.select("content", "group"), smallest.drop("n"), "group", smallest).select("content", "component_id")
    return join_unique(rows.select("doc_id", "content"), each, "content", rows.groupBy("content").agg(F.count("*").alias("n"))).select("doc_id", "component_id")


def one_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that represent their group of near copies; which one is stated above. Rows with a null id stay."""
    named = df.where(F.col(f"`{id_col}`").isNotNull())
    _, of = near_copies(named, id_col, text_col)
    firsts = of.groupBy("group").agg(F.min(F.struct("first.doc_id", "content", "first.raw", "first.n")).alias("r"))
    kept = durable(firsts.select("r.doc_id", "r.raw", "r.n"))
    rows = named.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("raw"))
    alone = rows.join(kept.where("n = 1"), ["doc_id", "raw"], "left_semi").select("row")
    repeated = rows.join(kept.where("n > 1"), ["doc_id", "raw"], "left_semi")
    chosen = repeated.groupBy("doc_id", "raw").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    found = alone.unionByName(chosen).select(*[F.col("row").getField(c).alias(c) for c in df.columns])
    return found.unionByName(df.where(F.col(f"`{id_col}`").isNull()))
