"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are compared exactly: distinct fingerprints are cut into tiles of
one population count each, tile pairs whose counts differ by more than the
radius are never formed, and the rest are compared in numpy blocks by
exclusive-or and bit count. Each tile pair emits a spanning forest of its links,
so a group of n mutually similar fingerprints costs at most n rows per tile
pair. The comparison stays quadratic in the number of distinct fingerprints
(about a tenth of all pairs are really formed); the README gives figures.

Defined results: null and empty texts have fingerprint zero and link like any
other; texts of every length are read whole; repeated rows are returned once
each; equal ids are told apart by nothing but their fingerprints; a null id never
becomes a component's id unless all ids of the component are null; an empty table
gives an empty one. Only the id and the text are read, so other columns, of
whatever name, do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, join_unique, record_batch, shuffle_partitions, sliced

SEED = 42
#: Most fingerprints in a tile (256 KB), and in a block of a comparison.
TILE_ROWS = 32768
BLOCK_ROWS = 256
#: Links held in a task before they are reduced to a spanning forest.
LINKS_HELD = 1 << 20
_BITS_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes | None, width: int, seed: int) -> tuple[bytes, list[int]]:
    """The text's words, lower-cased and joined by a space, and the hash of each of their shingles."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return joined, [digest(joined, seed)] if words else []
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return joined, [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 without words."""
    _, hashes = shingle_hashes(text, width, SEED)
    if not hashes:
        return 0
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(packed), _BITS_AT_ONCE):
        ones += np.unpackbits(packed[at : at + _BITS_AT_ONCE], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp bigint) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            values = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield record_batch({"doc_id": (batch.column(0), None), "fp": (values.view(np.int64), pa.int64())})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def spanning_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links u-v connect it with."""
    labels = np.arange(n)
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        np.minimum.at(labels, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while not np.array_equal(nearer := labels[labels], labels):
            labels = nearer


def _blocks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[slice]]:
    """The order of fingerprints (a row of 64-bit words each) by the bit counts of their quarters; the
    fingerprints in it; the least and greatest counts in each block; the blocks."""
    counts = np.bitwise_count(np.ascontiguousarray(values).view("<u2")).reshape(len(values), 4, -1).sum(axis=2, dtype=np.int16)
    order = np.lexsort(counts.T)
    values, counts = np.ascontiguousarray(values[order]), counts[order]
    cuts = [slice(a, min(a + BLOCK_ROWS, len(values))) for a in range(0, len(values), BLOCK_ROWS)]
    return order, values, np.array([counts[c].min(axis=0) for c in cuts]), np.array([counts[c].max(axis=0) for c in cuts]), cuts


def _near(a: np.ndarray, b: np.ndarray, radius: int, first: int) -> np.ndarray:
    """Which rows of a are within radius of which of b; the first words alone differ in at most `first` bits."""
    near = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) <= first
    if a.shape[1] > 1:
        x, y = np.nonzero(near)
        near[x, y] = np.bitwise_count(a[x] ^ b[y]).sum(axis=1) <= radius
    return near


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within radius between two tiles (right None: within one), as places in left then right."""
    order_a, a, low_a, high_a, cuts_a = _blocks(left)
    order_b, b, low_b, high_b, cuts_b = (order_a, a, low_a, high_a, cuts_a) if right is None else _blocks(right)
    places, shift = (order_a, 0) if right is None else (np.concatenate([order_a, order_b + len(left)]), len(a))
    gap = np.zeros((len(cuts_a), len(cuts_b)), np.int16)
    for k in range(4):
        gap += np.maximum(0, np.maximum(low_a[:, None, k] - high_b[None, :, k], low_b[None, :, k] - high_a[:, None, k]))
    us, vs, held = [], [], 0
    for i, j in zip(*np.nonzero(gap <= radius)):
        if right is None and j < i:
            continue
        near = _near(a[cuts_a[i]], b[cuts_b[j]], radius, radius if first is None else first)
        if right is None and i == j:
            near = np.triu(near, 1)
        if near.any():
            x, y = np.nonzero(near)
            us.append(x + cuts_a[i].start)
            vs.append(y + cuts_b[j].start + shift)
            held += len(x)
            if held > LINKS_HELD:
                labels = spanning_labels(len(places), np.concatenate(us), np.concatenate(vs))
                own = np.nonzero(labels != np.arange(len(places)))[0]
                us, vs, held = [own], [labels[own]], len(own)
    if not us:
        return places[:0], places[:0]
    labels = spanning_labels(len(places), np.concatenate(us), np.concatenate(vs))
    own = np.nonzero(labels != np.arange(len(places)))[0]
    return places[own], places[labels[own]]


def links(distinct: DataFrame, radius: int = 4, fp: str = "fp", words: str | None = None, n_words: int = 1, first: int | None = None) -> DataFrame:
    """(u, v) links that connect the fingerprints of a frame of distinct ones within radius.

    A fingerprint is the bigint fp or, if words names an array of n_words bigints, that
    array, which fp then only names; first bounds the bits in which the first words differ. The links are a
    spanning forest for each pair of tiles: they connect exactly what the full
    set of pairs connects. Pairs of tiles are dealt to tasks in turn, and a
    tile is sent once for each pair, so a task never holds many more than others.
    """
    spark, first_bits = distinct.sparkSession, first
    step = max(1, radius // 4)  # population counts in a band of tiles
    reach, most = (radius - 1) // step + 1 if radius else 0, 64 * n_words // step
    bits = F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w)) if words else F.bit_count(fp)
    counted = distinct.select(F.struct(F.col(fp).alias("node"), (F.col(words) if words else F.array(fp)).alias("words")).alias("fp"), F.floor(bits / step).cast("int").alias("pop"))
    histogram = dict(counted.groupBy("pop").count().collect())  # at most 64 * n_words + 1 rows
    parts = [math.ceil(histogram.get(p, 0) / TILE_ROWS) for p in range(most + 1)]
    first = np.cumsum([0, *parts]).tolist()  # tile of each band
    low, high = [first[max(0, p - reach)] for p in range(most + 1)], [first[min(most, p + reach) + 1] - 1 for p in range(most + 1)]
    lows = np.repeat(low, parts)
    ends = np.cumsum(np.arange(len(lows)) - lows + 1)  # pairs of each tile with itself and those before it in reach, added up
    starts = (ends - np.arange(len(lows)) - 1).tolist()

    def entry(values: list[int], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values or [0]]), at + 1)

    placed = counted.withColumn("tile", entry(first, F.col("pop")) + F.pmod(F.xxhash64("fp.node"), entry(parts, F.col("pop"))).cast("int"))
    tiles = placed.groupBy("pop", "tile").agg(F.collect_list("fp").alias("fps"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(entry(low, F.col("pop")), entry(high, F.col("pop")))))
    # pairs are numbered without gaps and dealt in turn, so that tasks hold as many each
    pair = entry(starts, F.greatest("tile", "other")) + F.least("tile", "other")
    n = max(1, min(shuffle_partitions(spark), int(ends[-1]) if len(ends) else 0))
    paired = tiles.select(pair.alias("pair"), "tile", (F.col("tile") == F.col("other")).alias("own"), "fps").withColumn("task", F.pmod("pair", F.lit(n)))
    paired = paired.repartitionById(n, "task").sortWithinPartitions("pair", "tile").select("pair", "own", "fps")

    def arrays(tile: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nodes, values = tile.flatten()
        return nodes.to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(nodes), n_words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first tile of a pair
        for batch in batches:
            for k, (pair, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                nodes, a = arrays(batch.column(2)[k].values)
                b = None
                if not own:
                    if held is None or held[0] != pair:
                        held = pair, nodes, a
                        continue
                    (_, before, a), b = held, a
                    nodes, held = np.concatenate([before, nodes]), None
                u, v = tile_links(a, b, radius, first_bits)
                if len(u):
                    yield record_batch({"u": (nodes[u], pa.int64()), "v": (nodes[v], pa.int64())})

    return paired.mapInArrow(run, "u long, v long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node reachable.

    Alternates large-star and small-star steps, each an aggregation and a join,
    until the edges are stars. Every round is checkpointed.
    """

    def smaller(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    now = durable(smaller(edges))
    seen = mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(smaller(small.union(least.select("u", "m"))))
        before, seen = seen, mark(now)
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable over links."""
    rows = durable(fingerprints(df, id_col, text_col, width))
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = durable(connected(links(distinct, radius)))
    rooted = distinct.drop("n").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = durable(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
    of = join_unique(rooted.select("fp", "root"), smallest.drop("n"), "root", smallest).select("fp", "component_id")
    return join_unique(rows, of, "fp", distinct).select("doc_id", "fp", "component_id")
