"""Helpers shared by the text operators: reading, splitting of training rows, durable cuts of lineage."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Leading bits of a hash that a histogram tells apart.
SLOT_BITS = 14

#: Rows of an Arrow batch that are worked on at once. Spark bounds the bytes of a batch
#: (spark.sql.execution.arrow.maxBytesPerBatch); this bounds the Python objects made of it.
SLICE_ROWS = 512

#: The white space that separates words, as Spark's translate() takes it.
WORD_SPACE = "\t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, SLICE_ROWS at most at a time, without copying them."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir; only a local session without one (as in tests) uses
    a folder beneath its warehouse.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def durable(df: DataFrame) -> DataFrame:
    """The frame cut from its lineage by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def smallest_by_hash(df: DataFrame, group: str, per_group: int, key: Column) -> DataFrame:
    """Of each group the per_group rows with the smallest key; rows without a group are left out.

    A histogram of the keys' leading bits, of bounded size for each group, tells up
    to where the wanted rows lie. Only rows up to there reach the window, so what
    one task gets does not grow with the rows or tasks of a large group.
    """
    keyed = df.where(F.col(group).isNotNull()).withColumn("_pick", key)
    slot = F.shiftright("_pick", 64 - SLOT_BITS).cast("int")
    taken: Counter = Counter()
    last: dict = {}
    for value, at, n in sorted(tuple(r) for r in keyed.groupBy(group, slot.alias("_slot")).count().collect()):
        if taken[value] < per_group:
            last[value] = at
        taken[value] += n
    if not last:
        return df.where(F.lit(False))
    ends = F.create_map(*[F.lit(x) for entry in last.items() for x in entry])
    order = Window.partitionBy(group).orderBy("_pick", *[c for c in df.columns if c != group][:1])
    near = keyed.where(slot <= F.element_at(ends, F.col(group)))
    return near.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_group).drop("_pick", "_rank")


def join_unique(rows: DataFrame, table: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """rows joined with a table in which every key occurs once; keys with very many rows do not meet in one task.

    sizes is a cheap frame of (key, n), the rows of each key. Keys that have more rows than an
    even share of a partition number fewer than there are partitions: their
    entries of the table are broadcast, the other keys are shuffled.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = max(1.0, total / shuffle_partitions(rows.sparkSession))
    heavy = [r[0] for r in sizes.where(F.col("n") > share).select(key).collect()]  # fewer than there are partitions
    if not heavy:
        return rows.join(table, key)
    hot = F.col(key).isin(heavy)
    return rows.where(hot).join(F.broadcast(table.where(hot)), key).unionByName(rows.where(~hot).join(table.where(~hot), key))


def range_of(bounds: np.ndarray, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """The place of each key among len(bounds) + 1 ranges that ascending bounds cut.

    A key that is a bound several times has as many rows as several ranges take: its rows are
    dealt to them by their tie, a 64-bit hash. Places ascend with (key, tie).
    """
    low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    share = ties.astype(np.float64) / 2.0**64 + 0.5
    return low + np.minimum((share * np.maximum(high - low, 1)).astype(np.int64), np.maximum(high - low - 1, 0))


def mapped_by_place(df: DataFrame, run, schema: T.StructType) -> DataFrame:
    """df.mapInArrow() for columns of any names, dotted or equal ones too: the function sees and returns c0, c1, ..."""
    fields = [T.StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema.fields)]
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, T.StructType(fields)).toDF(*schema.names)


def record_batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    """A batch from name -> (values, Arrow type)."""
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in columns.values()], names=list(columns))
