"""Tables and aggregate indexes kept up to date by a stream of changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..model import EntitySpec, IndexSpec
from ..sources.storage import Changes, Folder, ParquetBackend


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files in a folder, or of one file."""
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if not Folder(spark, path).is_directory(""):
        reader, path = reader.option("pathGlobFilter", name), folder
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def running_aggregate(rows: DataFrame, group: list[str], value: str | None = None) -> DataFrame:
    """Count, and sum of a value, for each group, as a streaming aggregation (update or complete mode)."""
    total = [F.sum(F.col(value).cast("double")).alias("total")] if value else []
    return rows.where(F.concat(*[F.col(c).cast("string") for c in [*group, *([value] if value else [])]]).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), *total)


def windowed(rows: DataFrame, time_col: str, width: str, group: list[str], late: str, slide: str | None = None) -> DataFrame:
    """Counts by time window; rows later than late are dropped by the watermark."""
    return rows.withWatermark(time_col, late).groupBy(F.window(time_col, width, slide) if slide else F.window(time_col, width), *group).agg(F.count("*").alias("n"))


def maintain(rows: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], entity: EntitySpec, spec: IndexSpec, checkpoint: str) -> StreamingQuery:
    """Merges each batch of inserted rows into an index.

    write gets the batch's number: a sink that has seen it already ignores it,
    so a batch that is run again after a failure counts once.
    """

    def each(batch: DataFrame, number: int) -> None:
        stored = read()
        write(spec.kind.build(batch, entity, spec) if stored is None else spec.kind.merged(stored, batch.limit(0), batch, entity, spec), number)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(rows: DataFrame, backend: ParquetBackend, entity: EntitySpec, checkpoint: str, deleted: str | None = None, order: str | None = None, every: str | None = None) -> StreamingQuery:
    """Saves a stream of rows by their ids: inserts, replacements and, where the column deleted is true, deletions.

    Of several rows of an id in a batch the one with the greatest order counts. A batch is
    appended beside the table, which is not rewritten, and its number is kept with it, so a batch that is run again
    counts once. every is the time between batches; without it what there is is done at once.
    """
    mark = f"stream.{entity.name}"

    def each(batch: DataFrame, number: int) -> None:
        backend.refresh()
        if backend.metadata().get(mark, -1) >= number:
            return
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        row = F.struct(*[F.col(f) for f in entity.fields])
        # rows that tie in order are told apart by the whole row, so that a batch gives one result
        newest = batch.groupBy(entity.id).agg(F.max_by(F.struct(gone.alias("gone"), row.alias("row")), F.struct(F.col(order) if order else F.lit(0), F.to_json(row))).alias("c"))
        newest = newest.persist()
        try:
            put = newest.where("not c.gone").select("c.row.*")
            changes = Changes(put, newest.where("c.gone").select(entity.id) if deleted else None)
            backend.append({entity.name: (entity, changes)}, {}, {mark: number})
        finally:
            newest.unpersist()

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def maintain_changes(changes: DataFrame, read: Callable[[], DataFrame | None], write: Callable[[DataFrame, int], None], entity: EntitySpec, spec: IndexSpec, checkpoint: str) -> StreamingQuery:
    """Merges a stream of changes (before, after) into an index: a row's old form, null for an insert, and its new one, null for a deletion."""

    def each(batch: DataFrame, number: int) -> None:
        old = batch.where("before is not null").select("before.*")
        new = batch.where("after is not null").select("after.*")
        stored = read()
        index = spec.kind.build(new.limit(0), entity, spec) if stored is None else stored
        write(spec.kind.merged(index, old, new, entity, spec), number)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
