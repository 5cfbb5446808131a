"""Where entities are kept: Parquet snapshots with changes beside them under one folder, or DataFrames in memory.

A save appends one small folder of changes to each entity it touches; reading puts
the newest change of an id in the place of the stored row. After COMPACT_AFTER changes a
save writes a new snapshot. Then one manifest is written that names the current
snapshot and changes of every entity and index. It is written beside its place and then
renamed without overwriting, so nothing half-written is ever read, and of two savers that
began from one manifest one fails. That holds where renaming is atomic and
refuses an existing target: HDFS and its like; on a local disk the check and the
rename are two steps, guarded within one process. Object stores without an atomic rename are
not served.
"""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConcurrentSaveError, SchemaError
from ..model import EntitySpec
from ..operators.overlay import applied


#: Saves whose changes lie beside a snapshot before a new one is written.
COMPACT_AFTER = 8
_RENAMING = threading.Lock()


@dataclass(frozen=True)
class Changes:
    """What a save does to an entity: first everything goes, if cleared; then rows are put in; then ids go."""

    rows: DataFrame | None = None
    ids: DataFrame | None = None
    cleared: bool = False


class Backend(Protocol):
    """What a session needs of a store."""

    def read(self, entity: EntitySpec) -> DataFrame: ...

    def read_index(self, name: str) -> DataFrame | None: ...

    def metadata(self) -> dict: ...

    def commit(self, tables: dict[str, DataFrame], indexes: dict[str, DataFrame], metadata: dict | None = None) -> None: ...

    def append(self, changes: dict[str, tuple[EntitySpec, Changes]], indexes: dict[str, DataFrame], metadata: dict | None = None) -> None: ...


class MemoryBackend:
    """Frames by name: for tests and for tables that exist already."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None):
        self.spark, self.tables, self.indexes, self._metadata = spark, dict(tables or {}), {}, {}

    def read(self, entity: EntitySpec) -> DataFrame:
        return self.tables[entity.name] if entity.name in self.tables else self.spark.createDataFrame([], entity.schema)

    def read_index(self, name: str) -> DataFrame | None:
        return self.indexes.get(name)

    def metadata(self) -> dict:
        return dict(self._metadata)

    def commit(self, tables, indexes, metadata=None):
        self.tables |= tables
        self.indexes |= indexes
        self._metadata |= metadata or {}


    def append(self, changes, indexes, metadata=None):
        after = {}
        for name, (entity, c) in changes.items():
            base = self.read(entity)
            after[name] = applied(base.limit(0) if c.cleared else base, c.rows, c.ids, entity.id)
        self.commit(after, indexes, metadata)


class Folder:
    """Directory operations by path below a root."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def is_directory(self, name: str) -> bool:
        return self.exists(name) and self.fs.getFileStatus(self._path(name)).isDirectory()

    def create(self, name: str) -> None:
        if self.exists(name):
            raise SchemaError(f"{name} exists")
        self.fs.mkdirs(self._path(name))

    def create_or_open(self, name: str) -> str:
        self.fs.mkdirs(self._path(name))
        return self.path(name)

    def open(self, name: str) -> str:
        if not self.exists(name):
            raise SchemaError(f"no directory {name}")
        return self.path(name)

    def move(self, old: str, new: str) -> None:
        if self.exists(new) or not self.fs.rename(self._path(old), self._path(new)):
            raise SchemaError(f"can't move {old} to {new}")

    def remove(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def write_new(self, name: str, text: str) -> None:
        """Creates a small file whole: written beside its place, then renamed; fails if it exists."""
        beside = f"{name}.{uuid.uuid4().hex}.part"
        out = self.fs.create(self._path(beside), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        try:
            with _RENAMING:
                context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
                none = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(self.fs.makeQualified(self._path(beside)), self.fs.makeQualified(self._path(name)), none)
        except Exception:
            self.fs.delete(self._path(beside), False)
            raise

    def read_text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class ParquetBackend:
    """Snapshots and manifests below a root folder."""

    def __init__(self, spark: SparkSession, root: str, partitions: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.folder, self.partitions = spark, Folder(spark, root), partitions or {}
        self.folder.create_or_open("manifests")
        self.number, self.manifest = -1, {"tables": {}, "indexes": {}, "metadata": {}}
        self.refresh()

    def refresh(self) -> None:
        """Moves to the newest manifest."""
        found = [int(n.removesuffix(".json")) for n in self.folder.names("manifests") if n.endswith(".json") and not n.startswith(".")]
        if found and max(found) > self.number:
            self.number = max(found)
            self.manifest = json.loads(self.folder.read_text(f"manifests/{self.number:012d}.json"))

    def read(self, entity: EntitySpec) -> DataFrame:
        path = self.manifest["tables"].get(entity.name)
        deltas = self.manifest.get("deltas", {}).get(entity.name, [])
        base = self.spark.createDataFrame([], entity.schema) if path is None else self.spark.read.schema(entity.schema).parquet(self.folder.path(path)).select(*entity.fields)
        if not deltas:
            return base
        # one row for each changed id: its newest change, where a deletion counts after the rows of its save
        changes = None
        for n, delta in enumerate(deltas):
            one = self.spark.read.parquet(self.folder.path(delta)).select(F.lit(n).alias("at"), "gone", F.col("id").alias("id"), "row")
            changes = one if changes is None else changes.unionByName(one)
        newest = changes.groupBy("id").agg(F.max_by(F.struct("gone", "row"), F.struct("at", "gone")).alias("c"))
        kept = base.join(newest.select(F.col("id").alias(entity.id)), entity.id, "left_anti").select(*entity.fields)
        return kept.unionByName(newest.where("not c.gone").select(*[F.col("c.row").getField(f).alias(f) for f in entity.fields]))

    def read_index(self, name: str) -> DataFrame | None:
        path = self.manifest["indexes"].get(name)
        return None if path is None else self.spark.read.parquet(self.folder.path(path))

    def metadata(self) -> dict:
        return dict(self.manifest["metadata"])

    def _next(self, metadata: dict | None) -> dict:
        m = self.manifest
        return {"tables": dict(m["tables"]), "indexes": dict(m["indexes"]), "deltas": dict(m.get("deltas", {})), "metadata": m["metadata"] | (metadata or {})}

    def _write(self, kind: str, name: str, df: DataFrame) -> str:
        path = f"{kind}/{name}/{uuid.uuid4().hex}"
        writer = df.write
        if kind == "tables" and self.partitions.get(name):
            writer = writer.partitionBy(*self.partitions[name])
        writer.parquet(self.folder.path(path))
        return path

    def _publish(self, after: dict) -> None:
        name = f"manifests/{self.number + 1:012d}.json"
        try:
            self.folder.write_new(name, json.dumps(after))
        except Exception as error:
            if self.folder.exists(name):
                raise ConcurrentSaveError(f"snapshot {self.number + 1} was taken by another save") from error
            raise
        self.number, self.manifest = self.number + 1, after

    def commit(self, tables, indexes, metadata=None):
        """Writes the frames as new snapshots and makes them current, all or none."""
        after = self._next(metadata)
        for kind, frames in (("tables", tables), ("indexes", indexes)):
            for name, df in frames.items():
                after[kind][name] = self._write(kind, name, df)
                if kind == "tables":
                    after["deltas"].pop(name, None)
        self._publish(after)

    def append(self, changes, indexes, metadata=None):
        """Writes changes beside the snapshots, and index frames whole, and makes them current, all or none."""
        after = self._next(metadata)
        for name, (entity, c) in changes.items():
            deltas = after["deltas"].get(name, [])
            if c.cleared or len(deltas) >= COMPACT_AFTER:
                base = self.spark.createDataFrame([], entity.schema) if c.cleared else self.read(entity)
                after["tables"][name] = self._write("tables", name, applied(base, c.rows, c.ids, entity.id))
                after["deltas"].pop(name, None)
                continue
            row = F.struct(*[F.col(f).cast(entity.schema[f].dataType).alias(f) for f in entity.fields])
            parts = []
            if c.rows is not None:
                parts.append(c.rows.select(F.lit(False).alias("gone"), F.col(entity.id).alias("id"), row.alias("row")))
            if c.ids is not None:
                parts.append(c.ids.select(F.lit(True).alias("gone"), F.col(entity.id).alias("id"), F.lit(None).cast(entity.schema).alias("row")))
            both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            after["deltas"][name] = [*deltas, self._write("deltas", name, both)]
        for name, df in indexes.items():
            after["indexes"][name] = self._write("indexes", name, df)
        self._publish(after)

    def compact(self, entity: EntitySpec) -> None:
        """Writes an entity's rows as a new snapshot without changes beside it."""
        self.commit({entity.name: self.read(entity)}, {})

    def collect_garbage(self, keep: int = 2) -> int:
        """Removes snapshots that none of the newest manifests names; returns how many."""
        found = sorted(n for n in self.folder.names("manifests") if n.endswith(".json") and not n.startswith("."))
        live: set[str] = set()
        for n in found[-keep:]:
            m = json.loads(self.folder.read_text(f"manifests/{n}"))
            live |= {*m["tables"].values(), *m["indexes"].values(), *(d for own in m.get("deltas", {}).values() for d in own)}
        every = [f"{kind}/{name}/{s}" for kind in ("tables", "indexes", "deltas") for name in self.folder.names(kind) for s in self.folder.names(f"{kind}/{name}")]
        gone = [p for p in every if p not in live]
        for p in [*gone, *(f"manifests/{n}" for n in found[:-keep])]:
            self.folder.remove(p)
        return len(gone)
