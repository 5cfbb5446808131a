"""Schema migration: a chain of versions with stages between them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import Catalog, IndexState
from .errors import MigrationError
from .model import EntitySpec, Version
from .operators.overlay import deleted_where
from .plans.predicate import Predicate, compile
from .session import Engine

Hook = Callable[["Context"], None]


@dataclass(frozen=True)
class Stage:
    """From one version to the next, with hooks before and after the index changes."""

    source: Version
    target: Version
    will: Hook | None = None
    did: Hook | None = None

    @property
    def is_lightweight(self) -> bool:
        return self.will is None and self.did is None


def conformed(df: DataFrame, entity: EntitySpec) -> DataFrame:
    """Rows in an entity's form: missing fields get their defaults, fields that are gone are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(entity.defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in entity.schema.fields])


class Context:
    """What a hook may do."""

    def __init__(self, engine: Engine, source: Catalog, target: Catalog):
        self.engine, self.source, self.target = engine, source, target

    def read(self, entity: str, source: bool = True) -> DataFrame:
        catalog = self.source if source else self.target
        return self.engine.backend.read(catalog.entity(entity))

    def count(self, entity: str) -> int:
        return self.read(entity).count()

    def batches(self, entity: str, size: int = 1000) -> Iterator[list]:
        """All rows in batches, a partition at a time."""
        held: list = []
        for row in self.read(entity).toLocalIterator(prefetchPartitions=True):
            held.append(row)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    def update(self, entity: str, where: Predicate, **columns: Column) -> None:
        """Sets columns of the rows that the predicate finds; indexes follow when the stage is done."""
        df = self.read(entity)
        found = F.coalesce(compile(where, df.schema), F.lit(False))
        self.engine.backend.commit({entity: df.withColumns({c: F.when(found, v).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in columns.items()})}, {})

    def delete(self, entity: str, where: Predicate) -> None:
        self.engine.backend.commit({entity: deleted_where(self.read(entity), where)}, {})

    def execute(self, operation: Callable):
        """Runs a function of the session's SparkSession."""
        return operation(self.engine.spark)

    def add_index(self, name: str) -> None:
        self.engine.catalog = self.target
        self.engine.build_index(name)

    def remove_index(self, name: str) -> None:
        """Disables it and leaves a tombstone; found in the catalog that still has it."""
        self.source.owner(name)
        states = self.engine.states()
        states.move(name, IndexState.DISABLED)
        former = self.engine.backend.metadata().get("former", []) + [[name, str(self.source.version), time.time()]]
        self.engine.backend.commit({}, {}, {"states": states.as_dict(), "former": former})

    def rebuild_index(self, name: str) -> None:
        self.engine.build_index(name)


@dataclass(frozen=True)
class Plan:
    """Catalogs in ascending order, and one stage between each two of them."""

    catalogs: tuple[Catalog, ...]
    stages: tuple[Stage, ...]

    def validate(self) -> None:
        versions = [c.version for c in self.catalogs]
        if not versions:
            raise MigrationError("a plan needs a catalog")
        if len(set(versions)) < len(versions):
            raise MigrationError("a version occurs twice")
        if versions != sorted(versions):
            raise MigrationError("versions have to ascend")
        if [(s.source, s.target) for s in self.stages] != list(zip(versions, versions[1:])):
            raise MigrationError("stages have to join each version with the next")

    def path(self, source: Version, target: Version) -> list[Stage]:
        """The stages from one version to another."""
        versions = [c.version for c in self.catalogs]
        for v in (source, target):
            if v not in versions:
                raise MigrationError(f"no path: {v} is not in the plan")
        if target < source:
            raise MigrationError(f"{source} can't go back to {target}")
        return list(self.stages[versions.index(source) : versions.index(target)])

    def catalog(self, version: Version) -> Catalog:
        return next(c for c in self.catalogs if c.version == version)

    def migrate(self, engine: Engine) -> list[Version]:
        """Brings a store to the newest version; returns the versions it went through.

        A new store only gets its version; one that is newer is left alone.
        """
        self.validate()
        newest = self.catalogs[-1].version
        text = engine.backend.metadata().get("version")
        if text is None:
            engine.catalog = self.catalogs[-1]
            engine.backend.commit({}, {}, {"version": str(newest)})
            return [newest]
        now = Version.parse(text)
        if now >= newest:
            return []
        done = []
        for stage in self.path(now, newest):
            source, target = self.catalog(stage.source), self.catalog(stage.target)
            context = Context(engine, source, target)
            if stage.will:
                stage.will(context)
            if stage.is_lightweight and not source.is_lightweight(target):
                raise MigrationError(f"{stage.source} to {stage.target} loses fields: it needs a custom stage")
            had = {e.name for e in source.entities}
            engine.backend.commit({e.name: conformed(context.read(e.name), e) for e in target.entities if e.name in had}, {})
            added, removed = source.changes_to(target)
            for name in sorted(removed):
                context.remove_index(name)
            engine.catalog = target
            kept = {n for n in target.index_names - added if engine.states().of(n).is_maintained}
            for name in sorted(added | kept):
                context.add_index(name)
            if stage.did:
                stage.did(context)
            engine.backend.commit({}, {}, {"version": str(stage.target)})
            done.append(stage.target)
        return done


def migrate_to(engine: Engine, target: Catalog, steps: list[tuple[Version, Hook]] = ()) -> list[Version]:
    """Brings a store to a catalog without a plan of every version between: the hooks of the versions on the way run in order.

    A store of that version is left alone; a newer one is an error. Fields that disappear
    need a hook for the target's version. Returns the versions whose hooks ran, and the target.
    """
    now = engine.version
    if now == target.version:
        return []
    if now is not None and now > target.version:
        raise MigrationError(f"{now} can't go back to {target.version}")
    source, done = engine.catalog, []
    wanted = [(v, hook) for v, hook in sorted(steps, key=lambda s: s[0]) if (now is None or v > now) and v <= target.version]
    if now is not None and not source.is_lightweight(target) and target.version not in {v for v, _ in wanted}:
        raise MigrationError(f"{now} to {target.version} loses fields: it needs a step")
    context = Context(engine, source, target)
    for version, hook in wanted:
        hook(context)
        done.append(version)
    had = {e.name for e in source.entities}
    if now is not None:
        engine.backend.commit({e.name: conformed(context.read(e.name), e) for e in target.entities if e.name in had}, {})
        added, removed = source.changes_to(target)
        for name in sorted(removed):
            context.remove_index(name)
        engine.catalog = target
        for name in sorted(added | {n for n in target.index_names - added if engine.states().of(n).is_maintained}):
            context.add_index(name)
    engine.catalog = target
    engine.set_version(target.version)
    return [*done, target.version] if target.version not in done else done
