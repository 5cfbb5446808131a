"""The engine and its sessions: pending changes, reads that see them, atomic saves with index upkeep."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import date, datetime
from decimal import Decimal
from typing import Any, TypeVar

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, IndexConfiguration, IndexState, IndexStates
from .errors import ConcurrentSaveError, IndexStateError, SizeLimitError, UniqueViolation
from .model import EntitySpec, IndexSpec, Version
from .operators.kinds import History, as_of, find_unique_violations
from .operators.overlay import KEY_LIMIT, VALUE_LIMIT, applied
from .plans.predicate import Predicate
from .plans.query import Query
from .sources.storage import Backend, Changes

Result = TypeVar("Result")


class Delegate:
    """Callbacks; override what you need."""

    def did_fetch(self, entity: str, seconds: float, rows: int) -> None:
        """Rows were read: rows() or get() ran."""

    def did_save(self, counts: dict[str, int], seconds: float) -> None: ...

    def did_delete(self, entity: str, rows: int) -> None:
        """A save took ids away."""

    def did_batch(self, entity: str, inserts: int, deletes: int, seconds: float) -> None:
        """A save changed an entity."""

    def did_build(self, index: str, rows: int, seconds: float) -> None:
        """An index was built of so many entries."""

    def did_scrub(self, index: str, found: dict[str, int], seconds: float) -> None:
        """A stored index was checked."""

    def did_fail(self, what: str, error: Exception) -> None: ...


@dataclass
class Metrics(Delegate):
    """Counts and seconds by name."""

    counts: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    def _add(self, name: str, seconds: float, n: int = 1) -> None:
        self.counts[name] = self.counts.get(name, 0) + n
        self.seconds[name] = self.seconds.get(name, 0.0) + seconds

    def did_fetch(self, entity, seconds, rows):
        self._add("fetch", seconds)
        self._add("fetched.rows", 0.0, rows)

    def did_save(self, counts, seconds):
        self._add("save", seconds)
        for name, n in counts.items():
            self._add(f"saved.{name}", 0.0, n)

    def did_delete(self, entity, rows):
        self._add("delete", 0.0)
        self._add("deleted.rows", 0.0, rows)

    def did_batch(self, entity, inserts, deletes, seconds):
        self._add("batch", seconds)
        self._add("batch.inserts", 0.0, inserts)
        self._add("batch.deletes", 0.0, deletes)

    def did_build(self, index, rows, seconds):
        self._add("build", seconds)
        self._add("built.entries", 0.0, rows)

    def did_scrub(self, index, found, seconds):
        self._add("scrub", seconds)
        for name, n in found.items():
            self._add(f"scrub.{name}", 0.0, n)

    def did_fail(self, what, error):
        self._add(f"failed.{what}", 0.0)

    def reset(self) -> None:
        self.counts.clear()
        self.seconds.clear()


def stored_bytes(value: Any) -> int:
    """About what a value takes in a store: texts and bytes by length, numbers by width, collections by their parts."""
    if value is None:
        return 0
    if isinstance(value, str):
        return len(value.encode("utf-8", "surrogatepass"))
    if isinstance(value, (bytes, bytearray)):
        return len(value)
    if isinstance(value, bool):
        return 1
    if isinstance(value, (int, float, Decimal, date, datetime)):
        return 8
    if isinstance(value, dict):
        return sum(stored_bytes(k) + stored_bytes(v) for k, v in value.items())
    return sum(map(stored_bytes, value))


def check_sizes(entity: EntitySpec, row: dict[str, Any]) -> None:
    """Raises SizeLimitError if the id, an index key or the whole row is larger than a store takes."""
    keys = {entity.id: (row[entity.id],)} | {i.name: [row.get(p) for p in i.paths if "." not in p] for i in entity.indexes}
    for name, values in keys.items():
        if (size := stored_bytes(list(values))) > KEY_LIMIT:
            raise SizeLimitError(f"{entity.name} {name}: a key of {size} bytes, at most {KEY_LIMIT}")
    if (size := stored_bytes(row)) > VALUE_LIMIT:
        raise SizeLimitError(f"{entity.name}: a row of {size} bytes, at most {VALUE_LIMIT}")


@dataclass(frozen=True)
class Settings:
    """How an engine works: index configurations, callbacks, and how long after a change it saves by itself (None: never)."""

    configurations: tuple[IndexConfiguration, ...] = ()
    delegate: Delegate | None = None
    autosave_delay: float | None = None


class Engine:
    """A catalog over a store. Index configurations are given to their indexes' kinds here, once."""

    def __init__(self, spark: SparkSession, catalog: Catalog, backend: Backend, configurations: Iterable[IndexConfiguration] = (), delegate: Delegate | None = None, settings: Settings = Settings()):
        self.spark, self.backend, self.settings = spark, backend, settings
        self.configurations = catalog.configured([*settings.configurations, *configurations])
        self.catalog = self._configured(catalog)
        self.delegate = delegate or settings.delegate or Delegate()
        self.main = Session(self)

    def _configured(self, catalog: Catalog) -> Catalog:
        """The catalog whose index kinds have taken their options."""

        def index(i: IndexSpec) -> IndexSpec:
            found = self.configurations.get(i.name, [])
            return replace(i, kind=i.kind.configured([c.options for c in found])) if found else i

        return replace(catalog, entities=tuple(replace(e, indexes=tuple(map(index, e.indexes))) for e in catalog.entities))

    @property
    def version(self) -> Version | None:
        """The schema version of the stored data; None in a new store."""
        text = self.backend.metadata().get("version")
        return None if text is None else Version.parse(text)

    def set_version(self, version: Version) -> None:
        self.backend.commit({}, {}, {"version": str(version)})

    def transaction(self, work: Callable[[Session], Result]) -> Result:
        """Runs work in a session of its own and saves what it changed, or nothing if it fails."""
        with self.session().saving() as session:
            return work(session)

    def clear(self, entity: str) -> None:
        """Removes all rows of an entity and the entries of its indexes; nothing is read but schemas."""
        spec = self.catalog.entity(entity)
        none = self.spark.createDataFrame([], spec.schema)
        built = {i.name: i.kind.build(none, spec, i) for i in spec.indexes if self.backend.read_index(i.name) is not None}
        self.backend.append({entity: (spec, Changes(cleared=True))}, built)

    def session(self) -> Session:
        """A session with pending changes of its own."""
        return Session(self)

    def states(self) -> IndexStates:
        return IndexStates(self.backend.metadata().get("states"))

    def set_state(self, index: str, state: IndexState) -> None:
        states = self.states()
        states.move(index, state)
        self.backend.commit({}, {}, {"states": states.as_dict()})

    def build_index(self, name: str) -> None:
        """Disabled or new to readable: the index of all rows is written, then its state moves."""
        entity, spec = self.catalog.owner(name)
        states = self.states()
        if states.of(name) is not IndexState.WRITE_ONLY:
            states.move(name, IndexState.DISABLED)
            states.move(name, IndexState.WRITE_ONLY)
        states.move(name, IndexState.READABLE)
        began = time.perf_counter()
        self.backend.commit({}, {name: spec.kind.strategy(self.backend.read(entity), entity, spec)}, {"states": states.as_dict()})
        self.delegate.did_build(name, self.backend.read_index(name).count(), time.perf_counter() - began)

    def index(self, name: str) -> DataFrame:
        """A readable index."""
        self.states().require_readable(name)
        found = self.backend.read_index(name)
        if found is None:
            raise IndexStateError(f"{name} was never built")
        return found


class Session:
    """A unit of work. Inserts and deletions wait until save(); fetches see them before that."""

    def __init__(self, engine: Engine):
        self.engine = engine
        self._inserts: dict[str, dict[Any, dict]] = {}
        self._deletes: dict[str, set] = {}
        self._cleared: set[str] = set()
        self._lock = threading.RLock()
        self._saving = False
        self._timer: threading.Timer | None = None

    # pending changes

    def insert(self, entity: str, **row: Any) -> None:
        """Adds or replaces the row with its id; takes back a deletion of that id."""
        spec = self.engine.catalog.entity(entity)
        full = {f: row.get(f, spec.defaults.get(f)) for f in spec.fields}
        with self._lock:
            self._deletes.get(entity, set()).discard(full[spec.id])
            self._inserts.setdefault(entity, {})[full[spec.id]] = full
        self._changed()

    def delete(self, entity: str, *ids: Any) -> None:
        """Deletes by id. An insert that was not saved is taken back as well; a stored row of that id goes too."""
        with self._lock:
            for i in ids:
                self._inserts.get(entity, {}).pop(i, None)
                self._deletes.setdefault(entity, set()).add(i)
        self._changed()

    def delete_all(self, entity: str) -> None:
        """Deletes every row, stored or pending; no id is listed. Inserts that follow stay."""
        self.engine.catalog.entity(entity)
        with self._lock:
            self._inserts.pop(entity, None)
            self._deletes.pop(entity, None)
            self._cleared.add(entity)
        self._changed()

    def delete_where(self, entity: str, predicate: Predicate) -> int:
        """Deletes the rows that the predicate finds, by id; for changes beyond a session's size use overlay.deleted_where()."""
        spec = self.engine.catalog.entity(entity)
        ids = [r[0] for r in Query().where(predicate).plan(self.view(entity)).select(spec.id).toLocalIterator()]
        self.delete(entity, *ids)
        return len(ids)

    @property
    def has_changes(self) -> bool:
        return any(self._inserts.values()) or any(self._deletes.values()) or bool(self._cleared)

    def rollback(self) -> None:
        with self._lock:
            self._inserts, self._deletes, self._cleared = {}, {}, set()

    def _changed(self) -> None:
        """Puts off the save that follows changes by itself, where the engine's settings ask for one."""
        if self.engine.settings.autosave_delay is not None:
            self.autosave(self.engine.settings.autosave_delay)

    # reads

    def _pending(self, spec: EntitySpec, inserts: dict, deletes: dict) -> tuple[DataFrame | None, DataFrame | None]:
        spark = self.engine.spark
        rows, ids = inserts.get(spec.name), deletes.get(spec.name)
        new = spark.createDataFrame([tuple(r[f] for f in spec.fields) for r in rows.values()], spec.schema) if rows else None
        gone = spark.createDataFrame([(i,) for i in ids], f"`{spec.id}` {spec.schema[spec.id].dataType.simpleString()}") if ids else None
        return new, gone

    def view(self, entity: str) -> DataFrame:
        """The stored rows with this session's changes."""
        spec = self.engine.catalog.entity(entity)
        with self._lock:
            new, gone = self._pending(spec, self._inserts, self._deletes)
            cleared = entity in self._cleared
        base = self.engine.backend.read(spec)
        return applied(base.limit(0) if cleared else base, new, gone, spec.id)

    def fetch(self, entity: str, query: Query = Query()) -> DataFrame:
        """A query over the view, lazily."""
        return query.plan(self.view(entity))

    def rows(self, entity: str, query: Query = Query()) -> list[Row]:
        """The rows of a query, read now; for results that fit the driver."""
        began = time.perf_counter()
        try:
            found = self.fetch(entity, query).collect()
        except Exception as error:
            self.engine.delegate.did_fail("fetch", error)
            raise
        self.engine.delegate.did_fetch(entity, time.perf_counter() - began, len(found))
        return found

    def count(self, entity: str, query: Query = Query()) -> int:
        return query.count(self.view(entity))

    def get(self, entity: str, id: Any) -> Row | None:
        """The row of an id, or None."""
        spec = self.engine.catalog.entity(entity)
        began = time.perf_counter()
        found = self.view(entity).where(F.col(spec.id) == F.lit(id)).take(1)
        self.engine.delegate.did_fetch(entity, time.perf_counter() - began, len(found))
        return found[0] if found else None

    def enumerate(self, entity: str, visit: Callable[[Row], None]) -> None:
        """Visits every stored row, without pending changes, a partition at a time."""
        for row in self.engine.backend.read(self.engine.catalog.entity(entity)).toLocalIterator(prefetchPartitions=True):
            visit(row)

    # saving

    def save(self) -> None:
        """Writes all pending changes, or none. A failed save leaves them pending."""
        with self._lock:
            if self._saving:
                raise ConcurrentSaveError("a save is under way")
            if not self.has_changes:
                return
            self._saving = True
            inserts, deletes, cleared = self._inserts, self._deletes, self._cleared
            self._inserts, self._deletes, self._cleared = {}, {}, set()
        began = time.perf_counter()
        try:
            counts = self._write(inserts, deletes, cleared)
            self.engine.delegate.did_save(counts, time.perf_counter() - began)
        except Exception as error:
            with self._lock:  # what came meanwhile wins
                for name, rows in inserts.items():
                    if name in self._cleared:
                        continue
                    newer = self._inserts.setdefault(name, {})
                    for i, row in rows.items():
                        if i not in self._deletes.get(name, set()):
                            newer.setdefault(i, row)
                for name, ids in deletes.items():
                    if name not in self._cleared:
                        self._deletes.setdefault(name, set()).update(ids - self._inserts.get(name, {}).keys())
                self._cleared |= cleared
            self.engine.delegate.did_fail("save", error)
            raise
        finally:
            self._saving = False

    def _write(self, inserts: dict, deletes: dict, cleared: set[str]) -> dict[str, int]:
        engine, tables, indexes, counts = self.engine, {}, {}, {}
        for name, rows in inserts.items():
            for row in rows.values():
                check_sizes(engine.catalog.entity(name), row)
        states, now = engine.states(), time.time()
        began = time.perf_counter()
        for spec in engine.catalog.entities:
            new, gone = self._pending(spec, inserts, deletes)
            if new is None and gone is None and spec.name not in cleared:
                continue
            stored_rows = engine.backend.read(spec)
            base = stored_rows.limit(0) if spec.name in cleared else stored_rows
            after = applied(base, new, gone, spec.id)
            changed = [df.select(spec.id) for df in (new, gone) if df is not None] or [base.select(spec.id)]
            ids = changed[0].union(changed[1]).distinct() if len(changed) == 2 else changed[0]
            for i in spec.indexes:
                if i.unique:
                    bad = find_unique_violations(after, spec, i).limit(5).collect()
                    if bad:
                        raise UniqueViolation(i.name, [tuple(r)[:-1] for r in bad])
                stored = engine.backend.read_index(i.name)
                if stored is not None and states.of(i.name).is_maintained:
                    fresh = after.join(ids, spec.id, "left_semi")
                    if isinstance(i.kind, History):
                        indexes[i.name] = i.kind.appended(stored, fresh if new is not None else fresh.limit(0), spec, i, now)
                    elif spec.name in cleared:
                        indexes[i.name] = i.kind.build(after, spec, i)
                    else:
                        indexes[i.name] = i.kind.merged(stored, base.join(ids, spec.id, "left_semi"), fresh, spec, i)
            tables[spec.name] = spec, Changes(new, gone, spec.name in cleared)
            counts[spec.name] = len(inserts.get(spec.name, ())) + len(deletes.get(spec.name, ()))
        engine.backend.append(tables, indexes)
        for name in tables:
            engine.delegate.did_batch(name, len(inserts.get(name, ())), len(deletes.get(name, ())), time.perf_counter() - began)
            if deletes.get(name):
                engine.delegate.did_delete(name, len(deletes[name]))
        return counts

    def versions(self, index: str, id: Any) -> DataFrame:
        """The kept versions of a row, oldest first, from an index of the history kind."""
        return self.engine.index(index).where(F.col("id") == F.lit(id)).orderBy("at", "seq")

    def roll_back(self, index: str, id: Any, at: float) -> bool:
        """Inserts the row as it was at a time (seconds); what was deleted or unknown then is deleted. A save makes it so."""
        entity, _ = self.engine.catalog.owner(index)
        found = as_of(self.versions(index, id), "id", ["at", "seq"], F.lit(at)).select("row.*").take(1)
        if not found:
            self.delete(entity.name, id)
            return False
        self.insert(entity.name, **found[0].asDict(recursive=False))
        return True

    @contextmanager
    def saving(self) -> Iterator[Session]:
        """Saves at the end of a block; an error rolls back."""
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.save()

    def autosave(self, delay: float = 0.01) -> threading.Timer:
        """Saves once, delay seconds after the last call; an error stays with the delegate and the changes stay pending."""

        def run():
            try:
                self.save()
            except Exception:  # the delegate has been told
                pass

        with self._lock:
            if self._timer is not None:
                self._timer.cancel()
            self._timer = timer = threading.Timer(delay, run)
        timer.daemon = True
        timer.start()
        return timer
