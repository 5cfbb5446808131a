"""The catalog of entities, runtime index configuration, and index states."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from .errors import ConfigurationError, DuplicateIndexName, IndexStateError, SchemaError
from .model import EntitySpec, IndexSpec, Version


@dataclass(frozen=True)
class FormerIndex:
    """An index that is gone: its name, when it was added, and when it was removed."""

    name: str
    added: Version
    removed_at: float


@dataclass(frozen=True)
class IndexConfiguration:
    """Parameters for one index, given when the engine is opened."""

    entity: str
    index: str
    kind: str
    options: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Catalog:
    """A version and its entities; index names are unique over all of them."""

    version: Version
    entities: tuple[EntitySpec, ...]
    former: tuple[FormerIndex, ...] = ()

    def __post_init__(self):
        if not self.entities:
            raise SchemaError("a catalog needs an entity")
        if len({e.name for e in self.entities}) < len(self.entities):
            raise SchemaError("two entities have one name")
        seen: set[str] = set()
        for e in self.entities:
            e.validate()
            for i in e.indexes:
                if i.name in seen:
                    raise DuplicateIndexName(i.name)
                seen.add(i.name)

    def __eq__(self, other):
        """Catalogs are alike if version and entity names are."""
        return isinstance(other, Catalog) and (self.version, {e.name for e in self.entities}) == (other.version, {e.name for e in other.entities})

    def __hash__(self):
        return hash((self.version, frozenset(e.name for e in self.entities)))

    def entity(self, name: str) -> EntitySpec:
        for e in self.entities:
            if e.name == name:
                return e
        raise SchemaError(f"no entity {name!r}")

    def registered(self, entity: str, index: IndexSpec) -> Catalog:
        """The catalog with one more index; DuplicateIndexName if its name is taken."""
        spec = self.entity(entity)
        return replace(self, entities=tuple(replace(e, indexes=(*e.indexes, index)) if e is spec else e for e in self.entities))

    def unregistered(self, index: str) -> Catalog:
        """The catalog without an index."""
        spec, found = self.owner(index)
        return replace(self, entities=tuple(replace(e, indexes=tuple(i for i in e.indexes if i is not found)) if e is spec else e for e in self.entities))

    def indexes_of(self, entity: str) -> list[IndexSpec]:
        """The indexes of one entity, in the order of their names."""
        return sorted(self.entity(entity).indexes, key=lambda i: i.name)

    def owner(self, index: str) -> tuple[EntitySpec, IndexSpec]:
        """The one entity that an index belongs to."""
        for e in self.entities:
            for i in e.indexes:
                if i.name == index:
                    return e, i
        raise SchemaError(f"no index {index!r}")

    @property
    def index_names(self) -> set[str]:
        return {i.name for e in self.entities for i in e.indexes}

    def rows(self) -> list[tuple]:
        """(entity, field, position, type, is_id) of every field."""
        return [(e.name, f.name, n, f.dataType.simpleString(), f.name == e.id) for e in self.entities for n, f in enumerate(e.schema.fields, 1)]

    def configured(self, configurations: Iterable[IndexConfiguration]) -> dict[str, list[IndexConfiguration]]:
        """Configurations by index, each checked against the catalog."""
        out: dict[str, list[IndexConfiguration]] = {}
        for c in configurations:
            try:
                e, i = self.owner(c.index)
            except SchemaError as error:
                raise ConfigurationError(str(error)) from None
            if e.name != c.entity:
                raise ConfigurationError(f"{c.index} belongs to {e.name}, not {c.entity}")
            if i.kind.name != c.kind:
                raise ConfigurationError(f"{c.index} is of kind {i.kind.name}, not {c.kind}")
            out.setdefault(c.index, []).append(c)
        return out

    def changes_to(self, newer: Catalog) -> tuple[set[str], set[str]]:
        """Names of indexes added and removed."""
        return newer.index_names - self.index_names, self.index_names - newer.index_names

    def is_lightweight(self, newer: Catalog, per_entity: bool = False) -> bool:
        """Whether no field name disappears, over all entities or in each."""
        names = lambda c: {((e.name if per_entity else ""), f) for e in c.entities for f in e.fields}
        return names(self) <= names(newer)


class IndexState(Enum):
    READABLE = 0
    DISABLED = 1
    WRITE_ONLY = 2

    @property
    def is_maintained(self) -> bool:
        return self is not IndexState.DISABLED


_ALLOWED = {(IndexState.DISABLED, IndexState.WRITE_ONLY), (IndexState.WRITE_ONLY, IndexState.READABLE)}


class IndexStates:
    """States by index name; an unknown one is disabled. Kept as a small JSON-ready dict."""

    def __init__(self, states: Mapping[str, int] | None = None):
        self._states = {k: IndexState(v) for k, v in (states or {}).items()}

    def of(self, name: str) -> IndexState:
        return self._states.get(name, IndexState.DISABLED)

    def batch(self, names: Iterable[str]) -> dict[str, IndexState]:
        return {n: self.of(n) for n in names}

    def move(self, name: str, to: IndexState) -> None:
        """disabled to write-only to readable; to disabled from anywhere."""
        now = self.of(name)
        if to is not IndexState.DISABLED and (now, to) not in _ALLOWED:
            raise IndexStateError(f"{name}: {now.name} can't become {to.name}")
        self._states[name] = to

    def require_readable(self, name: str) -> None:
        if self.of(name) is not IndexState.READABLE:
            raise IndexStateError(f"{name} is {self.of(name).name}")

    def as_dict(self) -> dict[str, int]:
        return {k: v.value for k, v in self._states.items()}
