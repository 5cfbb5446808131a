"""Declarations: entities with typed fields, an id, and indexes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .errors import ConfigurationError, SchemaError

#: Types an id may have.
ID_TYPES = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.BinaryType)


@dataclass(frozen=True, order=True)
class Version:
    """A schema version, ordered by its parts."""

    major: int
    minor: int = 0
    patch: int = 0

    @classmethod
    def parse(cls, text: str) -> Version:
        parts = text.split(".")
        if not 1 <= len(parts) <= 3 or not all(p.isdigit() for p in parts):
            raise SchemaError(f"not a version: {text!r}")
        return cls(*map(int, parts))

    def __str__(self) -> str:
        return f"{self.major}.{self.minor}.{self.patch}"


@dataclass(frozen=True)
class EnumSpec:
    """The values an enumerated field may have."""

    type_name: str
    cases: tuple[str, ...]

    def is_valid(self, value: str) -> bool:
        return value in self.cases


@dataclass(frozen=True)
class VectorOptions:
    """flat (exact), hnsw(m, ef_construction, ef_search) or ivf(nlist, nprobe); exact search serves all of them."""

    algorithm: str = "flat"
    metric: str = "cosine"
    parameters: Mapping[str, int] = field(default_factory=dict)

    def __post_init__(self):
        allowed = {"flat": set(), "hnsw": {"m", "ef_construction", "ef_search"}, "ivf": {"nlist", "nprobe"}}
        if self.algorithm not in allowed or self.metric not in ("cosine", "euclidean", "dotProduct"):
            raise ConfigurationError(f"vector options {self.algorithm!r}, {self.metric!r}")
        if unknown := set(self.parameters) - allowed[self.algorithm]:
            raise ConfigurationError(f"{self.algorithm} has no {sorted(unknown)}")


@dataclass(frozen=True)
class IndexSpec:
    """An index: its kind, its ordered field paths, and options; the entity completes the name."""

    kind: Any
    paths: tuple[str, ...]
    name: str | None = None
    unique: bool = False
    sparse: bool = False
    metadata: Mapping[str, Any] = field(default_factory=dict)

    def named(self, entity: str) -> IndexSpec:
        return self if self.name else replace(self, name="_".join([entity, *(p.replace(".", "_") for p in self.paths)]))


def type_at(schema: T.StructType, path: str) -> T.DataType:
    """The type at a dotted path; SchemaError names the part that is missing."""
    here: T.DataType = schema
    for n, part in enumerate(names := path.split(".")):
        if not isinstance(here, T.StructType) or part not in here.names:
            raise SchemaError(f"no field {'.'.join(names[: n + 1])!r}")
        here = here[part].dataType
    return here


@dataclass(frozen=True)
class EntitySpec:
    """An entity type: its fields, id, indexes, enumerated fields, defaults and partition fields.

    Transient fields are declared but never stored: they are not part of the
    schema. A type name stays when the class behind it is renamed.
    """

    name: str
    schema: T.StructType
    id: str = "id"
    indexes: tuple[IndexSpec, ...] = ()
    enums: Mapping[str, EnumSpec] = field(default_factory=dict)
    defaults: Mapping[str, Any] = field(default_factory=dict)
    partition_by: tuple[str, ...] = ()
    transient: tuple[str, ...] = ()

    def __post_init__(self):
        stored = T.StructType([f for f in self.schema.fields if f.name not in self.transient])
        object.__setattr__(self, "schema", stored)
        object.__setattr__(self, "indexes", tuple(i.named(self.name) for i in self.indexes))

    @property
    def fields(self) -> list[str]:
        return self.schema.names

    def field_number(self, name: str) -> int:
        """One-based place of a field in its declaration."""
        type_at(self.schema, name)
        return self.schema.names.index(name) + 1

    def index(self, name: str) -> IndexSpec:
        for i in self.indexes:
            if i.name == name:
                return i
        raise SchemaError(f"{self.name} has no index {name!r}")

    def validate(self) -> None:
        kind = type_at(self.schema, self.id)
        if not isinstance(kind, ID_TYPES):
            raise SchemaError(f"{self.name}.{self.id}: {kind.simpleString()} can't be an id")
        for path in (*self.enums, *self.partition_by):
            type_at(self.schema, path)
        for i in self.indexes:
            i.kind.validate([type_at(self.schema, p) for p in i.paths], i)


_PLAIN = {"string": T.StringType, "long": T.LongType, "bigint": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "float": T.FloatType, "boolean": T.BooleanType, "binary": T.BinaryType, "date": T.DateType, "timestamp": T.TimestampType}


def fields_of(text: str) -> T.StructType:
    """'name type, ...' of plain types; anything else is left to Spark's own reader of types, which needs a session."""
    pairs = [part.split() for part in text.split(",")]
    if all(len(p) == 2 and p[1] in _PLAIN for p in pairs):
        return T.StructType([T.StructField(n, _PLAIN[t]()) for n, t in pairs])
    return T.StructType.fromDDL(text)


def entity(name: str, schema: str | T.StructType, *indexes: IndexSpec, id: str = "id", **more: Any) -> EntitySpec:
    """An EntitySpec from a DDL string or a StructType; an id field is added in front where it is not declared."""
    fields = fields_of(schema) if isinstance(schema, str) else schema
    if id not in fields.names:
        fields = T.StructType([T.StructField(id, T.StringType(), False), *fields.fields])
    return EntitySpec(name, fields, id, tuple(indexes), **more)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_floating(t: T.DataType) -> bool:
    return isinstance(t, T.FractionalType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType)


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def is_comparable(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.StringType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType))


def require(kind: str, types: Sequence[T.DataType], least: int, test=is_comparable, last=None) -> None:
    """The checks that index kinds share: arity, comparable fields, and the last field's type."""
    from .errors import TypeValidationError

    if len(types) < least:
        raise TypeValidationError(f"{kind} needs at least {least} field(s), got {len(types)}")
    for t in types:
        if not test(t.elementType if isinstance(t, T.ArrayType) and kind == "scalar" else t):
            raise TypeValidationError(f"{kind}: {t.simpleString()} can't be compared")
    if last and not last(types[-1]):
        raise TypeValidationError(f"{kind}: its last field is {types[-1].simpleString()}")
