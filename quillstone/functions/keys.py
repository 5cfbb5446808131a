"""Key expressions: trees that name the columns of an index key."""

from __future__ import annotations

from dataclasses import dataclass
from functools import singledispatch
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError, TypeValidationError
from ..model import type_at


@dataclass(frozen=True)
class FieldKey:
    name: str


@dataclass(frozen=True)
class Concat:
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class Nest:
    parent: str
    child: Any


@dataclass(frozen=True)
class RangeBound:
    """The lower or the upper bound of a field that is a range (a struct of lower and upper)."""

    name: str
    bound: str


def from_path(path: str):
    """'' -> Empty, 'a' -> FieldKey, 'a.b.c' -> nested."""
    if not path:
        return Empty()
    first, _, rest = path.partition(".")
    return Nest(first, from_path(rest)) if rest else FieldKey(first)


def from_paths(paths: list[str]):
    """The expression of several paths: none is Empty, one stands alone."""
    keys = [from_path(p) for p in paths]
    return Empty() if not keys else keys[0] if len(keys) == 1 else Concat(tuple(keys))


@singledispatch
def columns(key, schema: T.StructType, prefix: str = "") -> list[Column]:
    """The columns of a key expression."""
    raise SchemaError(f"not a key expression: {key!r}")


@columns.register
def _(key: FieldKey, schema, prefix=""):
    type_at(schema, prefix + key.name)
    return [F.col(prefix + key.name)]


@columns.register
def _(key: Concat, schema, prefix=""):
    return [c for part in key.parts for c in columns(part, schema, prefix)]


@columns.register
def _(key: Literal, schema, prefix=""):
    return [F.lit(key.value)]


@columns.register
def _(key: Empty, schema, prefix=""):
    return []


@columns.register
def _(key: Nest, schema, prefix=""):
    return columns(key.child, schema, f"{prefix}{key.parent}.")


@columns.register
def _(key: RangeBound, schema, prefix=""):
    if key.bound not in ("lower", "upper"):
        raise SchemaError(f"a range has no bound {key.bound!r}")
    type_at(schema, f"{prefix}{key.name}.{key.bound}")
    return [F.col(f"{prefix}{key.name}.{key.bound}")]


def column_count(key) -> int:
    """How many columns a key expression gives, without a schema."""
    if isinstance(key, Concat):
        return sum(map(column_count, key.parts))
    return column_count(key.child) if isinstance(key, Nest) else 0 if isinstance(key, Empty) else 1


def flattened(schema: T.StructType, path: str, n: int) -> list[Column]:
    """The first n elements of an array field as key columns; null where it is shorter."""
    if not isinstance(type_at(schema, path), T.ArrayType):
        raise SchemaError(f"{path} is no array")
    return [F.get(F.col(path), F.lit(k)) for k in range(n)]


def elements(df: DataFrame, id_col: str, path: str) -> DataFrame:
    """(id, place, value): every element of an array field, however long, as a row of its own; none for null and empty arrays."""
    if not isinstance(type_at(df.schema, path), T.ArrayType):
        raise SchemaError(f"{path} is no array")
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.col(path)).alias("place", "value"))


#: Types of key values, and what they are widened to.
WIDENED = {
    T.ByteType: "bigint", T.ShortType: "bigint", T.IntegerType: "bigint", T.LongType: "bigint", T.FloatType: "double", T.DoubleType: "double",
    T.StringType: "string", T.BooleanType: "boolean", T.BinaryType: "binary", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz",
}


def key_column(schema: T.StructType, path: str) -> Column:
    """A field as a key value: integers widen to bigint, floats to double, unsigned decimals of up to 20 digits to
    bigint, where one that does not fit is an error of the query; a type that can't be a key is one at once."""
    kind = type_at(schema, path)
    if isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 20:
        value, narrow = F.col(path), F.col(path).try_cast("bigint")
        lost = F.raise_error(F.concat(F.lit(f"{path}: too large for a key: "), value.cast("string"))).cast("bigint")
        return F.when(value.isNotNull() & narrow.isNull(), lost).otherwise(narrow)
    for t, to in WIDENED.items():
        if type(kind) is t:
            return F.col(path).cast(to)
    raise TypeValidationError(f"{path}: {kind.simpleString()} can't be a key")


def id_columns(key, schema: T.StructType) -> list[Column]:
    """The values of an id expression, which may have several parts, as id_0, id_1, ..."""
    return [c.alias(f"id_{k}") for k, c in enumerate(columns(key, schema))]
