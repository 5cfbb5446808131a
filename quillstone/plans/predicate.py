"""Predicates with two-valued logic, compiled to conditions that Spark pushes into scans.

A comparison with a missing value is false, and its negation true. Negations are
driven to the leaves, so a positive leaf stays a plain comparison; nothing is
wrapped, and every part can reach the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PredicateError
from ..model import type_at


class Predicate:
    """Base of the tree; combine with &, | and ~."""

    def __and__(self, other: Predicate) -> Predicate:
        return And(_flat(And, self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or(_flat(Or, self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


def _flat(kind: type, *parts: Predicate) -> tuple[Predicate, ...]:
    return tuple(c for p in parts for c in (p.parts if isinstance(p, kind) else (p,)))


@dataclass(frozen=True)
class Comparison(Predicate):
    path: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


@dataclass(frozen=True)
class Constant(Predicate):
    value: bool


TRUE, FALSE = Constant(True), Constant(False)


class Field:
    """A field path whose operators build comparisons."""

    def __init__(self, path: str):
        self.path = path

    def _compare(self, op: str, value: Any) -> Comparison:
        if value is None:
            raise PredicateError(f"{self.path}: compare with is_nil() or is_not_nil(), not None")
        return Comparison(self.path, op, value)

    def __eq__(self, value):  # type: ignore[override]
        return self._compare("eq", value)

    def __ne__(self, value):  # type: ignore[override]
        return self._compare("ne", value)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, value):
        return self._compare("lt", value)

    def __le__(self, value):
        return self._compare("le", value)

    def __gt__(self, value):
        return self._compare("gt", value)

    def __ge__(self, value):
        return self._compare("ge", value)

    def contains(self, part: str) -> Comparison:
        return self._compare("contains", part)

    def has_prefix(self, part: str) -> Comparison:
        return self._compare("prefix", part)

    def has_suffix(self, part: str) -> Comparison:
        return self._compare("suffix", part)

    def is_in(self, values: Iterable[Any]) -> Comparison:
        held = tuple(values)
        if any(v is None for v in held):
            raise PredicateError(f"{self.path}: None in a list of values")
        return Comparison(self.path, "in", held)

    def is_nil(self) -> Comparison:
        return Comparison(self.path, "nil")

    def is_not_nil(self) -> Comparison:
        return Comparison(self.path, "not_nil")


def field(path: str) -> Field:
    return Field(path)


_ORDERED = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
}
_TEXT = {"contains": lambda c, v: c.contains(v), "prefix": lambda c, v: c.startswith(v), "suffix": lambda c, v: c.endswith(v)}


def _leaf(p: Comparison, schema: T.StructType, wanted: bool) -> Column:
    kind, whole = type_at(schema, p.path), F.col(p.path)
    if p.op in ("nil", "not_nil"):
        missing = (p.op == "nil") == wanted
        if isinstance(kind, T.ArrayType):
            return whole.isNull() | (F.size(whole) == 0) if missing else whole.isNotNull() & (F.size(whole) > 0)
        return whole.isNull() if missing else whole.isNotNull()
    # a comparison of an array is one of its first element
    of = F.get(whole, F.lit(0)) if isinstance(kind, T.ArrayType) else whole
    if p.op in _TEXT:
        if not isinstance(kind, T.StringType):
            raise PredicateError(f"{p.path}: {p.op} needs a string, not {kind.simpleString()}")
        holds = _TEXT[p.op](of, p.value)
    elif p.op == "in":
        if not p.value:
            return F.lit(not wanted)
        holds = of.isin(*p.value)
    else:
        if p.op == "eq" and not wanted:
            return ~of.eqNullSafe(F.lit(p.value))
        holds = _ORDERED[p.op](of, F.lit(p.value))
    return holds if wanted else of.isNull() | ~holds


def compile(p: Predicate, schema: T.StructType, wanted: bool = True) -> Column:
    """The condition under which p is true (wanted), or is not true."""
    if isinstance(p, Comparison):
        return _leaf(p, schema, wanted)
    if isinstance(p, Constant):
        return F.lit(p.value == wanted)
    if isinstance(p, Not):
        return compile(p.part, schema, not wanted)
    if not isinstance(p, (And, Or)):
        raise PredicateError(f"not a predicate: {p!r}")
    every = isinstance(p, And) == wanted
    out = None
    for part in p.parts:
        c = compile(part, schema, wanted)
        out = c if out is None else (out & c if every else out | c)
    return F.lit(every) if out is None else out


def as_value(p: Predicate, schema: T.StructType) -> Column:
    """p as a boolean that is never null, for projections."""
    return F.coalesce(compile(p, schema), F.lit(False))


def evaluate(p: Predicate, row: dict[str, Any]) -> bool:
    """p on a plain row of flat fields: the meaning that compile() has to match."""
    if isinstance(p, Constant):
        return p.value
    if isinstance(p, And):
        return all(evaluate(c, row) for c in p.parts)
    if isinstance(p, Or):
        return any(evaluate(c, row) for c in p.parts)
    if isinstance(p, Not):
        return not evaluate(p.part, row)
    v = row[p.path]
    if p.op in ("nil", "not_nil"):
        return (v is None) == (p.op == "nil")
    if v is None:
        return False
    if p.op == "in":
        return v in p.value
    if p.op in _TEXT:
        return {"contains": p.value in v, "prefix": v.startswith(p.value), "suffix": v.endswith(p.value)}[p.op]
    return _ORDERED[p.op](v, p.value)
