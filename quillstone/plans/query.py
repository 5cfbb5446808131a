"""The fluent query: predicates, sort keys, offset and limit, compiled to one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..model import type_at
from .predicate import And, Predicate, compile


@dataclass(frozen=True)
class Query:
    """Immutable; every step returns a new query. Evaluation is filter, sort, offset, limit."""

    predicates: tuple[Predicate, ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    most: int | None = None
    skipped: int = 0

    def where(self, predicate: Predicate) -> Query:
        """Further predicates have to hold as well."""
        return replace(self, predicates=(*self.predicates, predicate))

    def order_by(self, path: str, descending: bool = False) -> Query:
        """A further sort key; missing values come first when ascending, last when descending."""
        return replace(self, order=(*self.order, (path, descending)))

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        """Rows to leave out; none if n is not positive."""
        return replace(self, skipped=max(0, n))

    def condition(self, df: DataFrame) -> Column:
        return compile(And(self.predicates), df.schema)

    def sort_keys(self, df: DataFrame) -> list[Column]:
        for path, _ in self.order:
            type_at(df.schema, path)
        return [F.col(p).desc_nulls_last() if down else F.col(p).asc_nulls_first() for p, down in self.order]

    def matching(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition(df)) if self.predicates else df

    def plan(self, df: DataFrame) -> DataFrame:
        """The rows of df that the query returns."""
        out = self.matching(df)
        if self.order:
            out = out.orderBy(*self.sort_keys(df))
        if self.skipped:
            out = out.offset(self.skipped)
        return out if self.most is None else out.limit(self.most)

    def counted(self, df: DataFrame) -> DataFrame:
        """One row, n: all matching rows, whatever limit and offset are."""
        return self.matching(df).agg(F.count("*").alias("n"))

    def count(self, df: DataFrame) -> int:
        return self.matching(df).count()

    def first(self, df: DataFrame) -> Row | None:
        found = self.limit(1).plan(df).take(1)
        return found[0] if found else None


def best_index(entity, query: Query, readable=lambda name: True):
    """The scalar index that a lookup would use: one with two leading equalities, then an equality, then a range.

    A hint for explanations only: Spark chooses how to read.
    """
    flat = [c for p in query.predicates for c in (p.parts if isinstance(p, And) else (p,))]
    ops = {c.path: c.op for c in flat if hasattr(c, "path") and c.op in ("eq", "lt", "le", "gt", "ge")}
    best, rank = None, 0
    for index in entity.indexes:
        if index.kind.name != "scalar" or not readable(index.name):
            continue
        equal = 0
        for path in index.paths:
            if ops.get(path) != "eq":
                break
            equal += 1
        score = 3 if equal >= 2 else 2 if equal else 1 if index.paths[0] in ops else 0
        if score > rank:
            best, rank = index, score
    return best
