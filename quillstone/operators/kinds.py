"""Index kinds: what an index of each kind holds, and how it follows changes.

Every kind leaves out rows with a null among its fields. build() gives the index of a
whole table; merged() the index after a change of rows. Count, sum and average merge small
aggregates of the changed rows alone; least and greatest values cannot be
taken back, so those kinds keep all their entries. Sums are exact: whole numbers and decimals as such,
floating point as decimals of 38 digits, so that no drift comes from taking values back.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError
from ..model import EntitySpec, IndexSpec, VectorOptions, is_numeric, require, type_at
from . import search


def present(df: DataFrame, paths: tuple[str, ...] | list[str]) -> DataFrame:
    """Rows without a null among the paths."""
    return df.where(reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in paths])) if paths else df


def keys(paths) -> list[Column]:
    """The paths as columns, named without dots."""
    return [F.col(p).alias(p.replace(".", "_")) for p in paths]


def names(paths) -> list[str]:
    return [p.replace(".", "_") for p in paths]


class IndexKind(ABC):
    """Extend this for a kind of your own."""

    name: str

    @abstractmethod
    def validate(self, types: list, spec: IndexSpec) -> None:
        """Raises TypeValidationError if the fields do not suit the kind."""

    @abstractmethod
    def build(self, df: DataFrame, entity: EntitySpec, spec: IndexSpec) -> DataFrame:
        """The index of all rows."""

    def strategy(self, df: DataFrame, entity: EntitySpec, spec: IndexSpec) -> DataFrame:
        """How an index is built of a whole table; override where that is not what build() does, as for several passes."""
        return self.build(df, entity, spec)

    def configured(self, options: list[Mapping[str, Any]]) -> IndexKind:
        """The kind with the options of all its configurations; a kind takes those that are fields of its own."""
        merged: dict[str, Any] = {}
        for o in options:
            merged |= o
        known = {f.name for f in fields(self)} if is_dataclass(self) else set()
        if unknown := set(merged) - known:
            raise ConfigurationError(f"{self.name} has no option {sorted(unknown)}")
        return replace(self, **merged) if merged else self

    def expected(self, df: DataFrame, entity: EntitySpec, spec: IndexSpec) -> DataFrame:
        """What a check compares the stored index with."""
        return self.build(df, entity, spec)

    def merged(self, index: DataFrame, old: DataFrame, new: DataFrame, entity: EntitySpec, spec: IndexSpec) -> DataFrame:
        """The index after rows changed from old to new (either may lack a row that the other has)."""
        gone, come = self.build(old, entity, spec), self.build(new, entity, spec)
        return index.join(gone, gone.columns, "left_anti").unionByName(come)


@dataclass(frozen=True)
class Scalar(IndexKind):
    """Projection: field values, then the id. Stored in the order of the values, so that scans of a range skip files."""

    name = "scalar"

    def validate(self, types, spec):
        require("scalar", types, 1)

    def build(self, df, entity, spec):
        return present(df, spec.paths).select(*keys(spec.paths), F.col(entity.id).alias("id"))

    def strategy(self, df, entity, spec):
        built = self.build(df, entity, spec)
        return built.repartitionByRange(*built.columns).sortWithinPartitions(*built.columns)


class _Grouped(IndexKind):
    """Kinds whose fields are a group and, last, a value."""

    def split(self, spec: IndexSpec) -> tuple[tuple[str, ...], str]:
        return spec.paths[:-1], spec.paths[-1]


@dataclass(frozen=True)
class Count(IndexKind):
    """Rows for each group."""

    name = "count"

    def validate(self, types, spec):
        require("count", types, 1)

    def build(self, df, entity, spec):
        return present(df, spec.paths).groupBy(*keys(spec.paths)).agg(F.count("*").alias("n"))

    def merged(self, index, old, new, entity, spec):
        return _summed(index, self.build(old, entity, spec), self.build(new, entity, spec), names(spec.paths), ["n"])


def exact(value: Column, t: T.DataType) -> Column:
    """A number as a type whose sums lose nothing: floating point as a decimal with 10 places, others as they are."""
    return value.cast("decimal(28,10)") if isinstance(t, (T.FloatType, T.DoubleType)) else value


@dataclass(frozen=True)
class Sum(_Grouped):
    """The sum of the last field, kept exactly, with its value as double, and the rows behind it, for each group."""

    name = "sum"

    def validate(self, types, spec):
        require("sum", types, 2, last=is_numeric)

    def build(self, df, entity, spec):
        group, value = self.split(spec)
        sums = present(df, spec.paths).groupBy(*keys(group)).agg(F.sum(exact(F.col(value), type_at(df.schema, value))).alias("sum"), F.count("*").alias("n"))
        return self._shown(sums)

    def _shown(self, sums: DataFrame) -> DataFrame:
        return sums.withColumn("total", F.col("sum").cast("double"))

    def merged(self, index, old, new, entity, spec):
        return self._shown(_summed(index, self.build(old, entity, spec), self.build(new, entity, spec), names(spec.paths[:-1]), ["sum", "n"]))


@dataclass(frozen=True)
class Average(_Grouped):
    """The sum and the number of values for each group; whole numbers are summed exactly."""

    name = "average"

    def validate(self, types, spec):
        require("average", types, 2, last=is_numeric)

    def build(self, df, entity, spec):
        group, value = self.split(spec)
        sums = present(df, spec.paths).groupBy(*keys(group)).agg(F.sum(exact(F.col(value), type_at(df.schema, value))).alias("total"), F.count("*").alias("n"))
        return sums.withColumn("average", F.col("total").cast("double") / F.col("n"))

    def merged(self, index, old, new, entity, spec):
        out = _summed(index.drop("average"), self.build(old, entity, spec).drop("average"), self.build(new, entity, spec).drop("average"), names(spec.paths[:-1]), ["total", "n"])
        return out.withColumn("average", F.col("total").cast("double") / F.col("n"))


@dataclass(frozen=True)
class Extreme(_Grouped):
    """Sorted entries (group, value, id); the first or last of a group is its least or greatest value."""

    greatest: bool = False

    @property
    def name(self):
        return "max" if self.greatest else "min"

    def validate(self, types, spec):
        require(self.name, types, 2)

    def build(self, df, entity, spec):
        group, value = self.split(spec)
        return present(df, spec.paths).select(*keys(group), F.col(value).alias("value"), F.col(entity.id).alias("id"))

    def of_groups(self, index: DataFrame, spec: IndexSpec) -> DataFrame:
        """(group..., value, id): the extreme of each group with the id that has it, the smallest on ties."""
        group = names(spec.paths[:-1])
        if not self.greatest:
            best = index.groupBy(*group).agg(F.min(F.struct("value", "id")).alias("e"))
            return best.select(*group, "e.value", "e.id")
        top = index.groupBy(*group).agg(F.max("value").alias("value"), F.max_by("id", F.struct("value")).alias("_any"))
        return top.join(index, [*group, "value"]).groupBy(*group, "value").agg(F.min("id").alias("id"))

    def listed(self, index: DataFrame, spec: IndexSpec, k: int) -> DataFrame:
        """The k first entries of each group in the index's order, with their place."""
        value = F.col("value").desc() if self.greatest else F.col("value").asc()
        order = Window.partitionBy(*names(spec.paths[:-1])).orderBy(value, "id")
        return index.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def Min() -> Extreme:
    return Extreme(False)


def Max() -> Extreme:
    return Extreme(True)


@dataclass(frozen=True)
class Vector(IndexKind):
    """Vectors by id, for exact search by a metric; algorithm and parameters are checked and kept, and exact search serves all."""

    dimensions: int | None = None
    metric: str = "cosine"
    algorithm: str = "flat"
    parameters: Mapping[str, int] = field(default_factory=dict, hash=False)
    name = "vector"

    def __post_init__(self):
        VectorOptions(self.algorithm, self.metric, self.parameters)

    def validate(self, types, spec):
        require("vector", types, 1, test=lambda t: isinstance(t, T.ArrayType) and is_numeric(t.elementType))

    def build(self, df, entity, spec):
        rows = present(df, spec.paths).select(F.col(entity.id).alias("id"), F.col(spec.paths[0]).alias("vector"))
        return rows if self.dimensions is None else rows.where(F.size("vector") == self.dimensions)

    def nearest(self, index: DataFrame, query: Sequence[float], k: int) -> DataFrame:
        """(id, score) of the k nearest."""
        return search.nearest(index, "id", "vector", query, k, self.metric)


@dataclass(frozen=True)
class FullText(IndexKind):
    """(term, id, tf) of a text field; the tokenizer is standard or ngram, stop words go first."""

    tokenizer: str = "standard"
    ngram: int = 3
    stop_words: tuple[str, ...] = ()
    name = "fulltext"

    def __post_init__(self):
        if self.tokenizer not in ("standard", "ngram"):
            raise ConfigurationError(f"no tokenizer {self.tokenizer!r}")

    def validate(self, types, spec):
        require("fulltext", types, 1, last=lambda t: isinstance(t, T.StringType))

    def build(self, df, entity, spec):
        how = {"stop_words": tuple(self.stop_words)} | ({"ngram": self.ngram} if self.tokenizer == "ngram" else {})
        return search.inverted(present(df, spec.paths), entity.id, spec.paths[0], **how)

    def matches(self, index: DataFrame, *terms: str) -> DataFrame:
        """(id, tf) of the rows that have all the terms, with the sum of their counts."""
        wanted = sorted({t.lower() for t in terms})
        return index.where(F.col("term").isin(wanted)).groupBy("id").agg(F.sum("tf").alias("tf"), F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")


@dataclass(frozen=True)
class Spatial(IndexKind):
    """Points by the cell of a grid of 2 ** level rows and columns over (-180..180, -90..90), with their ids."""

    level: int = 15
    name = "spatial"

    def __post_init__(self):
        if not 0 <= self.level <= 30:
            raise ConfigurationError(f"spatial level {self.level}")

    def validate(self, types, spec):
        require("spatial", types, 2, test=is_numeric)

    def cell(self, longitude: Column, latitude: Column) -> Column:
        n = F.lit(1 << self.level)
        x = F.floor((longitude.cast("double") + 180.0) / 360.0 * n)
        y = F.floor((latitude.cast("double") + 90.0) / 180.0 * n)
        clipped = lambda c: F.greatest(F.lit(0), F.least(c, n - 1)).cast("bigint")
        return F.shiftleft(clipped(y), self.level).bitwiseOR(clipped(x))

    def build(self, df, entity, spec):
        a, b = spec.paths[:2]
        return present(df, spec.paths).select(self.cell(F.col(a), F.col(b)).alias("cell"), F.col(a).alias("longitude"), F.col(b).alias("latitude"), F.col(entity.id).alias("id"))


@dataclass(frozen=True)
class History(IndexKind):
    """Every version of a row, and a rule for how long it is kept: all, the last n, or some seconds.

    A save appends the rows it put in as (id, at, seq, row): at is the time of the save, seq
    grows with every save of the index. Older versions go by the rule at the same time.
    """

    keep_last: int | None = None
    keep_seconds: int | None = None
    name = "version"

    def validate(self, types, spec):
        require("version", types, 1)

    def build(self, df, entity, spec):
        return present(df, (entity.id, *spec.paths))

    def strategy(self, df, entity, spec):
        return self._entries(self.build(df, entity, spec), entity, 0, 0.0)

    def _entries(self, rows: DataFrame, entity: EntitySpec, seq: int, at: float) -> DataFrame:
        return rows.select(F.col(entity.id).alias("id"), F.lit(float(at)).alias("at"), F.lit(seq).cast("bigint").alias("seq"), F.struct(*entity.fields).alias("row"))

    def appended(self, index: DataFrame, rows: DataFrame, entity: EntitySpec, spec: IndexSpec, at: float) -> DataFrame:
        """The index after a save put rows in."""
        seq = (index.agg(F.max("seq")).first()[0] or 0) + 1
        every = index.unionByName(self._entries(self.build(rows, entity, spec), entity, seq, at))
        if self.keep_seconds is not None:
            return every.where(F.col("at") >= at - self.keep_seconds)
        return self.retained(every, "id", ["at", "seq"])

    def retained(self, history: DataFrame, key: str, order: list[str], now: Column | None = None) -> DataFrame:
        """What the rule keeps; order is the version, oldest first, and its first part a time."""
        if self.keep_last is not None:
            newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
            return history.withColumn("_place", F.row_number().over(newest)).where(F.col("_place") <= self.keep_last).drop("_place")
        if self.keep_seconds is not None:
            return history.where(F.col(order[0]) >= now - F.expr(f"interval {int(self.keep_seconds)} seconds"))
        return history


def as_of(history: DataFrame, key: str, order: list[str], at: Column) -> DataFrame:
    """The newest version of each key that is not newer than at."""
    row = F.struct(*[F.col(c) for c in history.columns])
    newest = history.where(F.col(order[0]) <= at).groupBy(key).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return newest.select("_row.*")


def _summed(index: DataFrame, gone: DataFrame, come: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """index - gone + come for each group; groups without rows disappear."""
    minus = gone.select(*group, *[(-F.col(v)).alias(v) for v in values])
    every = index.select(*group, *values).unionByName(minus).unionByName(come.select(*group, *values))
    # a sum of decimals is wider than its terms: it keeps the width of the index
    return every.groupBy(*group).agg(*[F.sum(v).cast(index.schema[v].dataType).alias(v) for v in values]).where("n > 0")


def lookup(index: DataFrame, group: dict) -> DataFrame:
    """The index's rows of one group."""
    return index.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in group.items()]))


def find_unique_violations(df: DataFrame, entity: EntitySpec, spec: IndexSpec) -> DataFrame:
    """(values..., n): values of a unique index that several ids share."""
    return present(df, spec.paths).groupBy(*keys(spec.paths)).agg(F.count_distinct(entity.id).alias("n")).where("n > 1")
