"""Consistency of a stored index with its table: dangling entries, missing entries, repair."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ScrubError
from ..model import EntitySpec, IndexSpec

if TYPE_CHECKING:
    from ..session import Engine


def dangling(index: DataFrame, items: DataFrame, id_col: str) -> DataFrame:
    """Entries whose row does not exist."""
    return index.join(items.select(F.col(id_col).alias("id")), "id", "left_anti").select(*index.columns)


def stale(index: DataFrame, expected: DataFrame) -> DataFrame:
    """Entries that the table does not call for: dangling ones, and ones with old values."""
    return index.join(expected, expected.columns, "left_anti").select(*index.columns)


def missing(index: DataFrame, expected: DataFrame) -> DataFrame:
    """Entries that the table calls for and the index lacks."""
    return expected.join(index, expected.columns, "left_anti").select(*expected.columns)


@dataclass(frozen=True)
class Report:
    dangling: int
    stale: int
    missing: int

    @property
    def healthy(self) -> bool:
        return not (self.dangling or self.stale or self.missing)


def summary(index: DataFrame, items: DataFrame, entity: EntitySpec, spec: IndexSpec) -> DataFrame:
    """One row: n_dangling, n_stale, n_missing."""
    expected = spec.kind.expected(items, entity, spec)
    parts = {"n_dangling": dangling(index, items, entity.id), "n_stale": stale(index, expected), "n_missing": missing(index, expected)}
    every = None
    for name, found in parts.items():
        one = found.select(F.lit(name).alias("part"))
        every = one if every is None else every.union(one)
    return every.agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])


def check(index: DataFrame, items: DataFrame, entity: EntitySpec, spec: IndexSpec) -> Report:
    row = summary(index, items, entity, spec).first()
    return Report(row["n_dangling"], row["n_stale"], row["n_missing"])


@dataclass(frozen=True)
class Scrubbing:
    """How a check runs: whether it repairs, how often a failed attempt is repeated and after which pause, and how long all may take.

    Limits on entries or bytes of one step do not exist here: Spark cuts the work into tasks.
    """

    allow_repair: bool = False
    max_retries: int = 10
    retry_delay: float = 0.1
    timeout: float | None = None

    @classmethod
    def default(cls) -> Scrubbing:
        return cls()

    @classmethod
    def conservative(cls) -> Scrubbing:
        return cls(max_retries=5, retry_delay=0.2)

    @classmethod
    def aggressive(cls) -> Scrubbing:
        return cls(allow_repair=True, max_retries=20, retry_delay=0.05)


@dataclass(frozen=True)
class Outcome:
    """What a check found and did. healthy: nothing is wrong with the index now."""

    healthy: bool
    completed: bool
    report: Report
    repaired: int = 0
    attempts: int = 1
    seconds: float = 0.0
    reason: str | None = None


def scrub(engine: Engine, index: str, how: Scrubbing = Scrubbing()) -> Outcome:
    """Checks a stored index against its table, and writes it anew where that is allowed and something is wrong.

    A failed attempt is repeated up to max_retries times. The engine's delegate gets the counts.
    """
    entity, spec = engine.catalog.owner(index)
    began, attempts = time.perf_counter(), 0
    while True:
        attempts += 1
        try:
            items, stored = engine.backend.read(entity), engine.index(index)
            report, fixed = check(stored, items, entity, spec), 0
            if how.allow_repair and not report.healthy:
                engine.backend.commit({}, {index: repaired(stored, items, entity, spec)})
                fixed = report.stale + report.missing
            break
        except Exception as error:
            engine.delegate.did_fail("scrub", error)
            late = how.timeout is not None and time.perf_counter() - began > how.timeout
            if attempts > how.max_retries or late:
                raise ScrubError(f"{index}: {attempts} attempts, the last: {error}") from error
            time.sleep(how.retry_delay)
    seconds = time.perf_counter() - began
    engine.delegate.did_scrub(index, {"dangling": report.dangling, "stale": report.stale, "missing": report.missing, "repaired": fixed, "retries": attempts - 1}, seconds)
    return Outcome(report.healthy or fixed > 0, True, report, fixed, attempts, seconds)


def repaired(index: DataFrame, items: DataFrame, entity: EntitySpec, spec: IndexSpec) -> DataFrame:
    """The index as it should be, with right entries kept as they are."""
    expected = spec.kind.expected(items, entity, spec)
    return index.join(expected, expected.columns, "left_semi").select(*expected.columns).unionByName(missing(index, expected))
