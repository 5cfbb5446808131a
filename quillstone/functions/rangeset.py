"""Sets of half-open ranges as rows (lo, hi): normal form, cover, what is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Into how many stretches the lower ends are cut, so that one group is several tasks' work.
CUTS = 64


def normalized(ranges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group..., lo, hi): overlapping and touching ranges joined; empty ranges dropped.

    Lower ends are cut into stretches by approximate quantiles, and the ranges of a group are
    walked through a stretch at a time. What reaches into a stretch from before, and
    the joined range that goes on in it, comes from one row for each stretch.
    """
    keys = group or []
    rows = ranges.where("lo < hi").select(*keys, "lo", "hi")
    kind, edges = rows.schema["lo"].dataType, []
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        edges = sorted(set(rows.agg(F.percentile_approx("lo", [k / CUTS for k in range(1, CUTS)])).first()[0] or []))
    stretch = F.size(F.filter(F.array(*[F.lit(e).cast(kind) for e in edges]), lambda e: e <= F.col("lo"))) if edges else F.lit(0)
    rows = rows.withColumn("_stretch", stretch)
    along = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    within = Window.partitionBy(*keys, "_stretch").orderBy("lo", "hi")
    before, so_far = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)

    def with_earlier(df: DataFrame, summary: DataFrame) -> DataFrame:
        b = summary.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, "_stretch"]], summary.columns[-1])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_stretch"]])
        return df.join(b, same).drop(*[f"_of_{k}" for k in [*keys, "_stretch"]])

    tops = rows.groupBy(*keys, "_stretch").agg(F.max("hi").alias("_top"))
    rows = with_earlier(rows, tops.select(*keys, "_stretch", F.max("_top").over(along).alias("_reach")))
    reach = F.greatest("_reach", F.max("hi").over(before))
    marked = rows.withColumn("_begin", F.when(reach.isNull() | (F.col("lo") > reach), F.col("lo")))
    lasts = marked.groupBy(*keys, "_stretch").agg(F.max("_begin").alias("_last"))
    marked = with_earlier(marked, lasts.select(*keys, "_stretch", F.max("_last").over(along).alias("_open")))
    islands = marked.withColumn("_begin", F.coalesce(F.max("_begin").over(so_far), "_open"))
    return islands.groupBy(*keys, F.col("_begin").alias("lo")).agg(F.max("hi").alias("hi"))


class RangeSet:
    """The ranges of one job that are still to do; a few rows of metadata, kept on the driver."""

    def __init__(self, ranges: list[tuple]):
        self.todo = self._joined(ranges)

    @staticmethod
    def _joined(ranges: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for lo, hi in sorted(r for r in ranges if r[0] < r[1]):
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], hi))
            else:
                out.append((lo, hi))
        return out

    def next_batch(self) -> tuple | None:
        return self.todo[0] if self.todo else None

    def mark_completed(self, lo, hi) -> None:
        """Takes [lo, hi) out: a range may vanish, lose an end, or split."""
        self.todo = [r for a, b in self.todo for r in ((a, min(b, lo)), (max(a, hi), b)) if r[0] < r[1]]

    def contains(self, key) -> bool:
        return any(a <= key < b for a, b in self.todo)

    @property
    def is_empty(self) -> bool:
        return not self.todo
