"""Changes to a table as plans: upserts, deletions, batches, reads with pending changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.predicate import Predicate, compile

#: What a store takes, in bytes.
KEY_LIMIT, VALUE_LIMIT = 10_000, 100_000


def upserted(base: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """base with rows put in the place of those with their ids, or added."""
    return base.join(rows.select(id_col), id_col, "left_anti").select(*base.columns).unionByName(rows)


def deleted(base: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """base without the rows of the ids; unknown ids do no harm."""
    return base.join(ids.select(id_col), id_col, "left_anti").select(*base.columns)


def deleted_where(base: DataFrame, predicate: Predicate) -> DataFrame:
    """base without the rows for which the predicate holds; a missing value does not hold."""
    return base.where(compile(predicate, base.schema, wanted=False))


def applied(base: DataFrame, rows: DataFrame | None, ids: DataFrame | None, id_col: str) -> DataFrame:
    """One batch: first the upserts, then the deletions, so an id in both is gone."""
    out = base if rows is None else upserted(base, rows, id_col)
    return out if ids is None else deleted(out, ids, id_col)


def multi_get(df: DataFrame, ids: DataFrame, id_col: str, place: str) -> DataFrame:
    """The rows of listed ids with the ids' places; ids without a row are left out."""
    return ids.join(df, id_col).select(*df.columns, place)


def oversized(df: DataFrame, id_col: str, value: str, key_limit: int = KEY_LIMIT, value_limit: int = VALUE_LIMIT) -> DataFrame:
    """(id, key_bytes, value_bytes) of rows that the store would refuse."""
    sizes = df.select(F.col(id_col), F.octet_length(F.col(id_col).cast("string")).alias("key_bytes"), F.octet_length(value).alias("value_bytes"))
    return sizes.where((F.col("key_bytes") > key_limit) | (F.col("value_bytes") > value_limit))


def keyset_page(df: DataFrame, id_col: str, after, size: int) -> DataFrame:
    """The next rows in the order of ids: what follows the last id seen."""
    rest = df if after is None else df.where(F.col(id_col) > F.lit(after))
    return rest.orderBy(id_col).limit(size)
