"""Partitioned layouts: fields of a row as directories, so that a filter opens only what it needs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import SchemaError


def scratch_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or one beneath the warehouse in a local session without it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


def directory_path(parts: list[str | tuple[str, object]]) -> str:
    """A path of literals and (field, value) pairs; a pair becomes field=value. A partition needs one pair at least."""
    if not any(isinstance(p, tuple) for p in parts):
        raise SchemaError("a partition path needs a field")
    return "/".join(f"{p[0]}={p[1]}" if isinstance(p, tuple) else p for p in parts)


def write_partitioned(df: DataFrame, path: str, fields: tuple[str, ...]) -> None:
    """Rows under path, one directory for each combination of the fields; a large one is split over files by Spark."""
    if not fields:
        raise SchemaError("a partitioned layout needs a field")
    df.hint("rebalance", *fields).write.partitionBy(*fields).parquet(path)


def partitioned_table(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The rows of df, written by the fields into the shared folder and read again with df's types."""
    path = f"{scratch_folder(df.sparkSession)}/layout-{uuid.uuid4().hex}"
    write_partitioned(df, path, fields)
    return df.sparkSession.read.schema(df.schema).parquet(path)
