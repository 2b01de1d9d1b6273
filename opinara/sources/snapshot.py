"""Typed snapshots of intermediate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_snapshot(df: DataFrame, path: str, mode: str = "errorifexists",
                   partition_by: Sequence[str] = ()) -> None:
    """Parquet snapshot, optionally laid out by columns that later reads filter on."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_snapshot(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df
