"""Intermediate tables below the shared folder of the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfcast.session import delete_path, scratch_path


def stored(df: DataFrame, name: str, compression: str = "snappy") -> tuple[DataFrame, str]:
    """Write df to a new path of the shared folder; the table read back, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    delete_path(spark, path)
