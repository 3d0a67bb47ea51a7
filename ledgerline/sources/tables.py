"""Parquet tables stored side by side in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``<folder>/<name>.parquet``, a single file or a directory of files."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
