"""Readers of the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``, one Parquet file or folder each."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
