"""Queries on feed-supplied timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediagauge.operators.timestamps import normalized_instants, zone_table
from mediagauge.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """The instant of every article whose published_at denotes one."""
    return normalized_instants(table(spark, root, "articles"), table(spark, root, "feeds"))


def p2_zone_table(spark: SparkSession, root: str) -> DataFrame:
    """The offset changes used for the feeds' zones."""
    return zone_table(table(spark, root, "feeds"))


QUERIES = {"p2_found": p2_found, "p2_zone_table": p2_zone_table}
SQL: dict[str, str] = {}
