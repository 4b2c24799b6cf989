"""Queries on cut texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediagauge.llm.truncation import inspected_values, length_limits, truncated_values, truncation_rates
from mediagauge.tables import table


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Bodies and summaries that were cut."""
    return truncated_values(table(spark, root, "articles"), table(spark, root, "feeds"))


def p6_rates(spark: SparkSession, root: str) -> DataFrame:
    """How often each outlet's bodies and summaries are cut."""
    return truncation_rates(table(spark, root, "articles"), table(spark, root, "feeds"))


def p6_limits(spark: SparkSession, root: str) -> DataFrame:
    """The storage limits that the lengths expose."""
    return length_limits(inspected_values(table(spark, root, "articles"), table(spark, root, "feeds")))


QUERIES = {"p6_found": p6_found, "p6_rates": p6_rates, "p6_limits": p6_limits}
SQL: dict[str, str] = {}
