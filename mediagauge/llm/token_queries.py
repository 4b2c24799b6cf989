"""Queries on the encoding of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediagauge.llm.tokens import encoded, round_trips, token_counts
from mediagauge.tables import table


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    return encoded(table(spark, root, "documents"))


def p8_source_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Documents, tokens and characters per token of each source."""
    return token_counts(table(spark, root, "documents"))


def p8_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Whether each document's ids decode to its text."""
    return round_trips(table(spark, root, "documents"))


# No SQL: a constant would test nothing; the tests decode the ids.
SQL: dict[str, str] = {}
QUERIES = {"p8_ids": p8_ids, "p8_source_tokens": p8_source_tokens, "p8_round_trip": p8_round_trip}
