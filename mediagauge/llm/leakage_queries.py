"""Queries on evaluation texts in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge.llm.leakage import leaked_pairs, leaked_spans
from mediagauge.tables import table


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with twelve consecutive words of an evaluation item."""
    return leaked_pairs(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_spans(spark: SparkSession, root: str) -> DataFrame:
    """The word spans to remove from each document."""
    return leaked_spans(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    """Every evaluation item with the number of documents that contain a passage of it."""
    items = table(spark, root, "eval_items")
    counts = leaked_pairs(table(spark, root, "documents"), items).groupBy("item_id").agg(F.count("*").alias("documents"))
    return items.select("item_id", "item_set").join(counts, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


QUERIES = {"p9_found": p9_found, "p9_spans": p9_spans, "p9_items": p9_items}
SQL: dict[str, str] = {}
