"""Queries on embedding vectors: storylines and most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge.llm.neighbours import WIDE_PLAN, nearest_neighbours, nearest_pairs, neighbour_graph, search_graph
from mediagauge.llm.storylines import describe_storylines, described_leaves, found_storylines
from mediagauge.llm.vectors import select_vectors
from mediagauge.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Members of the storylines with at least four embeddings."""
    return found_storylines(table(spark, root, "article_embeddings"))


def p1_storylines(spark: SparkSession, root: str) -> DataFrame:
    """Size, compactness and most typical members of every storyline of two or more embeddings."""
    return describe_storylines(table(spark, root, "article_embeddings"), table(spark, root, "cluster_memberships"))


def p1_leaves(spark: SparkSession, root: str) -> DataFrame:
    """Size, dispersion and centre-nearest members of every leaf of the bisecting tree."""
    return described_leaves(table(spark, root, "article_embeddings"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of very similar embeddings of which one is among the other's three most similar."""
    return nearest_pairs(table(spark, root, "article_embeddings"))


def p7_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The three most similar other embeddings of every selected one, however unlike they are."""
    picked = nearest_neighbours(table(spark, root, "article_embeddings"))
    return picked.select(F.col("q").alias("embedding_id"), F.col("other").alias("neighbour_id"), "rank", F.round("sim", 4).alias("cosine"))


def p7_search(spark: SparkSession, root: str) -> DataFrame:
    """The three other embeddings that the graph search finds for every embedding row whose id is divisible by 100."""
    rows = table(spark, root, "article_embeddings")
    vectors = select_vectors(rows)
    asked = vectors.rows.where("embedding_id % 100 = 0").select("embedding_id")
    queries = rows.where("status = 'complete' and size(embedding_vector) = embedding_dim").join(asked, "embedding_id", "left_semi")
    queries = queries.groupBy("embedding_id").agg(F.max("embedding_vector").alias("vector")).withColumnRenamed("embedding_id", "query_id")
    graph, _ = neighbour_graph(vectors, floor=None, plan=WIDE_PLAN)
    return search_graph(vectors, graph, queries)


QUERIES = {"p1_found": p1_found, "p1_storylines": p1_storylines, "p1_leaves": p1_leaves, "p7_found": p7_found, "p7_neighbours": p7_neighbours, "p7_search": p7_search}
SQL: dict[str, str] = {}
