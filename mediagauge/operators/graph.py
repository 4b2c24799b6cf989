"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagauge.session import discard, materialize


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step; ``edges`` hold each link once with a > b.

    The smallest neighbour comes from a partially aggregated minimum and a join with one row
    per node, so a node with very many links is split by the skew join, not gathered.
    """
    if large:
        links = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        links = edges
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = links.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``id, root`` for every id that occurs in an edge; root is the smallest id of its component.

    Alternating large-star and small-star steps; every round is written to the shared folder,
    so lineage stays short and a lost executor costs one round at most. Self-links and nulls
    are ignored, but an id that only links to itself is still returned. An empty edge table
    gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    start = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = materialize(start, "components")
    before = _fingerprint(current)
    for _ in range(max_rounds):
        after_df = materialize(_star(_star(current, large=True), large=False), "components")
        discard(current)
        current, after = after_df, _fingerprint(after_df)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("a").alias("id"), F.col("b").alias("root"))
    selves = current.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    lone = pairs.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("root")).distinct()
    return roots.union(selves).union(lone.join(roots.union(selves), "id", "left_anti"))
