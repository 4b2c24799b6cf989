"""Ranked evidence: digests, top articles of segments, segment ranking, priorities, feeds of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagauge import config as C


def digest(articles: DataFrame, links: DataFrame, limit: int = 8) -> DataFrame:
    """The most relevant articles of a topic's links, then the latest, then the latest matched, then by id."""
    best = links.groupBy("article_id").agg(F.max("relevance").alias("relevance"), F.max("matched_at").alias("matched_at"))
    order = [F.col(c).desc_nulls_last() for c in ("relevance", "fetched_at", "matched_at")]
    return articles.join(best, "article_id").orderBy(*order, "article_id").limit(limit)


def segment_evidence(signals: DataFrame, least: float = 0.3, count: int = 2) -> DataFrame:
    """The latest articles of each segment whose share exceeds ``least``, all segments in one pass."""
    pairs = F.array(*[F.struct(F.lit(s).alias("segment"), F.col(f"seg_{s}").alias("share")) for s in C.SEGMENTS])
    long = signals.select("signal_id", "article_id", "extracted_at", F.explode(pairs).alias("p")).select("signal_id", "article_id", "extracted_at", "p.*")
    long = long.where((F.col("share") > least) & ~F.isnan("share"))
    w = Window.partitionBy("segment").orderBy(F.col("extracted_at").desc_nulls_last(), F.desc("share"), "signal_id")
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def latest_rows(df: DataFrame, ts: str, id_: str, limit: int) -> DataFrame:
    """The ``limit`` newest rows, then the larger id."""
    return df.orderBy(F.col(ts).desc_nulls_last(), F.desc(id_)).limit(limit)


def rank_segments(drift: DataFrame) -> DataFrame:
    """Segments by alert, magnitude, confidence, articles, name."""
    level = F.when(F.col("alert_level") == "strong", 3).when(F.col("alert_level") == "mild", 2).when(F.col("alert_level") == "none", 1).otherwise(0)
    w = Window.partitionBy().orderBy(F.desc(level), F.desc("drift_magnitude"), F.desc("confidence"), F.desc("article_count"), "segment")
    return drift.withColumn("rank", F.row_number().over(w))


def priorities(df: DataFrame, score: Column, digits: int = 4) -> DataFrame:
    """Non-negative scores as shares of their sum; all 0 if there is nothing to share."""
    s = F.greatest(F.lit(0.0), score)
    total = F.sum(s).over(Window.partitionBy())
    return df.withColumn("priority", F.when(total > 0, F.round(s / total, digits)).otherwise(0.0))


def drift_type() -> Column:
    """What a segment's drift is: the signal with the largest change if it rose, else frame shift, stable or mixed."""
    values = [F.abs(F.coalesce(f"delta_{k}", F.lit(0.0))) for k in C.SIGNALS]
    top = F.greatest(*values)
    names = ("concern_spike", "purchase_surge", "avoidance_rise")
    rising = None
    for k, v, name in zip(C.SIGNALS, values, names, strict=True):
        test = (v == top) & (F.coalesce(f"delta_{k}", F.lit(0.0)) > 0)
        rising = F.when(test, name) if rising is None else rising.when(test, name)
    return F.coalesce(rising, F.when(F.col("frame_shift"), "frame_shift").when(F.col("drift_magnitude") <= 0, "stable").otherwise("mixed"))


def confidence_words(c: Column) -> Column:
    """high, medium or exploratory."""
    return F.when(c >= 0.7, "high").when(c >= C.READY_CONFIDENCE, "medium").otherwise("exploratory")
