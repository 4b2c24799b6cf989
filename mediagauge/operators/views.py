"""Views of the pipeline's tables that the operators start from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagauge.config import FRAME_ALIASES, SEGMENTS, SIGNALS
from mediagauge.functions.text import canonical_frame


@dataclass(frozen=True)
class Scope:
    """What a question is about; None leaves a part open. topic matches a canonical id or a raw topic."""

    topic: str | None = None
    country: str | None = None
    outlet: str | None = None
    language: str | None = None


def scope_filter(scope: Scope) -> Column:
    """Country, outlet and language of a scope as one predicate; an open scope keeps every row."""
    test = F.lit(True)
    if scope.country:
        test = test & (F.col("country") == scope.country.strip().upper())
    if scope.outlet:
        test = test & (F.col("outlet_lc") == scope.outlet.strip().lower())
    if scope.language:
        test = test & (F.lower("language") == scope.language.strip().lower())
    return test


def article_view(articles: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per article_id, its first delivery: outlet_lc, country, language, topics, fetched_at and ``columns``.

    Of deliveries at the same time the smallest values count; a null time is last.
    """
    fields = ["fetched_at", "outlet", "country", "language", "topic", "canonical_topic_id", *columns]
    first = F.min_by(F.struct(*fields), F.struct(F.col("fetched_at").isNull().alias("late"), *fields)).alias("r")
    one = articles.where("article_id is not null").groupBy("article_id").agg(first).select("article_id", "r.*")
    return one.withColumn("outlet_lc", F.lower(F.trim("outlet")))


def signal_view(signals: DataFrame) -> DataFrame:
    """The latest version of every signal, frames canonical; of equal times the larger values count."""
    fields = ["extracted_at", "run_id", "article_id", "outlet", "topic", "canonical_topic_id", "topic_relevance_score", *SIGNALS, "dominant_frame", *[f"seg_{s}" for s in SEGMENTS]]
    latest = signals.where("signal_id is not null").groupBy("signal_id").agg(F.max(F.struct(*fields)).alias("r")).select("signal_id", "r.*")
    framed = latest.withColumn("frame", canonical_frame(F.col("dominant_frame"), FRAME_ALIASES))
    return framed.withColumn("outlet_lc", F.lower(F.trim("outlet")))


def topic_links(signals: DataFrame) -> DataFrame:
    """``article_id, topic, canonical_topic_id, relevance, matched_at``: the strongest link of an article to a topic."""
    rows = signals.where("article_id is not null")
    score = F.when(~F.isnan("topic_relevance_score"), F.col("topic_relevance_score"))
    return rows.groupBy("article_id", "topic", "canonical_topic_id").agg(F.max(score).alias("relevance"), F.max("extracted_at").alias("matched_at"))


def in_topic(df: DataFrame, links: DataFrame, topic: str | None) -> DataFrame:
    """Rows of ``df`` whose article has a link to the topic, by canonical id or raw topic; all rows for no topic.

    ``links`` is anything with article_id, topic and canonical_topic_id; both tests reach its scan.
    """
    if not topic:
        return df
    hit = links.where((F.col("canonical_topic_id") == topic) | (F.col("topic") == topic)).select("article_id").distinct()
    return df.join(hit, "article_id", "left_semi")


def trailing(ts: str, as_of: str, days: int) -> Column:
    """Within ``days`` before ``as_of``, no upper bound."""
    return F.col(ts) >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))


def between(ts: str, begin: str, end: str, closed: bool = False) -> Column:
    """[begin, end), or [begin, end] if closed."""
    low, high = F.lit(begin).cast("timestamp"), F.lit(end).cast("timestamp")
    return (F.col(ts) >= low) & ((F.col(ts) <= high) if closed else (F.col(ts) < high))


def latest_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
