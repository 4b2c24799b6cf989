"""The whole pipeline in stages, and the bundle of results of one scope."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge.operators import brief, clusters, density, extraction, mix, observations, profiles, ranking
from mediagauge.operators.latest import embedding_work, latest_embedding
from mediagauge.operators.views import Scope, article_view, in_topic, scope_filter, signal_view, topic_links, trailing
from mediagauge.session import materialize


@dataclass
class Stage:
    """name, status (completed, partial, failed, skipped) and what it says about it."""

    name: str
    status: str
    detail: str = ""


@dataclass
class Bundle:
    """Results of a scope by name, and the stages that made them."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    stages: list[Stage] = field(default_factory=list)

    def add(self, name: str, make: Callable[[], DataFrame | None], needs: tuple[str, ...] = ()) -> None:
        """Run a stage: skipped if what it needs is missing, failed if it raises; later stages go on."""
        lacking = [n for n in needs if n not in self.tables]
        if lacking:
            self.stages.append(Stage(name, "skipped", "needs " + ", ".join(lacking)))
            return
        try:
            made = make()
        except Exception as e:  # a stage must not end the others
            self.stages.append(Stage(name, "failed", str(e).split("\n", 1)[0][:200]))
            return
        if made is None:
            self.stages.append(Stage(name, "skipped", "nothing to do"))
        else:
            self.tables[name] = made
            self.stages.append(Stage(name, "completed"))


def stage_table(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """The stages as rows."""
    return spark.createDataFrame([(i, s.name, s.status, s.detail) for i, s in enumerate(bundle.stages)], "pos int, stage string, status string, detail string")


def run_scope(
    articles: DataFrame, signals: DataFrame, embeddings: DataFrame, topic: str, as_of: str, days: int, domain: str, scope: Scope | None = None, extractor: extraction.Extractor = extraction.cue_extractor
) -> Bundle:
    """Everything about one topic and scope: profiles, drift, mix, digest, stories, brief.

    Articles without a signal get one from ``extractor``. Stages only read; nothing is written but
    intermediate tables in the shared folder.
    """
    spark, out = articles.sparkSession, Bundle()
    scope = scope or Scope(topic=topic)
    seen = materialize(article_view(articles, ("title", "summary", "body")).where(scope_filter(scope)), "pipeline-articles")
    links = materialize(topic_links(signals), "pipeline-links")
    topical = materialize(in_topic(signal_view(signals), links, topic).join(seen.select("article_id"), "article_id", "left_semi"), "pipeline-signals")
    window = trailing("extracted_at", as_of, days)
    before = (F.col("extracted_at") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(2 * days))) & ~window
    out.add("extraction", lambda: extraction.extract_pending(seen, signals, domain, extractor))
    out.add("embedding_work", lambda: embedding_work(seen, embeddings).groupBy("work").agg(F.count("*").alias("articles")))
    out.add("profile", lambda: profiles.segment_profile(topical.where(window)))
    out.add("drift", lambda: materialize(profiles.drift_from(out.tables["profile"], profiles.seed_baselines(spark, [""]), domain), "pipeline-drift"), ("profile",))
    out.add("source_mix", lambda: mix.mix_report(topical.where(window), topical.where(before)))
    out.add("digest", lambda: ranking.digest(seen, links.where((F.col("canonical_topic_id") == topic) | (F.col("topic") == topic))).select("article_id", "title", "relevance"))
    out.add("signals", lambda: ranking.latest_rows(topical, "extracted_at", "signal_id", 20))
    vectors = latest_embedding(clusters.usable(embeddings), True).select("article_id", "embedding_id", F.col("embedding_vector").alias("vector"))
    rows = topical.where(window).select("article_id").distinct().join(vectors, "article_id").withColumn("run_id", F.lit(f"{topic}@{as_of}"))

    def stories() -> DataFrame | None:
        if rows.limit(5).count() < 5:
            return None
        labels = density.cluster_windows(rows, ["run_id"]).where("label >= 0")
        return materialize(labels.select("run_id", F.col("label").cast("bigint").alias("cluster_id"), "article_id", "strength"), "pipeline-stories")

    out.add("stories", stories)
    out.add("story_signals", lambda: observations.cluster_signals(out.tables["stories"], topical, seen), ("stories",))
    out.add("brief", lambda: brief.brief(out.tables["drift"], topic), ("drift",))
    return out
