"""Latest-row joins, anti joins, ordered look-ups and topic resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediagauge.functions.literal import literal_table
from mediagauge.functions.text import display_name, keyword_domain, normalize_topic, slugify
from mediagauge.operators.views import latest_per_key
from mediagauge import config as C


def latest_embedding(embeddings: DataFrame, complete_only: bool) -> DataFrame:
    """The newest embedding row of each article, then the larger id; of complete rows only if asked."""
    rows = embeddings.where("article_id is not null")
    rows = rows.where("status = 'complete'") if complete_only else rows
    return latest_per_key(rows, "article_id", F.col("embedded_at").desc_nulls_last(), F.desc("embedding_id"))


def pending_articles(articles: DataFrame, signals: DataFrame) -> DataFrame:
    """Articles without any signal, each id once."""
    return articles.select("article_id").where("article_id is not null").distinct().join(signals.select("article_id"), "article_id", "left_anti")


def same_model_rows(embeddings: DataFrame) -> DataFrame:
    """Embedding rows whose model version is that of the article's newest row."""
    w = Window.partitionBy("article_id").orderBy(F.col("embedded_at").desc_nulls_last(), F.desc("embedding_id")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = embeddings.where("article_id is not null").withColumn("newest", F.first("model_version").over(w))
    return rows.where(F.col("model_version") == F.col("newest")).drop("newest")


def embedding_work(articles: DataFrame, embeddings: DataFrame) -> DataFrame:
    """What the embedding stage has to do for each article: missing, current, retry_failed, stale."""
    newest = latest_embedding(embeddings, complete_only=False).select("article_id", "status", "model_version")
    joined = articles.join(newest, "article_id", "left")
    state = (
        F.when(F.col("status").isNull(), "missing")
        .when((F.col("status") == "complete") & (F.col("model_version") == F.lit("v2.1")), "current")
        .when(F.col("model_version") == F.lit("v2.1"), "retry_failed")
        .otherwise("stale")
    )
    return joined.select("article_id", state.alias("work"))


def in_given_order(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows with a key of ``ids``, with ``pos``, their place in the list; a key listed twice comes twice."""
    kind = df.schema[key].dataType.simpleString()
    order = df.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, `{key}` {kind}")
    return F.broadcast(order).join(df, key)


def null_safe_scope(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which a null language matches only a null one."""
    a, b = left.alias("a"), right.alias("b")
    test = F.lit(True)
    for k in keys:
        test = test & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, test, how)


def alias_table(spark) -> DataFrame:
    """Catalogued aliases: ``alias_key, canonical_topic_id, language, pos``."""
    rows, pos = [], 0
    for seed in C.TOPIC_SEEDS:
        rows.append((seed["topic"], seed["topic"], None, pos))
        for language in C.SEED_LANGUAGES:
            for name in seed[language]:
                pos += 1
                rows.append((name, seed["topic"], language, pos))
    df = literal_table(spark, rows, "alias string, canonical_topic_id string, language string, pos int")
    return df.withColumn("alias_key", normalize_topic(F.col("alias"))).drop("alias")


def resolve_topics(raw: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical topic of each (topic, language): exact language first, then none, then any; else a new slug.

    Also display name and domain of the topic. Null topics are left out.
    """
    rows = raw.where("topic is not null").select("topic", "language").distinct().withColumn("alias_key", normalize_topic(F.col("topic")))
    joined = rows.join(F.broadcast(aliases.withColumnRenamed("language", "alias_language")), "alias_key", "left")
    rank = F.when(F.col("alias_language") == F.lower("language"), 0).when(F.col("alias_language").isNull(), 1).otherwise(2)
    w = Window.partitionBy("topic", "language").orderBy(rank, "pos")
    best = joined.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return best.select(
        "topic",
        "language",
        F.coalesce("canonical_topic_id", slugify(F.col("topic"))).alias("canonical"),
        display_name(F.col("topic")).alias("display"),
        keyword_domain(F.col("topic"), C.DOMAIN_KEYWORDS, C.DEFAULT_DOMAIN).alias("domain"),
        F.col("canonical_topic_id").isNotNull().alias("known"),
    )


def model_version(versions: DataFrame, default: str = "none") -> DataFrame:
    """One row: the only model version of the rows, ``mixed`` for several, ``default`` for none."""
    found = F.array_distinct(F.collect_set("model_version"))
    return versions.agg(F.when(F.size(found) == 0, default).when(F.size(found) == 1, found[0]).otherwise("mixed").alias("model_version"))


def panel_outlets(domain: str, country: str | None, panels: dict[str, list[str]], extras: dict[str, list[str]]) -> list[str]:
    """Outlets of a fixed panel: those of the country, or of all countries, then the domain's, each once."""
    chosen = panels.get(country.strip().upper(), []) if country and country.strip() else [o for names in panels.values() for o in names]
    return list(dict.fromkeys([*chosen, *extras.get(domain, [])]))
