"""Queries on sizes, readiness and stored labels, and batches of feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.functions.text import canonical_drift_type, canonical_segment, collapse_space
from mediagauge.operators import clusters as K
from mediagauge.operators.outlets import with_standard_outlet
from mediagauge.operators.views import article_view
from mediagauge.plans import sqltext as S
from mediagauge.plans.clusters import _MEM
from mediagauge.sources.scans import enabled_feeds
from mediagauge.tables import table

LEAST_MEMBERS = 5
FEEDS_A_BATCH = 10
#: Pieces of evidence kept, and characters of each.
EVIDENCE, EVIDENCE_CHARS = 2, 280


def large_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Clusters of at least five distinct articles."""
    sizes = K.members(table(spark, root, "cluster_memberships")).groupBy(*K.KEY).agg(F.countDistinct("article_id").alias("articles"))
    return sizes.where(F.col("articles") >= LEAST_MEMBERS)


def cluster_readiness(spark: SparkSession, root: str) -> DataFrame:
    """Per run: clusters, those of which a member has a signal, and whether all have one."""
    members = K.members(table(spark, root, "cluster_memberships")).select(*K.KEY, "article_id").distinct()
    told = table(spark, root, "signals").where("signal_id is not null and article_id is not null").select("article_id", F.lit(1).alias("told")).distinct()
    per = members.join(told, "article_id", "left").groupBy(*K.KEY).agg(F.max(F.coalesce("told", F.lit(0))).alias("told"))
    return per.groupBy("run_id").agg(F.count("*").alias("clusters"), F.sum("told").alias("with_signals"), (F.min("told") == 1).alias("ready"))


def relevance_labels(spark: SparkSession, root: str) -> DataFrame:
    """Rows of signals per relevance label as it is stored; without a score it is empty."""
    score = F.when(~F.isnan("topic_relevance_score"), F.col("topic_relevance_score"))
    label = F.when(score.isNull(), "").when(score < C.RELEVANCE_THRESHOLD, "0").when(score < C.RELEVANCE_HIGH, "1").otherwise("2")
    return table(spark, root, "signals").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def outlet_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Per feed: deliveries, articles, and the share of deliveries that repeat one; a rate over nothing is 0."""
    feeds = enabled_feeds(table(spark, root, "feeds"))
    rows = with_standard_outlet(table(spark, root, "articles").select("article_id", "outlet"), feeds.select("outlet", "outlet_name", "host"))
    counts = rows.where("std_outlet is not null").groupBy("std_outlet").agg(F.count("*").alias("deliveries"), F.countDistinct("article_id").alias("articles"))
    joined = feeds.select(F.col("outlet").alias("std_outlet")).join(counts, "std_outlet", "left").na.fill(0, ["deliveries", "articles"])
    rate = F.when(F.col("deliveries") > 0, F.round((F.col("deliveries") - F.col("articles")) / F.col("deliveries"), 4)).otherwise(0.0)
    return joined.withColumn("repeat_rate", rate)


def feed_batches(spark: SparkSession, root: str) -> DataFrame:
    """Enabled feeds in batches of ten, in the order of their codes."""
    place = F.row_number().over(Window.orderBy("outlet")) - 1
    return enabled_feeds(table(spark, root, "feeds")).select("outlet", F.floor(place / FEEDS_A_BATCH).alias("batch"))


def article_evidence(spark: SparkSession, root: str) -> DataFrame:
    """The first two non-blank ones of each article's title, summary and body, collapsed and cut to 280 characters."""
    articles = article_view(table(spark, root, "articles"), ("title", "summary", "body"))
    texts = F.filter(F.transform(F.array("title", "summary", "body"), collapse_space), lambda t: t != "")
    return articles.select("article_id", F.array_join(F.transform(F.slice(texts, 1, EVIDENCE), lambda t: F.substring(t, 1, EVIDENCE_CHARS)), " | ").alias("evidence"))


def given_names(spark: SparkSession, root: str) -> DataFrame:
    """Canonical segment and drift type of names as briefs may give them, made from the feeds' affinity tags."""
    tags = enabled_feeds(table(spark, root, "feeds")).where("affinity_tag is not null")
    said = tags.select(F.concat(F.initcap(F.regexp_replace("affinity_tag", "_", " ")), F.lit(" (readers)")).alias("segment_text"), F.concat(F.lit("Unsure / "), F.lit("concern")).alias("type_text"))
    return said.distinct().select("segment_text", canonical_segment(F.col("segment_text"), C.SEGMENT_ALIASES).alias("segment"), canonical_drift_type(F.col("type_text"), C.DRIFT_TYPE_ALIASES).alias("drift_type"))


_KEYS = """keys as (select lower(trim(nfc_normalize(s))) as k, min(outlet) as std from (
    select outlet, unnest([outlet, outlet_name, host, 'www.' || host]) as s from feeds where enabled) group by 1)"""
_text = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{00a0}}]+', ' ', 'g'))"
SQL = {
    "large_clusters": f"with {_MEM} select run_id, cluster_id, count(distinct article_id) as articles from mem group by all having count(distinct article_id) >= {LEAST_MEMBERS}",
    "cluster_readiness": f"""with {_MEM}, c as (select run_id, cluster_id, max(case when article_id in (select article_id from signals where signal_id is not null and article_id is not null) then 1 else 0 end) as told from mem group by all)
        select run_id, count(*) as clusters, sum(told)::bigint as with_signals, min(told) = 1 as ready from c group by 1""",
    "relevance_labels": f"""select case when topic_relevance_score is null or isnan(topic_relevance_score) then '' when topic_relevance_score < {C.RELEVANCE_THRESHOLD} then '0'
        when topic_relevance_score < {C.RELEVANCE_HIGH} then '1' else '2' end as label, count(*) as n from signals group by 1""",
    "outlet_rollup": f"""with {_KEYS}, c as (select std, count(*) as deliveries, count(distinct article_id) as articles from articles a join keys on lower(trim(nfc_normalize(a.outlet))) = k group by 1)
        select outlet as std_outlet, coalesce(deliveries, 0) as deliveries, coalesce(articles, 0) as articles,
          coalesce(round((deliveries - articles) / deliveries, 4), 0.0) as repeat_rate from feeds left join c on std = outlet where enabled""",
    "feed_batches": f"select outlet, ((row_number() over (order by outlet) - 1) // {FEEDS_A_BATCH})::bigint as batch from feeds where enabled",
    "given_names": f"""with t as (select distinct array_to_string(list_transform(string_split(affinity_tag, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' (readers)' as segment_text,
          lower(affinity_tag) as key from feeds where enabled and affinity_tag is not null)
        select segment_text, {S.case("key", C.SEGMENT_ALIASES, "key")} as segment, 'concern_spike' as drift_type from t""",
}
QUERIES = {f.__name__: f for f in (large_clusters, cluster_readiness, relevance_labels, outlet_rollup, feed_batches, article_evidence, given_names)}
