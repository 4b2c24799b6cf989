"""Queries on cluster signals, observations, extraction and briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.operators import brief as B
from mediagauge.operators import clusters as K
from mediagauge.operators import extraction as X
from mediagauge.operators import observations as O
from mediagauge.operators.latest import alias_table
from mediagauge.operators.views import article_view, signal_view
from mediagauge.plans import clusters as PC
from mediagauge.plans import profiles as PP
from mediagauge.plans import selection as PS
from mediagauge.plans import sqltext as S
from mediagauge.plans.texts import _KEYED, _SEEDS, _one
from mediagauge.tables import table


def cluster_signals(spark: SparkSession, root: str) -> DataFrame:
    """Signals of every cluster."""
    return PC._signals(spark, root).select(*O.KEY, "member_count", *C.SIGNALS, "frame", "label")


def _observed(spark: SparkSession, root: str) -> DataFrame:
    told = PC._told(spark, root)
    return O.observations(*told, PC._matches(spark, root, told), S.DOMAIN)


def cluster_observations(spark: SparkSession, root: str) -> DataFrame:
    """Stories of the second run against the first."""
    return _observed(spark, root).select("cluster_id", "track_id", "match_type", "signal_drift", "drift_magnitude", "frame_shift", "confidence", "direction")


def cluster_segment_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Stories per segment."""
    return O.segment_rollup(_observed(spark, root))


def top_observations(spark: SparkSession, root: str) -> DataFrame:
    """The four stories that a brief would show."""
    return O.select_observations(_observed(spark, root)).select("cluster_id", "track_id", "match_type", "rank", "drift_magnitude")


def cue_signals(spark: SparkSession, root: str) -> DataFrame:
    """Signals that the built-in extractor gives the articles, per frame."""
    articles = article_view(table(spark, root, "articles"), ("title", "summary", "body"))
    answers = X.cue_extractor(articles).withColumn("affinity_tag", F.lit(None).cast("string"))
    return X.normalized_answers(answers, "commerce").groupBy("frame").agg(F.count("*").alias("articles"), F.round(F.sum("concern_level"), 3).alias("concern"))


def topic_relevance(spark: SparkSession, root: str) -> DataFrame:
    """Relevance of every article for a topic's terms by text alone."""
    articles = article_view(table(spark, root, "articles"), ("title", "summary"))
    score = X.relevance(["školních", "schulen", "classes"], F.col("title"), F.col("summary"))
    return articles.select("article_id", score.alias("relevance")).where(F.col("relevance") >= C.RELEVANCE_THRESHOLD)


def derived_topic_links(spark: SparkSession, root: str) -> DataFrame:
    """Topic links that follow from the articles' own topics."""
    return X.derived_links(article_view(table(spark, root, "articles")), alias_table(spark)).groupBy("canonical_topic_id").agg(F.countDistinct("article_id").alias("articles"))


def title_entities(spark: SparkSession, root: str) -> DataFrame:
    """Articles per capitalised name in their titles."""
    articles = article_view(table(spark, root, "articles"), ("title",))
    return articles.select("article_id", F.explode(X.entities(F.col("title"))).alias("entity")).groupBy("entity").agg(F.countDistinct("article_id").alias("articles"))


def brief_row(spark: SparkSession, root: str) -> DataFrame:
    """The deterministic brief of a topic."""
    return B.brief(PP.segment_drift(spark, root), S.TOPIC)


_rank = "row_number() over (order by case alert_level when 'strong' then 3 when 'mild' then 2 when 'none' then 1 else 0 end desc, drift_magnitude desc, confidence desc, article_count desc, segment)"
_REL = lambda t: f"case when contains(lower(coalesce(title, '')), '{t}') then 1.0::double when contains(lower(concat_ws(' ', title, summary)), '{t}') then 0.95::double else 0.0::double end"
SQL = {
    "topic_relevance": f"""with {_one("title", "summary")}, r as (select article_id, greatest({_REL("školních")}, {_REL("schulen")}, {_REL("classes")}) as relevance from one)
        select * from r where relevance >= {C.RELEVANCE_THRESHOLD}""",
    "derived_topic_links": rf"""with {S.ARTICLE}, seeds(alias_key, known, alias_language, pos) as (values {", ".join(_SEEDS)}), k as (select alias_key, arg_min(known, pos) as known from seeds group by 1),
        l as (select article_id, topic, canonical_topic_id, {_KEYED} as alias_key from art where topic is not null)
        select coalesce(known, canonical_topic_id) as canonical_topic_id, count(distinct article_id) as articles from l left join k using (alias_key) group by 1""",
    "title_entities": rf"""with {_one("title")}, e as (select article_id, unnest(list_distinct(list_transform(regexp_extract_all(title, '\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+){{1,3}}'), lambda x: lower(x)))) as entity from one)
        select entity, count(distinct article_id) as articles from e group by 1""",
    "brief_row": f"""with d as ({PP.SQL["segment_drift"]}), s as ({PS.SQL["segment_ranking"]}), r as (select d.*, t.drift_type, {_rank.replace("segment)", "d.segment)").replace("alert_level", "d.alert_level")} as rank_ from d join (select segment, drift_type from s) t on d.segment = t.segment)
        select '{S.TOPIC}' as topic, case when bool_or(status = 'ready') then 'ready' when max(article_count) = 0 then 'insufficient_data' else 'warming' end as status,
          arg_min(segment, rank_) as most_affected_segment, arg_min(drift_type, rank_) as drift_type, arg_min(drift_magnitude, rank_) as drift_magnitude,
          arg_min(alert_level, rank_) as alert_level, array_to_string(list(segment order by rank_)[1:3], ',') as hypothesis_segments,
          case when arg_min(confidence, rank_) >= 0.7 then 'high' when arg_min(confidence, rank_) >= 0.4 then 'medium' else 'exploratory' end as confidence_label,
          max(confidence) < 0.4 as low_confidence_warning, sum(article_count)::bigint as articles from r""",
}
QUERIES = {
    f.__name__: f
    for f in (cluster_signals, cluster_observations, cluster_segment_rollup, top_observations, cue_signals, topic_relevance, derived_topic_links, title_entities, brief_row)
}
