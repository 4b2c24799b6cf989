"""Queries on the labels of several annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge.llm.consensus import consensus_items, discover, strict_consensus, valid_votes
from mediagauge.tables import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Labels that more than half of at least three annotators agree on."""
    return strict_consensus(*(table(spark, root, t) for t in ("model_labels", "label_aliases", "articles")))


def p4_consensus(spark: SparkSession, root: str) -> DataFrame:
    """Consensus of every item beside the earlier majority baseline."""
    found = discover(valid_votes(table(spark, root, "model_labels"), table(spark, root, "label_aliases")))
    baseline = table(spark, root, "majority_baseline").groupBy("article_id", "field_name").agg(F.max("strict_majority_baseline").alias("baseline_label"))
    return consensus_items(found).join(baseline, ["article_id", "field_name"], "left").withColumn("equals_baseline", F.col("consensus_label") == F.col("baseline_label"))


def p4_anchors(spark: SparkSession, root: str) -> DataFrame:
    """The items whose label a majority settles, unknown articles included."""
    found = discover(valid_votes(table(spark, root, "model_labels"), table(spark, root, "label_aliases")))
    return consensus_items(found).where("anchored").select("article_id", "field_name", "consensus_label", "votes", "agreement")


def p4_annotators(spark: SparkSession, root: str) -> DataFrame:
    """Votes, weight and reliability of each annotator."""
    return discover(valid_votes(table(spark, root, "model_labels"), table(spark, root, "label_aliases"))).annotators


SQL = {
    "p4_found": """
with votes as (
  select article_id, field_name, lower(trim(annotator)) as annotator, lower(trim(label)) as alias,
    row_number() over (partition by article_id, field_name, lower(trim(annotator)) order by labelled_at desc nulls last, vote_id desc nulls last) as rn
  from model_labels where article_id in (select article_id from articles) and trim(annotator) <> '' and field_name is not null),
known as (select field_name, lower(trim(alias)) as alias, min(canonical_label) as label from label_aliases group by 1, 2),
named as (select v.article_id, v.field_name, k.label from votes v join known k using (field_name, alias) where v.rn = 1),
counts as (select article_id, field_name, label, count(*) as n from named group by all),
totals as (select article_id, field_name, sum(n) as total from counts group by all)
select article_id, field_name, label as consensus_label from counts join totals using (article_id, field_name) where total >= 3 and n * 2 > total
"""
}
# Of an anchored item the consensus is its majority whatever the weights are.
SQL["p4_anchors"] = SQL["p4_found"].replace("from model_labels where article_id in (select article_id from articles) and", "from model_labels where article_id is not null and")
SQL["p4_anchors"] = SQL["p4_anchors"].replace("consensus_label from counts", "consensus_label, cast(total as bigint) as votes, round(n / total, 6) as agreement from counts")
QUERIES = {"p4_anchors": p4_anchors, "p4_found": p4_found, "p4_consensus": p4_consensus, "p4_annotators": p4_annotators}
