"""Queries on label quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.operators import evaluation as E
from mediagauge.operators.views import article_view, signal_view
from mediagauge.plans import sqltext as S
from mediagauge.session import materialize
from mediagauge.tables import table

MODELS = ["chatgpt", "claude", "deepseek", "gemma"]


def _votes(spark: SparkSession, root: str) -> DataFrame:
    return materialize(E.resolved_labels(table(spark, root, "model_labels"), table(spark, root, "label_aliases")), "votes")


def _gold(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "majority_baseline").groupBy("article_id", "field_name").agg(F.max("strict_majority_baseline").alias("label"))


def label_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Signals per field and label."""
    return E.signal_labels(signal_view(table(spark, root, "signals")), ["signal_id"]).groupBy("field_name", "label").agg(F.count("*").alias("n"))


def eval_confusion(spark: SparkSession, root: str) -> DataFrame:
    """Confusion of every annotator and field against the baseline."""
    return E.confusion(_gold(spark, root), _votes(spark, root), ["annotator", "field_name"])


def eval_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Accuracy, macro-F1 and distance of every annotator and field."""
    return E.metrics(materialize(eval_confusion(spark, root), "confusion"), ["annotator", "field_name"])


def eval_by_annotator(spark: SparkSession, root: str) -> DataFrame:
    """Accuracy, macro-F1 and distance of every annotator over all fields."""
    return E.metrics(materialize(E.confusion(_gold(spark, root), _votes(spark, root), ["annotator"]), "confusion"), ["annotator"])


def eval_grouping_sets(spark: SparkSession, root: str) -> DataFrame:
    """Accuracy overall, per field group, per field and per annotator."""
    return E.accuracy_cube(_gold(spark, root), _votes(spark, root))


def eval_topic_fields(spark: SparkSession, root: str) -> DataFrame:
    """Accuracy per topic of the articles and field."""
    topics = article_view(table(spark, root, "articles")).select("article_id", F.col("canonical_topic_id").alias("topic"))
    return E.topic_accuracy(_gold(spark, root), _votes(spark, root), topics)


def annotator_agreement(spark: SparkSession, root: str) -> DataFrame:
    """Agreement of every two annotators."""
    return E.pairwise_agreement(_votes(spark, root))


def vote_patterns(spark: SparkSession, root: str) -> DataFrame:
    """How the four models split."""
    return E.vote_patterns(_votes(spark, root), MODELS)


def eval_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Items with only one side labelled."""
    return E.coverage_gaps(_gold(spark, root).where("label is not null"), _votes(spark, root).where("label is not null"))


_VOTES = """votes as (
  select v.article_id, v.field_name, v.annotator, k.label from (
    select article_id, field_name, lower(trim(annotator)) as annotator, lower(trim(label)) as alias,
      row_number() over (partition by article_id, field_name, lower(trim(annotator)) order by labelled_at desc nulls last, vote_id desc nulls last) as rn
    from model_labels where article_id is not null and field_name is not null and annotator is not null) v
  left join (select field_name, lower(trim(alias)) as alias, min(canonical_label) as label from label_aliases group by 1, 2) k using (field_name, alias) where rn = 1),
gold as (select article_id, field_name, max(strict_majority_baseline) as label from majority_baseline group by 1, 2),
both_ as (select v.article_id, v.field_name, v.annotator, g.label as expected, v.label as predicted from gold g join votes v using (article_id, field_name)
  where g.label is not null and v.label is not null)"""
_GROUP = "case field_name " + " ".join(f"when '{f}' then '{g}'" for g, fs in C.LABEL_FIELDS.items() for f in fs) + " end"


def _metrics(keys: str) -> str:
    return f"""with {_VOTES}, c as (select {keys}, expected, predicted, count(*) as n from both_ group by all),
      t as (select {keys}, sum(n)::bigint as support, coalesce(sum(n) filter (expected = predicted), 0)::bigint as correct from c group by all),
      s as (select {keys}, expected as label, n as e, 0 as p, case when expected = predicted then n else 0 end as tp from c union all select {keys}, predicted, 0, n, 0 from c),
      l as (select {keys}, label, sum(e) as e, sum(p) as p, sum(tp) as tp from s group by all),
      f as (select {keys}, round(avg(case when tp > 0 then 2.0::double * tp / (e + p) else 0.0 end), 4) as macro_f1,
        round(sum(abs(round(e::double / support, 4) - round(p::double / support, 4))) * 0.5, 5) as tvd from l join t using ({keys}) group by all)
      select {keys}, support, correct, round(correct::double / support, 4) as accuracy, macro_f1, tvd from t join f using ({keys})"""


_BUCKETS = " union all ".join(
    f"select '{field}' as field_name, case when {sig} < {low} then '{names[0]}' when {sig} < {high} then '{names[1]}' else '{names[2]}' end as label from sig where {sig} is not null and not isnan({sig})"
    for field, (sig, low, high) in E.CUTOFFS.items()
    for names in [C.BUCKET_LABELS if field == "concern_bucket" else ("0", "1", "2")]
)
_FRAMES = ", ".join(f"'{f}'" for f in C.FRAME_LABELS)
_MODELS = ", ".join(f"'{m}'" for m in MODELS)
SQL = {
    "label_buckets": f"""with {S.SIG}, b as ({_BUCKETS} union all select 'dominant_frame', case when frame in ({_FRAMES}) then frame else 'other' end from sig)
        select field_name, label, count(*) as n from b group by all""",
    "eval_confusion": f"with {_VOTES} select annotator, field_name, expected, predicted, count(*) as n from both_ group by all",
    "eval_metrics": _metrics("annotator, field_name"),
    "eval_by_annotator": _metrics("annotator"),
    "eval_grouping_sets": f"""with {_VOTES}, x as (select *, {_GROUP} as field_group, (expected = predicted)::int as hit from both_)
        select coalesce(field_group, '(all)') as field_group, coalesce(field_name, '(all)') as field_name, coalesce(annotator, '(all)') as annotator,
          count(*) as support, sum(hit)::bigint as correct, round(sum(hit)::double / count(*), 4) as accuracy
        from x group by grouping sets ((), (field_group), (field_group, field_name), (field_group, field_name, annotator))""",
    "eval_topic_fields": f"""with {_VOTES}, {S.ARTICLE}, x as (select coalesce(canonical_topic_id, '(missing)') as topic, field_name, (expected = predicted)::int as hit
          from both_ left join art using (article_id))
        select coalesce(topic, '(all)') as topic, coalesce(field_name, '(all)') as field_name, count(*) as support, sum(hit)::bigint as correct, round(sum(hit)::double / count(*), 4) as accuracy
        from x group by grouping sets ((topic, field_name), (topic), (field_name))""",
    "annotator_agreement": f"""with {_VOTES} select a.annotator as left_annotator, b.annotator as right_annotator, count(*) as items, round(avg((a.label = b.label)::int::double), 4) as agreement
        from votes a join votes b using (article_id, field_name) where a.annotator < b.annotator and a.label is not null and b.label is not null group by all""",
    "vote_patterns": f"""with {_VOTES}, c as (select article_id, field_name, label, count(*) as n from votes where annotator in ({_MODELS}) and label is not null group by all),
        p as (select article_id, field_name, string_agg(n::varchar, '/' order by n desc) as pattern from c group by all) select pattern, count(*) as items from p group by 1""",
    "eval_gaps": f"""with {_VOTES}, g as (select distinct article_id, field_name from gold where label is not null), v as (select distinct article_id, field_name from votes where label is not null)
        select (select count(*) from (select * from g except select * from v)) as missing, (select count(*) from (select * from v except select * from g)) as unexpected""",
}
QUERIES = {f.__name__: f for f in (label_buckets, eval_confusion, eval_metrics, eval_by_annotator, eval_grouping_sets, eval_topic_fields, annotator_agreement, vote_patterns, eval_gaps)}
