"""Queries that cap the records of dominant contributors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge.llm.contributors import cap_batch, cap_share, cap_signals, latest_signals, new_state, time_slices
from mediagauge.tables import table

LIMIT = 8
SHARE = 0.1


def _tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, root, "signals"), table(spark, root, "articles"), table(spark, root, "feeds")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Signals that may not stay."""
    return cap_signals(*_tables(spark, root), LIMIT).displaced.select(F.col("id").alias("signal_id"))


def p3_contributors(spark: SparkSession, root: str) -> DataFrame:
    """Per standard outlet: signals kept and displaced, and the share displaced."""
    state = cap_signals(*_tables(spark, root), LIMIT)
    both = state.kept.select("std_outlet", F.lit(1).alias("k")).union(state.displaced.select("std_outlet", F.lit(0).alias("k")))
    counts = both.groupBy("std_outlet").agg(F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("displaced"))
    return counts.withColumn("displaced_share", F.round(F.col("displaced") / (F.col("kept") + F.col("displaced")), 6))


def p3_incremental(spark: SparkSession, root: str) -> DataFrame:
    """The kept signals after the versions of all signals came in four batches by time, later ones replacing earlier ones."""
    signals, articles, feeds = _tables(spark, root)
    state = None
    for part in time_slices(signals, 4):
        rows = latest_signals(part, articles, feeds)
        state = cap_batch(state or new_state(rows, ["run_id", "std_outlet"], LIMIT), rows)
    return state.kept.select(F.col("id").alias("signal_id"), "run_id", "std_outlet")


def p3_share(spark: SparkSession, root: str) -> DataFrame:
    """Signals that may not stay if no outlet may hold more than a tenth of a run."""
    rows = cap_share(latest_signals(*_tables(spark, root)), ["run_id"], "std_outlet", SHARE)
    return rows.where("not stays").select(F.col("id").alias("signal_id"))


_LATEST = """
keys as (
  select lower(trim(nfc_normalize(s))) as k, min(outlet) as std from (
    select outlet, unnest([outlet, outlet_name, host, 'www.' || host]) as s from feeds) group by 1),
ranked as (
  select *, row_number() over (partition by signal_id
    order by extracted_at desc nulls last, run_id desc nulls last, outlet desc nulls last, topic_relevance_score desc nulls last) as v
  from signals where signal_id is not null),
owner as (
  select a.article_id, min(k.std) as std from articles a join keys k on lower(trim(nfc_normalize(a.outlet))) = k.k group by 1),
latest as (
  select r.signal_id, r.run_id, r.topic_relevance_score as score,
    case when r.outlet is null then o.std else coalesce(k.std, nullif(lower(trim(r.outlet)), '')) end as std_outlet
  from ranked r left join keys k on lower(trim(nfc_normalize(r.outlet))) = k.k
    left join owner o on r.article_id = o.article_id
  where r.v = 1),
placed as (
  select *, case when run_id is null or std_outlet is null then 1 else row_number() over (partition by run_id, std_outlet
    order by (score is null or isnan(score)), case when isnan(score) then null else score end desc nulls last, signal_id) end as rn
  from latest)
"""
SQL = {
    "p3_share": f"""with {_LATEST}, sizes as (select run_id, greatest(floor(count(*) * {SHARE} + 1e-9), 1) as most from latest group by 1)
        select p.signal_id from (select *, row_number() over (partition by run_id, std_outlet
            order by (score is null or isnan(score)), case when isnan(score) then null else score end desc nulls last, signal_id) as place from latest) p
        join sizes using (run_id) where std_outlet is not null and place > most""",
    "p3_found": f"with {_LATEST} select signal_id from placed where rn > {LIMIT}",
    "p3_incremental": f"with {_LATEST} select signal_id, run_id, std_outlet from placed where rn <= {LIMIT}",
    "p3_contributors": f"""with {_LATEST}, c as (
        select std_outlet, count(*) filter (rn <= {LIMIT}) as kept, count(*) filter (rn > {LIMIT}) as displaced from placed group by 1)
        select std_outlet, kept, displaced, round(displaced / (kept + displaced), 6) as displaced_share from c""",
}
QUERIES = {"p3_found": p3_found, "p3_contributors": p3_contributors, "p3_incremental": p3_incremental, "p3_share": p3_share}
