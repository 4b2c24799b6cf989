"""Queries on source selection, run statistics and ranked evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.functions.literal import literal_table
from mediagauge.operators import bandit as B
from mediagauge.operators import ranking as R
from mediagauge.operators.outlets import with_standard_outlet
from mediagauge.operators.views import article_view, signal_view, topic_links
from mediagauge.plans import profiles as P
from mediagauge.plans import sqltext as S
from mediagauge.plans.texts import _one
from mediagauge.session import materialize
from mediagauge.sources.scans import enabled_feeds
from mediagauge.tables import table


def _runs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "collection_runs").where("run_id is not null").dropDuplicates(["run_id"])


def _pulls(spark: SparkSession, root: str) -> DataFrame:
    feeds = table(spark, root, "feeds").select("outlet", "outlet_name", "host", "affinity_tag")
    signals = with_standard_outlet(signal_view(table(spark, root, "signals")), feeds, keep=["affinity_tag"]).where("std_outlet is not null")
    relevance = F.when(~F.isnan("topic_relevance_score"), F.col("topic_relevance_score"))
    repeats = F.count("*") - F.countDistinct("article_id")
    stats = signals.groupBy("run_id", "std_outlet", "affinity_tag").agg(F.countDistinct("article_id").alias("accepted"), repeats.alias("duplicates"), F.round(F.avg(relevance), 9).alias("relevance"))
    runs = _runs(spark, root).select("run_id", "started_at", "reward_mode")
    return stats.join(runs, "run_id")


def yield_rewards(spark: SparkSession, root: str) -> DataFrame:
    """Reward of every run and outlet."""
    reward = B.yield_reward(F.col("accepted"), F.col("duplicates"), F.col("relevance"), F.lit(True))
    return _pulls(spark, root).select("run_id", "std_outlet", "accepted", "duplicates", reward.alias("reward"))


def signal_rewards(spark: SparkSession, root: str) -> DataFrame:
    """Summed reward of each outlet's signals for a civic topic."""
    rows = signal_view(table(spark, root, "signals")).where("outlet_lc is not null")
    return rows.groupBy("outlet_lc").agg(F.count("*").alias("signals"), F.round(F.sum(B.signal_reward("civic")), 3).alias("reward"))


def _contexts(spark: SparkSession, root: str) -> DataFrame:
    domain = F.when(F.col("reward_mode").isin(*C.DOMAIN_WEIGHTS), F.col("reward_mode")).otherwise(C.DEFAULT_DOMAIN)
    reward = B.yield_reward(F.col("accepted"), F.col("duplicates"), F.col("relevance"), F.lit(True))
    places = B.context(F.col("affinity_tag"), domain, F.coalesce(F.hour("started_at"), F.lit(0)))
    return _pulls(spark, root).select(F.col("std_outlet").alias("outlet"), places.alias("places"), reward.alias("reward"))


def bandit_state(spark: SparkSession, root: str) -> DataFrame:
    """Accumulated state of every outlet, replayed from all runs."""
    return B.accumulate(_contexts(spark, root))


def bandit_scores(spark: SparkSession, root: str) -> DataFrame:
    """The six outlets to fetch next at nine o'clock for a commerce topic."""
    feeds = table(spark, root, "feeds").where("enabled")
    arms = feeds.select("outlet", B.context(F.col("affinity_tag"), F.lit("commerce"), F.lit(9)).alias("places"))
    return B.select_outlets(B.scores(materialize(bandit_state(spark, root), "bandit-state"), arms), 6)


def run_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Rates of the collection runs per mode; a rate over nothing is 0."""
    seconds = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    totals = _runs(spark, root).groupBy("run_mode").agg(
        F.count("*").alias("runs"), F.sum("feeds_selected").alias("feeds"), F.sum("fetch_failed").alias("failed"), F.sum("accepted_count").alias("accepted"), F.sum(seconds).alias("seconds")
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return totals.withColumn("failure_rate", rate("failed", "feeds")).withColumn("accepted_per_feed", rate("accepted", "feeds"))


def recent_runs(spark: SparkSession, root: str) -> DataFrame:
    """The five newest runs."""
    return R.latest_rows(_runs(spark, root), "started_at", "run_id", 5).select("run_id", "run_mode", "accepted_count")


def latest_run_per_mode(spark: SparkSession, root: str) -> DataFrame:
    """The newest run of every mode and reward mode."""
    return _runs(spark, root).groupBy("run_mode", "reward_mode").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def digest_topk(spark: SparkSession, root: str) -> DataFrame:
    """The eight most relevant articles of a topic."""
    links = topic_links(table(spark, root, "signals")).where((F.col("canonical_topic_id") == S.TOPIC) | (F.col("topic") == S.TOPIC))
    return R.digest(article_view(table(spark, root, "articles"), ("title",)), links).select("article_id", "title", "relevance")


def segment_evidence(spark: SparkSession, root: str) -> DataFrame:
    """The two latest telling articles of every segment."""
    return R.segment_evidence(P._topical(spark, root)).select("segment", "rank", "signal_id", "article_id", "share")


def signals_feed(spark: SparkSession, root: str) -> DataFrame:
    """The twenty newest signals of a topic with their article's outlet."""
    newest = R.latest_rows(P._topical(spark, root), "extracted_at", "signal_id", 20)
    articles = article_view(table(spark, root, "articles")).select("article_id", F.col("outlet_lc").alias("article_outlet"))
    return newest.join(articles, "article_id", "left").select("signal_id", "article_id", "article_outlet", "frame", "concern_level")


def segment_ranking(spark: SparkSession, root: str) -> DataFrame:
    """Segments by drift, with type, priority and confidence in words."""
    ranked = R.rank_segments(P.segment_drift(spark, root)).withColumn("drift_type", R.drift_type())
    scored = R.priorities(ranked, F.col("confidence") * F.col("drift_magnitude") * F.log1p(F.col("article_count").cast("double")))
    return scored.select("segment", "rank", "alert_level", "drift_type", "priority", R.confidence_words(F.col("confidence")).alias("confidence_label"))


def table_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows of every table."""
    out = None
    for name in ("articles", "signals", "collection_runs", "article_embeddings", "cluster_memberships", "model_labels", "majority_baseline", "feeds", "label_aliases", "documents", "eval_items", "moderation_labels"):
        one = table(spark, root, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out


def feed_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Enabled Czech feeds with the share of each segment that their affinity suggests."""
    feeds = enabled_feeds(table(spark, root, "feeds"), country="cz")
    rows = [(a, *v) for a, v in C.AFFINITY_PRIORS.items()]
    priors = literal_table(spark, rows, "affinity_tag string, " + ", ".join(f"prior_{s} double" for s in C.SEGMENTS))
    return feeds.join(F.broadcast(priors), "affinity_tag", "left").select("outlet", "affinity_tag", *[f"prior_{s}" for s in C.SEGMENTS])


def blended_shares(spark: SparkSession, root: str) -> DataFrame:
    """Mean segment shares of each outlet: softmax of the relevances, blended 0.7/0.3 with the affinity's prior."""
    from mediagauge.functions.vector import softmax

    feeds = table(spark, root, "feeds").select("outlet", "outlet_name", "host", "affinity_tag")
    rows = with_standard_outlet(signal_view(table(spark, root, "signals")), feeds, keep=["affinity_tag"]).where("std_outlet is not null")
    values = [F.coalesce(F.nanvl(F.col(f"seg_{s}"), F.lit(0.0)), F.lit(0.0)) for s in C.SEGMENTS]
    priors = literal_table(spark, [(a, *v) for a, v in C.AFFINITY_PRIORS.items()], "affinity_tag string, " + ", ".join(f"prior_{s} double" for s in C.SEGMENTS))
    joined = rows.join(F.broadcast(priors), "affinity_tag")
    blended = [F.round(0.7 * x + 0.3 * F.col(f"prior_{s}"), 4).alias(s) for s, x in zip(C.SEGMENTS, softmax(values), strict=True)]
    return joined.select("std_outlet", *blended).groupBy("std_outlet").agg(F.count("*").alias("signals"), *[F.round(F.avg(s), 3).alias(s) for s in C.SEGMENTS])


_KEYS = """keys as (select lower(trim(nfc_normalize(s))) as k, min(outlet) as std from (
    select outlet, unnest([outlet, outlet_name, host, 'www.' || host]) as s from feeds) group by 1)"""
_STD = f"""{S.SIG}, {_KEYS}, std as (select s.*, k.std as std_outlet, f.affinity_tag from sig s join keys k on lower(trim(nfc_normalize(s.outlet))) = k.k join feeds f on f.outlet = k.std)"""
_PULLS = f"""{_STD}, st as (select run_id, std_outlet, affinity_tag, count(distinct article_id) as accepted, count(*) - count(distinct article_id) as duplicates,
    round(avg(case when isnan(topic_relevance_score) then null else topic_relevance_score end), 9) as relevance from std group by all),
  runs as (select distinct on (run_id) * from collection_runs where run_id is not null),
  pulls as (select st.*, started_at, reward_mode, round(greatest(0.0, least(1.0, 0.7 * least(1.0, accepted / 8.0) + 0.3 * greatest(0.0, least(1.0, coalesce(relevance, 0.0)))
      - least(0.35, duplicates::double / greatest(1, accepted + duplicates) * 0.35))) + 1e-9, 4) as reward from st join runs using (run_id))"""
_n = lambda names: ", ".join(f"'{x}'" for x in names)
_ctx = f"""ctx as (select std_outlet as outlet, reward, list_filter([0,
    case when list_contains([{_n(B.AFFINITIES)}], affinity_tag) then list_position([{_n(B.AFFINITIES)}], affinity_tag)::int end,
    {len(B.AFFINITIES)} + list_position([{_n(B.DOMAINS)}], case when reward_mode in ({_n(B.DOMAINS)}) then reward_mode else 'generic' end)::int,
    (least(3, coalesce(hour(started_at at time zone 'UTC'), 0) // 6) + {1 + len(B.AFFINITIES) + len(B.DOMAINS)})::int], lambda x: x is not null) as places from pulls)"""
_SEG = " union all ".join(f"select signal_id, article_id, extracted_at, '{s}' as segment, seg_{s} as share from topical where seg_{s} > 0.3 and not isnan(seg_{s})" for s in C.SEGMENTS)
_civic = " + ".join(f"{C.DOMAIN_WEIGHTS['civic'][k]} * (case when {k} is null or isnan({k}) then 0.0 else {k} end)" for k in C.SIGNALS)
_soft = lambda s: f"exp(5 * (case when seg_{s} is null or isnan(seg_{s}) then 0.0 else seg_{s} end))"
_total = " + ".join(_soft(s) for s in C.SEGMENTS)
_prior = lambda s: "case affinity_tag " + " ".join(f"when '{a}' then {v[C.SEGMENTS.index(s)]}" for a, v in C.AFFINITY_PRIORS.items()) + " end"
SQL = {
    "yield_rewards": f"with {_PULLS} select run_id, std_outlet, accepted, duplicates, reward from pulls",
    "signal_rewards": f"""with {S.SIG} select outlet_lc, count(*) as signals, round(sum(round(greatest(0.0, least(1.0, {_civic})), 4)), 3) as reward from sig
        where outlet_lc is not null group by 1""",
    "bandit_state": f"""with {_PULLS}, {_ctx}, l as (select outlet, reward, places, unnest(places) as i from ctx), m as (select outlet, reward, i, unnest(places) as j from l)
        select outlet, i, j, count(*) as a, round(round(sum(case when i = j then reward end), 8), 4) as b from m group by all""",
    "run_rollup": """with r as (select distinct on (run_id) * from collection_runs where run_id is not null),
        t as (select run_mode, count(*) as runs, sum(feeds_selected)::bigint as feeds, sum(fetch_failed)::bigint as failed, sum(accepted_count)::bigint as accepted,
          sum(epoch(completed_at) - epoch(started_at))::bigint as seconds from r group by 1)
        select *, case when feeds > 0 then round(failed::double / feeds, 4) else 0.0 end as failure_rate, case when feeds > 0 then round(accepted::double / feeds, 4) else 0.0 end as accepted_per_feed from t""",
    "recent_runs": """with r as (select distinct on (run_id) * from collection_runs where run_id is not null)
        select run_id, run_mode, accepted_count from r order by started_at desc nulls last, run_id desc limit 5""",
    "latest_run_per_mode": """with r as (select distinct on (run_id) * from collection_runs where run_id is not null)
        select run_mode, reward_mode, run_id from r qualify row_number() over (partition by run_mode, reward_mode order by started_at desc nulls last, run_id desc) = 1""",
    "digest_topk": f"""with {_one("title")},
        {S.LINKS}, b as (select article_id, max(relevance) as relevance, max(matched_at) as matched_at from links where canonical_topic_id = '{S.TOPIC}' or topic = '{S.TOPIC}' group by 1)
        select article_id, title, relevance from one join b using (article_id) order by relevance desc nulls last, fetched_at desc nulls last, matched_at desc nulls last, article_id limit 8""",
    "segment_evidence": f"""{P._ALL}, l as ({_SEG}) select segment, row_number() over (partition by segment order by extracted_at desc nulls last, share desc, signal_id)::int as rank,
        signal_id, article_id, share from l qualify rank <= 2""",
    "signals_feed": f"""{P._ALL}, {S.ARTICLE}, n as (select * from topical order by extracted_at desc nulls last, signal_id desc limit 20)
        select n.signal_id, n.article_id, a.outlet_lc as article_outlet, n.frame, n.concern_level from n left join art a using (article_id)""",
    "segment_ranking": f"""with d as ({P.SQL["segment_drift"]}),
        r as (select *, row_number() over (order by case alert_level when 'strong' then 3 when 'mild' then 2 when 'none' then 1 else 0 end desc, drift_magnitude desc, confidence desc, article_count desc, segment)::int as rank,
          confidence * drift_magnitude * ln(1 + article_count) as s, greatest(abs(coalesce(delta_concern_level, 0)), abs(coalesce(delta_purchase_intent, 0)), abs(coalesce(delta_avoidance_signals, 0))) as top from d)
        select segment, rank, alert_level, case when abs(coalesce(delta_concern_level, 0)) = top and delta_concern_level > 0 then 'concern_spike'
            when abs(coalesce(delta_purchase_intent, 0)) = top and delta_purchase_intent > 0 then 'purchase_surge' when abs(coalesce(delta_avoidance_signals, 0)) = top and delta_avoidance_signals > 0 then 'avoidance_rise'
            when frame_shift then 'frame_shift' when drift_magnitude <= 0 then 'stable' else 'mixed' end as drift_type,
          case when sum(s) over () > 0 then round(s / sum(s) over (), 4) else 0.0 end as priority,
          case when confidence >= 0.7 then 'high' when confidence >= 0.4 then 'medium' else 'exploratory' end as confidence_label from r""",
    "table_counts": " union all ".join(
        f"select '{t}' as table_name, count(*) as n from {t}"
        for t in ("articles", "signals", "collection_runs", "article_embeddings", "cluster_memberships", "model_labels", "majority_baseline", "feeds", "label_aliases", "documents", "eval_items", "moderation_labels")
    ),
    "feed_catalog": f"select outlet, affinity_tag, {', '.join(_prior(s) + f' as prior_{s}' for s in C.SEGMENTS)} from feeds where enabled and upper(trim(country)) = 'CZ'",
    "blended_shares": f"""with {_STD}, b as (select std_outlet, {", ".join(f"round(0.7 * round({_soft(s)} / ({_total}), 4) + 0.3 * ({_prior(s)}), 4) as {s}" for s in C.SEGMENTS)} from std)
        select std_outlet, count(*) as signals, {", ".join(f"round(avg({s}), 3) as {s}" for s in C.SEGMENTS)} from b group by 1""",
}
QUERIES = {
    f.__name__: f
    for f in (
        yield_rewards, signal_rewards, bandit_state, bandit_scores, run_rollup, recent_runs, latest_run_per_mode, digest_topk, segment_evidence, signals_feed,
        segment_ranking, table_counts, feed_catalog, blended_shares,
    )
}
