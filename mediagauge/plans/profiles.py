"""Queries on segment profiles, drift, outlet mix and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.operators import mix, profiles
from mediagauge.operators.views import Scope, article_view, between, in_topic, scope_filter, signal_view, trailing
from mediagauge.plans import sqltext as S
from mediagauge.session import materialize
from mediagauge.tables import table

REFERENCE = ("2025-05-02 00:00:00", "2025-06-01 00:00:00")
PANEL = ["polanske_listy", "denik_kontura", "radio_lipnava", "trzni_zapisnik", "vesna_magazin"]


def _topical(spark: SparkSession, root: str) -> DataFrame:
    raw = table(spark, root, "signals")
    return in_topic(signal_view(raw), raw, S.TOPIC)


def _current(spark: SparkSession, root: str) -> DataFrame:
    raw = table(spark, root, "signals")
    # The latest version of a signal lies after a point in time if any does, so the window applies at the scan.
    return in_topic(signal_view(raw.where(trailing("extracted_at", S.AS_OF, S.DAYS))), raw, S.TOPIC)


def _priors(spark: SparkSession) -> DataFrame:
    return profiles.seed_baselines(spark, [""])


def segment_profile(spark: SparkSession, root: str) -> DataFrame:
    """Weighted profile of the topic in the trailing window."""
    return profiles.segment_profile(_current(spark, root))


def segment_drift(spark: SparkSession, root: str) -> DataFrame:
    """Drift of the profile from the seeded baseline."""
    return profiles.drift_from(profiles.segment_profile(_current(spark, root)), _priors(spark), S.DOMAIN)


def scoped_profile(spark: SparkSession, root: str) -> DataFrame:
    """Profile of Czech articles in Czech, joined from the articles' scope."""
    scope = Scope(country="cz ", language=" CS")
    articles = article_view(table(spark, root, "articles")).where(scope_filter(scope)).select("article_id")
    return profiles.segment_profile(_topical(spark, root).join(articles, "article_id"))


def outlet_distribution(spark: SparkSession, root: str) -> DataFrame:
    """Distinct articles and share of each outlet in the trailing window."""
    return mix.shares(mix.outlet_counts(_current(spark, root)))


def source_mix(spark: SparkSession, root: str) -> DataFrame:
    """Divergence of the outlet mix from the window before, with its warning."""
    return mix.mix_report(_current(spark, root), _topical(spark, root).where(between("extracted_at", *REFERENCE)))


def outlet_segment_profile(spark: SparkSession, root: str) -> DataFrame:
    """Profile of every outlet and segment over the whole time."""
    return mix.outlet_profiles(_topical(spark, root))


def _panel(spark: SparkSession, root: str) -> DataFrame:
    return mix.panel_profile(mix.outlet_profiles(_topical(spark, root)), PANEL)


def panel_profile(spark: SparkSession, root: str) -> DataFrame:
    """Profile of the fixed panel, every outlet counting alike."""
    joined = [F.array_join(c, ",").alias(c) for c in ("observed", "missing")]
    return _panel(spark, root).select("segment", *C.SIGNALS, "article_count", "dominant_frame", *joined)


def source_normalized_drift(spark: SparkSession, root: str) -> DataFrame:
    """Drift with and without the outlet mix."""
    base = _priors(spark)
    # Both profiles read the same signals; written once, the versions are compared once.
    topical = materialize(_topical(spark, root).select("article_id", "outlet_lc", *C.SIGNALS, *[f"seg_{s}" for s in C.SEGMENTS], "frame"), "topical-signals")
    raw = profiles.drift_from(profiles.weighted_profiles(topical), base, S.DOMAIN)
    panel = mix.panel_profile(mix.outlet_profiles(topical), PANEL)
    balanced = profiles.drift_from(panel, base, S.DOMAIN).join(panel.select("segment", "missing"), "segment")
    return mix.normalized_drift(raw, balanced)


def profile_history(spark: SparkSession, root: str) -> DataFrame:
    """Profile and drift of every day."""
    return profiles.history(_topical(spark, root), "extracted_at", _priors(spark), S.DOMAIN)


def baseline_ema(spark: SparkSession, root: str) -> DataFrame:
    """Baselines of all topics learned from quarterly profiles."""
    signals = signal_view(table(spark, root, "signals")).where("canonical_topic_id is not null")
    quarterly = profiles.weighted_profiles(signals.withColumn("period", F.trunc(F.to_date("extracted_at"), "quarter")), ["canonical_topic_id", "period"])
    start = dict(zip(C.SIGNALS, (0.5, 0.3, 0.25), strict=True))
    return profiles.ema_fold(quarterly, ["canonical_topic_id", "segment"], start, "period")


def confidence_table(spark: SparkSession, root: str) -> DataFrame:
    """Confidence and status per topic and segment, for the learned baselines."""
    learned = baseline_ema(spark, root).select("canonical_topic_id", "segment", "sample_count", "is_learned")
    recent = signal_view(table(spark, root, "signals").where(trailing("extracted_at", S.AS_OF, S.DAYS)))
    now = profiles.weighted_profiles(recent.where("canonical_topic_id is not null"), ["canonical_topic_id"])
    joined = now.select("canonical_topic_id", "segment", "article_count").join(learned, ["canonical_topic_id", "segment"], "left")
    known = F.coalesce("is_learned", F.lit(False))
    scored = joined.withColumn("confidence", profiles.confidence(F.col("article_count"), F.coalesce("sample_count", F.lit(0)), known))
    return scored.select("canonical_topic_id", "segment", "article_count", "confidence", profiles.segment_status(F.col("article_count"), known, F.col("confidence")).alias("status"))


def baseline_choice(spark: SparkSession, root: str) -> DataFrame:
    """Per topic and segment the baseline that counts: learned before seeded."""
    learned = baseline_ema(spark, root).select(F.col("canonical_topic_id").alias("topic"), "segment", "concern_level", "sample_count", "is_learned", F.lit(S.AS_OF).cast("timestamp").alias("updated_at"))
    seeded = _priors(spark).select("topic", "segment", "concern_level", "sample_count", "is_learned", F.lit(None).cast("timestamp").alias("updated_at"))
    return profiles.choose_baseline(learned.unionByName(seeded), ["segment"]).drop("updated_at")


def scope_counts(spark: SparkSession, root: str) -> DataFrame:
    """Distinct articles, signals and complete embeddings of the topic."""
    topical = _topical(spark, root)
    embedded = table(spark, root, "article_embeddings").where("status = 'complete'").select("article_id").distinct()
    ids = topical.select("article_id").distinct()
    a = topical.agg(F.countDistinct("article_id").alias("articles"), F.countDistinct("signal_id").alias("signals"))
    return a.crossJoin(ids.join(embedded, "article_id", "left_semi").agg(F.count("*").alias("embeddings")))


def topic_counts(spark: SparkSession, root: str) -> DataFrame:
    """Articles per raw topic, null as (missing)."""
    one = article_view(table(spark, root, "articles"))
    return one.groupBy(F.coalesce("topic", F.lit("(missing)")).alias("topic")).agg(F.count("*").alias("articles"))


def signal_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Share of articles with a signal."""
    articles = table(spark, root, "articles").where("article_id is not null").select("article_id").distinct()
    signalled = table(spark, root, "signals").select("article_id").distinct()
    both = articles.join(signalled.withColumn("has", F.lit(1)), "article_id", "left")
    return both.agg(F.count("*").alias("articles"), F.sum(F.coalesce("has", F.lit(0))).alias("with_signal")).withColumn(
        "coverage", F.round(F.try_divide(F.col("with_signal") * 100.0, F.col("articles")), 4)
    )


_CUR = f"with {S.SIG}, {S.LINKS}, {S.TOPICAL}, {S.NOW}"
_ALL = f"with {S.SIG}, {S.LINKS}, {S.TOPICAL}"
_OUTLETS = "select outlet_lc, count(distinct article_id) as articles from {t} where outlet_lc is not null and outlet_lc <> '' group by 1"
_CONF = "round(0.5 * least(1.0, article_count / 50.0) + 0.5 * {q}, 4)"
_DELTAS = ", ".join(f"case when article_count > 0 then round({k} - b_{k}, 4) end as delta_{k}" for k in C.SIGNALS)
_MAG = "case when article_count > 0 then " + S.magnitude() + " else 0.0 end"
_PANEL_VALUES = ", ".join(f"('{o}', {i})" for i, o in enumerate(PANEL))
_PANEL = f"""panel as (select * from (values {_PANEL_VALUES}) t(outlet_lc, pos)),
pv as (select segment, {", ".join(f"round(avg({k}), 4) as {k}" for k in C.SIGNALS)}, sum(article_count)::bigint as article_count,
  list(outlet_lc order by pos) as seen from prof join panel using (outlet_lc) group by 1),
pn as (select segment, dominant_frame, count(*) as n from prof join panel using (outlet_lc) group by all),
pf as (select segment, arg_min(dominant_frame, row(-n, dominant_frame)) as dominant_frame from pn group by 1),
pp as (select segment, {", ".join(C.SIGNALS)}, article_count, dominant_frame, array_to_string(seen, ',') as observed,
  coalesce((select string_agg(outlet_lc, ',' order by pos) from panel where not list_contains(seen, outlet_lc)), '') as missing from pv join pf using (segment))"""
SQL = {
    "segment_profile": f"{_CUR}, {S.segments('cur')}, {S.profile()}, {S.DIM}, {S.FULL} select * from full_prof",
    "segment_drift": f"""{_CUR}, {S.segments("cur")}, {S.profile()}, {S.DIM}, {S.FULL}, {S.PRIORS},
        j as (select *, {_DELTAS}, {_MAG} as drift_magnitude, {_CONF.format(q="0.3")} as confidence from full_prof join base using (segment))
        select segment, article_count, {", ".join(C.SIGNALS)}, {", ".join("delta_" + k for k in C.SIGNALS)}, drift_magnitude,
          article_count > 0 and dominant_frame <> baseline_frame as frame_shift,
          case when article_count = 0 then 'no_data' when drift_magnitude >= 0.45 then 'strong' when drift_magnitude >= 0.2 then 'mild' else 'none' end as alert_level,
          dominant_frame, baseline_frame, confidence, case when article_count = 0 then 'no_data' else 'warming' end as status from j""",
    "scoped_profile": f"""{_ALL}, {S.ARTICLE}, scoped as (select t.* from topical t join art a using (article_id) where a.country = 'CZ' and lower(a.language) = 'cs'),
        {S.segments("scoped")}, {S.profile()}, {S.DIM}, {S.FULL} select * from full_prof""",
    "outlet_distribution": f"{_CUR}, c as ({_OUTLETS.format(t='cur')}) select outlet_lc, articles, round(articles / sum(articles) over (), 6) as share from c",
    "source_mix": f"""{_CUR}, old as (select * from topical where extracted_at >= timestamptz '{REFERENCE[0]}+00' and extracted_at < timestamptz '{REFERENCE[1]}+00'),
        a as ({_OUTLETS.format(t="cur")}), b as ({_OUTLETS.format(t="old")}),
        p as (select outlet_lc, round(articles / sum(articles) over (), 6) as p from a), q as (select outlet_lc, round(articles / sum(articles) over (), 6) as q from b),
        u as (select coalesce(p, 0.0) as p, coalesce(q, 0.0) as q, (coalesce(p, 0.0) + coalesce(q, 0.0)) / 2 as m from p full join q using (outlet_lc)),
        d as (select 0.5 * sum(case when p > 0 then p * log2(p / m) else 0 end) + 0.5 * sum(case when q > 0 then q * log2(q / m) else 0 end) as d from u),
        r as (select (select coalesce(sum(articles), 0)::bigint from a) as current_total, (select coalesce(sum(articles), 0)::bigint from b) as reference_total,
          (select round(greatest(0.0, least(1.0, d)), 4) from d) as dv)
        select current_total, reference_total, case when current_total > 0 and reference_total > 0 then dv end as divergence,
          case when current_total = 0 then 'no_current_articles' when reference_total = 0 then 'no_reference_window'
            when current_total < 5 or reference_total < 5 then 'low_sample' when dv >= 0.25 then 'outlet_mix_shift' else 'none' end as warning from r""",
    "outlet_segment_profile": f"{_ALL}, t as (select * from topical where outlet_lc <> ''), {S.segments('t', 'outlet_lc')}, {S.profile('outlet_lc')} select * from prof",
    "panel_profile": f"{_ALL}, t as (select * from topical where outlet_lc <> ''), {S.segments('t', 'outlet_lc')}, {S.profile('outlet_lc')}, {_PANEL} select * from pp",
    "source_normalized_drift": f"""{_ALL}, t as (select * from topical where outlet_lc <> ''), {S.segments("t", "outlet_lc")}, {S.profile("outlet_lc")}, {_PANEL},
        {S.segments("topical", "", "seg2")}, {S.profile("", "seg2", "prof2")}, {S.PRIORS},
        r as (select segment, {S.magnitude()} as raw_magnitude from prof2 join base using (segment)),
        b as (select segment, {S.magnitude()} as balanced_magnitude, missing from pp join base using (segment)),
        j as (select segment, raw_magnitude, balanced_magnitude, missing, round(raw_magnitude - balanced_magnitude, 4) as source_mix_effect from r left join b using (segment))
        select segment, raw_magnitude, balanced_magnitude, source_mix_effect,
          case when balanced_magnitude is null then 'no_panel_overlap' when missing <> '' then 'partial_panel' else 'ready' end as panel_status,
          case when source_mix_effect >= 0.05 then 'raw_drift_partly_source_mix' when source_mix_effect <= -0.05 then 'source_mix_hides_drift'
            when source_mix_effect is not null then 'stable_under_panel' end as interpretation from j""",
    "profile_history": f"""{_ALL}, d as (select *, cast(extracted_at at time zone 'UTC' as date) as day from topical), {S.segments("d", "day")}, {S.profile("day")}, {S.PRIORS}
        select segment, day, {", ".join(C.SIGNALS)}, article_count, {S.magnitude()} as drift_magnitude from prof join base using (segment)""",
    "scope_counts": f"""{_ALL} select (select count(distinct article_id) from topical) as articles, (select count(distinct signal_id) from topical) as signals,
        (select count(distinct article_id) from article_embeddings where status = 'complete' and article_id in (select article_id from topical)) as embeddings""",
    "topic_counts": f"with {S.ARTICLE} select coalesce(topic, '(missing)') as topic, count(*) as articles from art group by 1",
    "signal_coverage": """with a as (select distinct article_id from articles where article_id is not null)
        select count(*) as articles, count(*) filter (article_id in (select article_id from signals)) as with_signal,
          round(count(*) filter (article_id in (select article_id from signals)) * 100.0 / count(*), 4) as coverage from a""",
}
_MONTHLY = f"""with recursive {S.SIG}, m as (select *, date_trunc('quarter', extracted_at at time zone 'UTC') as period from sig where canonical_topic_id is not null),
    {S.segments("m", "canonical_topic_id, period")}, {S.profile("canonical_topic_id, period")},
    n as (select *, row_number() over (partition by canonical_topic_id, segment order by period) as i from prof where article_count >= 30),
    fold as (select canonical_topic_id, segment, 0::bigint as i, 0.5::double as concern_level, 0.3::double as purchase_intent, 0.25::double as avoidance_signals, 'neutral' as dominant_frame
        from (select distinct canonical_topic_id, segment from n)
      union all select n.canonical_topic_id, n.segment, n.i, {", ".join(f"round(0.8 * f.{k} + 0.2 * n.{k}, 4)" for k in C.SIGNALS)}, n.dominant_frame
        from fold f join n on n.canonical_topic_id = f.canonical_topic_id and n.segment = f.segment and n.i = f.i + 1),
    learned as (select canonical_topic_id, segment, {", ".join(f"arg_max({k}, i) as {k}" for k in C.SIGNALS)}, arg_max(dominant_frame, i) as dominant_frame,
        max(i)::int as sample_count, max(i) >= 30 as is_learned from fold group by 1, 2)"""
SQL["baseline_ema"] = f"{_MONTHLY} select * from learned"
SQL["confidence_table"] = f"""{_MONTHLY}, w as (select * from sig where canonical_topic_id is not null and extracted_at >= timestamptz '{S.AS_OF}+00' - interval {S.DAYS} day),
    {S.segments("w", "canonical_topic_id", "seg3")}, {S.profile("canonical_topic_id", "seg3", "prof3")},
    j as (select p.canonical_topic_id, p.segment, p.article_count, coalesce(l.is_learned, false) as learned, coalesce(l.sample_count, 0) as samples
      from prof3 p left join learned l on p.canonical_topic_id = l.canonical_topic_id and p.segment = l.segment),
    c as (select *, {_CONF.format(q="case when learned then least(1.0, samples / 50.0 + 0.3) else 0.3 end")} as confidence from j)
    select canonical_topic_id, segment, article_count, confidence,
      case when article_count = 0 then 'no_data' when learned and confidence >= 0.4 then 'ready' else 'warming' end as status from c"""
SQL["baseline_choice"] = f"""{_MONTHLY}, {S.PRIORS}, u as (
      select canonical_topic_id as topic, segment, concern_level, sample_count, is_learned, 1 as dated from learned
      union all select '', segment, b_concern_level, 0, false, 0 from base)
    select topic, segment, concern_level, sample_count, is_learned from u
    qualify row_number() over (partition by segment order by is_learned desc, sample_count desc, dated desc, topic) = 1"""
QUERIES = {
    f.__name__: f
    for f in (
        segment_profile, segment_drift, scoped_profile, outlet_distribution, source_mix, outlet_segment_profile, panel_profile, source_normalized_drift,
        profile_history, baseline_ema, confidence_table, baseline_choice, scope_counts, topic_counts, signal_coverage,
    )
}
