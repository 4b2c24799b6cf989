"""Profiles, drift, mix, history, baselines: exact values on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.operators import mix, profiles
from mediagauge.operators.views import Scope, article_view, in_topic, scope_filter, signal_view, topic_links

FIELDS = "signal_id long, run_id string, article_id string, outlet string, topic string, canonical_topic_id string, topic_relevance_score double, concern_level double, purchase_intent double, avoidance_signals double, dominant_frame string, seg_young_urban double, seg_family double, seg_senior double, seg_b2b double, extracted_at timestamp"


def signals(spark, rows):
    full = []
    for i, r in enumerate(rows):
        base = {"signal_id": i, "run_id": "r", "article_id": f"a{i}", "outlet": "o", "topic": "inflace", "canonical_topic_id": "t", "topic_relevance_score": 0.9, "frame": "fear", "c": 0.0, "p": 0.0, "av": 0.0, "seg": (0, 0, 0, 0), "at": "2025-01-01 00:00:00"} | r
        full.append((base["signal_id"], base["run_id"], base["article_id"], base["outlet"], base["topic"], base["canonical_topic_id"], base["topic_relevance_score"], base["c"], base["p"], base["av"], base["frame"], *[None if x is None else float(x) for x in base["seg"]], base["at"]))
    raw = spark.createDataFrame(full, FIELDS.replace("timestamp", "string")).withColumn("extracted_at", F.col("extracted_at").cast("timestamp"))
    return raw


def test_weighted_profile_and_drift(spark):
    raw = signals(spark, [{"c": 0.8, "seg": (1, 0, 0, 0)}, {"c": 0.9, "seg": (0, 1, 0, None), "frame": "Debate"}, {"c": None, "seg": (0, 0, 0, 0)}, {"c": float("nan"), "seg": (0, 0, 0, float("nan"))}])
    profile = profiles.segment_profile(signal_view(raw))
    got = {r["segment"]: r for r in profiles.drift_from(profile, profiles.seed_baselines(spark, [""]), "commerce").collect()}
    assert set(got) == set(C.SEGMENTS)
    assert got["young_urban"]["concern_level"] == 0.8 and got["young_urban"]["delta_concern_level"] == 0.42
    assert got["family"]["frame_shift"] and got["family"]["dominant_frame"] == "conflict"
    assert got["senior"]["alert_level"] == "no_data" and got["senior"]["drift_magnitude"] == 0.0 and got["senior"]["confidence"] == 0.15


@pytest.mark.parametrize(("n", "samples", "learned", "expected"), [(0, 0, False, 0.15), (50, 50, True, 1.0), (25, 0, False, 0.4)])
def test_confidence(spark, n, samples, learned, expected):
    df = spark.range(1).select(profiles.confidence(F.lit(n), F.lit(samples), F.lit(learned)).alias("c"))
    assert df.first()["c"] == expected


def test_latest_version_counts_and_copies_once(spark):
    raw = signals(spark, [{"signal_id": 1, "c": 0.1}, {"signal_id": 1, "c": 0.7, "at": "2025-02-01 00:00:00"}, {"signal_id": 1, "c": 0.7, "at": "2025-02-01 00:00:00"}, {"signal_id": None}])
    rows = signal_view(raw).collect()
    assert len(rows) == 1 and rows[0]["concern_level"] == 0.7


def test_frame_ties_go_to_the_first_name(spark):
    raw = signals(spark, [{"seg": (0.5, 0, 0, 0), "frame": "opportunity"}, {"seg": (0.5, 0, 0, 0), "frame": "conflict"}])
    assert profiles.weighted_profiles(signal_view(raw)).first()["dominant_frame"] == "conflict"


def test_topic_scope(spark):
    raw = signals(spark, [{"article_id": "x"}, {"article_id": "y", "canonical_topic_id": "u", "topic": "other"}])
    links = topic_links(raw)
    articles = spark.createDataFrame([("x",), ("y",), ("z",)], "article_id string")
    assert [r[0] for r in in_topic(articles, links, "t").collect()] == ["x"]
    assert [r[0] for r in in_topic(articles, links, "other").collect()] == ["y"]
    assert in_topic(articles, links, "").count() == 3


def test_scope_and_first_delivery(spark):
    rows = [("a", " X ", "CZ", "CS", "t", None, "2025-01-02"), ("a", "X", "CZ", "cs", "t", None, "2025-01-01"), ("b", None, "DE", None, None, None, None), (None, "X", "CZ", "cs", None, None, None)]
    df = spark.createDataFrame(rows, "article_id string, outlet string, country string, language string, topic string, canonical_topic_id string, f string").withColumn("fetched_at", F.col("f").cast("timestamp"))
    view = article_view(df)
    assert view.count() == 2
    assert view.where(scope_filter(Scope(country=" cz", outlet="x", language="CS"))).count() == 1


def test_divergence_is_symmetric_and_bounded(spark):
    p = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "outlet_lc string, articles long")
    q = spark.createDataFrame([("b", 2), ("d", 2)], "outlet_lc string, articles long")
    one, two = (mix.divergence(mix.shares(x), mix.shares(y)).first()[0] for x, y in ((p, q), (q, p)))
    assert one == two and 0 < one <= 1
    assert mix.divergence(mix.shares(p), mix.shares(p)).first()[0] == 0.0
    assert mix.divergence(mix.shares(p), mix.shares(q.limit(0))).first()[0] is None


def test_panel(spark):
    raw = signals(spark, [{"outlet": "A", "c": 0.8, "seg": (1, 0, 0, 0)}, {"outlet": "a", "c": 0.6, "seg": (1, 0, 0, 0)}, {"outlet": "B", "c": 0.1, "seg": (1, 0, 0, 0), "frame": "debate"}])
    row = mix.panel_profile(mix.outlet_profiles(signal_view(raw)), ["b", "a", "z"]).first()
    assert row["concern_level"] == 0.4 and row["observed"] == ["b", "a"] and row["missing"] == ["z"] and row["dominant_frame"] == "conflict"


def test_ema_rounds_every_step(spark):
    rows = [("s", f"2025-0{i}-01", 0.5, 0.0, 0.0, "fear", 30) for i in (1, 2, 3)] + [("s", "2025-04-01", 0.9, 0.0, 0.0, "x", 29)]
    df = spark.createDataFrame(rows, "segment string, day string, concern_level double, purchase_intent double, avoidance_signals double, dominant_frame string, article_count int")
    got = profiles.ema_fold(df, ["segment"], dict.fromkeys(C.SIGNALS, 0.0), "day").first()
    assert got["concern_level"] == 0.244 and got["sample_count"] == 3 and got["dominant_frame"] == "fear" and not got["is_learned"]


def test_empty_tables(spark):
    raw = signals(spark, [{}]).limit(0)
    view = signal_view(raw)
    assert profiles.segment_profile(view).count() == 4
    assert mix.mix_report(view, view).first()["warning"] == "no_current_articles"
