"""Observations, rollups, extraction, briefs: exact values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.operators import brief as B
from mediagauge.operators import extraction as X
from mediagauge.operators import observations as O
from mediagauge.operators import profiles as P

ROW = "member_count long, mean_strength double, concern_level double, purchase_intent double, avoidance_signals double, seg_young_urban double, seg_family double, seg_senior double, seg_b2b double, frame string, label string"


@pytest.mark.parametrize(("a", "b", "penalty"), [("", "x", 1.0), ("Prices up!", "prices UP", 0.0), ("prices", "prices up", 0.25), ("one two", "two three", 0.6667), (None, "x", 1.0)])
def test_label_penalty(spark, a, b, penalty):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(O.label_penalty(F.col("a"), F.col("b")).alias("p")).first()["p"] == penalty


def test_pair_cost(spark):
    df = spark.createDataFrame([(0.0, "x", 1.0, 0.0, 0.0, "y", 0.0, 1.0, 0.0), (0.3, "x", 1.0, 0.0, 0.0, "x", 1.0, 0.0, 0.0)], "distance double, label string, concern_level double, purchase_intent double, avoidance_signals double, base_label string, base_concern_level double, base_purchase_intent double, base_avoidance_signals double")
    one, two = O.pair_metrics(df, "commerce").collect()
    assert (one["signal_distance"], one["label_penalty"], one["cost"]) == (1.0, 1.0, 0.25)
    assert two["cost"] is None


def test_observations_and_rollup(spark):
    now = spark.createDataFrame([(1, 10, 0.8, 0.9, 0.2, 0.1, 1.0, 0.0, 0.0, 0.0, "fear", "a"), (2, 30, 0.5, 0.4, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, "neutral", "b")], "cluster_id long, " + ROW)
    then = spark.createDataFrame([(7, 40, 0.6, 0.4, 0.2, 0.1, 1.0, 0.0, 0.0, 0.0, "conflict", "a"), (8, 5, 0.6, 0.4, 0.2, 0.1, 0.0, 0.0, 1.0, 0.0, "fear", "c")], "track_id long, " + ROW)
    obs = O.observations(now, then, spark.createDataFrame([(1, 7, 0.1)], "cluster_id long, track_id long, distance double"), "commerce")
    got = {r["match_type"]: r for r in obs.collect()}
    m = got["matched"]
    assert (m["delta_concern_level"], m["signal_drift"], m["drift_magnitude"], m["frame_shift"], m["direction"]) == (0.5, 0.2, 0.17, True, "rising")
    assert m["confidence"] == 0.75 and got["new"]["direction"] == "emerging" and got["missing"]["direction"] == "fading"
    assert got["new"]["drift_magnitude"] == got["missing"]["drift_magnitude"] == 0.0
    rolled = {r["segment"]: r for r in O.segment_rollup(obs).collect()}
    assert rolled["young_urban"]["drift_magnitude"] == 0.17 and rolled["young_urban"]["direction"] == "tracked" and rolled["young_urban"]["concern_level"] == 0.9
    assert rolled["family"]["direction"] == "emerging" and rolled["senior"]["direction"] == "fading" and rolled["b2b"]["alert_level"] == "no_data"
    assert {r["match_type"] for r in O.select_observations(obs, 2, fading=True).collect()} == {"matched", "missing"}
    assert O.segment_rollup(obs.limit(0)).count() == 0


def test_answers_are_normalised(spark):
    raw = [("a", 'Sure: ```json\n{"concern_level": 7, "purchase_intent": "0.5", "dominant_frame": "Risk", "seg_family_relevance": 1}\n```', "family"), ("b", "nonsense", None), ("c", None, "unheard of")]
    df = spark.createDataFrame(raw, "article_id string, raw_json string, affinity_tag string")
    got = {r["article_id"]: r for r in X.normalized_answers(df, "civic").collect()}
    assert (got["a"]["concern_level"], got["a"]["purchase_intent"], got["a"]["frame"]) == (1.0, 0.0, "fear")
    assert got["a"]["seg_family"] > 0.8
    for k in "bc":
        assert (got[k]["concern_level"], got[k]["frame"], got[k]["seg_young_urban"]) == (0.5, "neutral", 0.265)


def test_extraction_of_pending(spark):
    articles = spark.createDataFrame([("a", "Krize a obavy z nedostatku", None, "Spor o ceny, kritizují i další"), ("b", None, None, None)], "article_id string, title string, summary string, body string")
    done = spark.createDataFrame([("b",)], "article_id string")
    rows = X.extract_pending(articles, done, "commerce").collect()
    assert [r["article_id"] for r in rows] == ["a"] and rows[0]["concern_level"] == 0.6 and rows[0]["frame"] == "conflict"


def test_relevance_entities_claims(spark):
    df = spark.createDataFrame([("Ceny v Praze", "nic", 0.7), ("x", "o cenách ceny", 0.2), ("x", "y", 2.0), (None, None, None)], "t string, s string, c double")
    assert [r[0] for r in df.select(X.relevance(["CENY ", "", "ceny"], F.col("t"), F.col("s"), F.col("c"))).collect()] == [1.0, 0.95, 1.0, 0.0]
    assert df.select(X.relevance([], F.col("t"), F.col("s"))).first()[0] == 1.0
    text = spark.createDataFrame([("Jan Novák a Jan Novák potkali Evu Malou. Praha.",)], "t string")
    assert text.select(X.entities(F.col("t"))).first()[0] == ["jan novák", "evu malou"]
    assert spark.createDataFrame([("Concern rose by +0.42, purchase fell -0.1",)], "t string").select(X.numeric_claims(F.col("t"))).first()[0] == ["+0.42", "-0.1"]


def test_brief_and_issues(spark):
    values = [("family", 40, 0.5, 0.3, "fear", "strong", 0.5, True, "ready"), ("senior", 3, -0.2, 0.05, "fear", "none", 0.2, False, "warming"), ("b2b", 0, None, 0.0, "neutral", "no_data", 0.15, False, "no_data")]
    drift = spark.createDataFrame(values, "segment string, article_count long, d double, drift_magnitude double, dominant_frame string, alert_level string, confidence double, frame_shift boolean, status string")
    drift = drift.select("*", F.col("d").alias("delta_concern_level"), F.lit(0.0).alias("delta_purchase_intent"), F.lit(0.0).alias("delta_avoidance_signals"))
    row = B.brief(drift, "t").first()
    assert (row["status"], row["most_affected_segment"], row["drift_type"], row["hypothesis_segments"], row["confidence_label"]) == ("ready", "family", "concern_spike", "family,senior,b2b", "medium")
    briefs = spark.createDataFrame(
        [("good", "ready", "family", "strong", ["a1"], [("family", "concern_level", 0.52)]), ("bad", "insufficient_data", "senior", "mild", ["zz"], [("b2b", "concern_level", 0.0), ("senior", "concern_level", 0.4)])],
        "brief_id string, status string, most_affected_segment string, alert_level string, cited_articles array<string>, hypotheses array<struct<segment:string,signal:string,delta:double>>",
    )
    chosen = spark.createDataFrame([("a1",)], "article_id string")
    got = {(r["brief_id"], r["code"]) for r in B.brief_issues(briefs, drift, chosen).collect()}
    assert got == {("bad", c) for c in ("cited_article_not_selected", "insufficient_data_with_articles", "most_affected_segment_not_top_ranked", "alert_level_differs_from_top_segment", "hypothesis_segment_missing_from_evidence", "hypothesis_delta_mismatch")}
    assert not [r for r in B.brief_issues(briefs, drift, chosen.limit(0)).collect() if r["code"] == "cited_article_not_selected"]


def test_confidence_of_an_observation(spark):
    c = O.observation_confidence(F.lit(50), F.lit(1.0), F.lit(50), F.lit(True))
    assert spark.range(1).select(c).first()[0] == 1.0
    assert len(C.SEGMENTS) == 4 and P.alert_level is not None


def test_pipeline_stages(spark):
    from mediagauge.operators.latest import model_version, panel_outlets
    from mediagauge.plans.pipeline import run_scope, stage_table
    from tests.test_profiles import signals

    articles = spark.createDataFrame([(f"a{i}", "o", "CZ", "cs", "t", "t", f"Title {i}", "s", "b", "2025-01-01") for i in range(8)], "article_id string, outlet string, country string, language string, topic string, canonical_topic_id string, title string, summary string, body string, f string").withColumn("fetched_at", F.col("f").cast("timestamp"))
    raw = signals(spark, [{"article_id": f"a{i}", "c": 0.9, "seg": (1, 0, 0, 0)} for i in range(7)])
    empty = spark.createDataFrame([], "embedding_id long, article_id string, embedding_dim int, embedding_vector array<float>, status string, model_version string, embedded_at timestamp")
    out = run_scope(articles, raw, empty, "t", "2025-01-05", 7, "commerce")
    status = {r["stage"]: r["status"] for r in stage_table(spark, out).collect()}
    assert status["drift"] == status["brief"] == status["digest"] == "completed" and status["stories"] == "skipped" == status["story_signals"]
    assert out.tables["extraction"].count() == 1 and out.tables["brief"].first()["most_affected_segment"] == "young_urban"
    vectors = spark.createDataFrame([(i, f"a{i}", 2, [1.0, 0.01 * (i % 2)], "complete", "v1", None) for i in range(7)], empty.schema)
    again = run_scope(articles, raw, vectors, "t", "2025-01-05", 7, "commerce")
    assert {s.name: s.status for s in again.stages}["story_signals"] == "completed"
    assert model_version(vectors).first()[0] == "v1" and model_version(empty).first()[0] == "none"
    assert panel_outlets("commerce", "CZ", C.PANELS, C.PANEL_EXTRAS) == ["irozhlas", "ct24", "idnes", "e15", "irozhlas_eko"]
