"""Rewards, state, scores and ranked evidence."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mediagauge.operators import bandit as B
from mediagauge.operators import ranking as R


@pytest.mark.parametrize(("accepted", "duplicates", "relevance", "fetched", "expected"), [(4, 1, 0.8, True, 0.52), (8, 0, 1.0, True, 1.0), (0, 0, None, True, 0.0), (5, 0, 0.9, False, 0.0), (0, 5, 0.1, True, 0.0)])
def test_yield_reward(spark, accepted, duplicates, relevance, fetched, expected):
    df = spark.createDataFrame([(accepted, duplicates, relevance, fetched)], "a int, d int, r double, f boolean")
    assert df.select(B.yield_reward(F.col("a"), F.col("d"), F.col("r"), F.col("f")).alias("x")).first()["x"] == expected


def test_signal_reward(spark):
    df = spark.createDataFrame([(0.8, 0.9, 0.5)], "concern_level double, purchase_intent double, avoidance_signals double")
    assert df.select(B.signal_reward("civic").alias("x")).first()["x"] == 0.68


def test_state_scores_and_choice(spark):
    arms = spark.createDataFrame([("x", "family", 9), ("y", "b2b", 9), ("z", None, 23)], "outlet string, tag string, hour int")
    arms = arms.select("outlet", B.context(F.col("tag"), F.lit("civic"), F.col("hour")).alias("places"))
    places = {r["outlet"]: r["places"] for r in arms.collect()}
    assert places["z"] == [0, 6, 13] and len(places["x"]) == 4
    pulls = spark.createDataFrame([("x", places["x"], 1.0), ("x", places["x"], 0.5), ("y", places["y"], 0.0)], "outlet string, places array<int>, reward double")
    state = B.accumulate(pulls)
    cell = state.where("outlet = 'x' and i = 0 and j = 0").first()
    assert (cell["a"], cell["b"]) == (2, 1.5)
    scored = {r["outlet"]: r for r in B.scores(state, arms).collect()}
    # A = I + 2 x xT for four active places: expected 1.5 * 4 / 9, uncertainty 4 / 9
    assert scored["x"]["score"] == pytest.approx(6 / 9 + 0.85 * (4 / 9) ** 0.5, abs=1e-6)
    assert scored["z"]["pulls"] == 0 and scored["z"]["score"] == pytest.approx(0.85 * 3**0.5, abs=1e-6)
    order = [r["outlet"] for r in B.select_outlets(B.scores(state, arms), 2).orderBy("rank").collect()]
    assert order == ["z", "x"]


def test_priorities_share_out(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", -2.0)], "k string, s double")
    assert {r["k"]: r["priority"] for r in R.priorities(df, F.col("s")).collect()} == {"a": 0.75, "b": 0.25, "c": 0.0}
    assert {r["priority"] for r in R.priorities(df.where("s < 0"), F.col("s")).collect()} == {0.0}


def test_segment_evidence(spark):
    rows = [(i, f"a{i}", f"2025-01-0{i + 1}", 0.9, 0.1, None, float("nan")) for i in range(4)]
    df = spark.createDataFrame(rows, "signal_id long, article_id string, t string, seg_young_urban double, seg_family double, seg_senior double, seg_b2b double").withColumn("extracted_at", F.col("t").cast("timestamp"))
    assert {(r["segment"], r["signal_id"], r["rank"]) for r in R.segment_evidence(df).collect()} == {("young_urban", 3, 1), ("young_urban", 2, 2)}
