"""Duplicates, clusters, assignment, density clusters, lifecycle."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediagauge.operators import clusters as K
from mediagauge.operators import dedupe, density


def prepared(spark, rows):
    schema = "article_id string, w string, title string, summary string, body string, canonical_url string, f string, vector array<double>"
    df = spark.createDataFrame(rows, schema).withColumn("fetched_at", F.col("f").cast("timestamp"))
    return dedupe.prepared(df.drop("vector"), df.select("article_id", "vector"), ["w"])


ROWS = [
    ("a", "k", "Council opens the bridge", "s one two", "long body text here", "http://x/1", "2025-01-01", [1.0, 0.0, 0.0]),
    ("b", "k", "Other words entirely", "s", "b", " HTTP://X/1 ", "2025-01-02", [0.0, 1.0, 0.0]),
    ("c", "k", "COUNCIL opens the bridge!", "s", "b", "http://x/2", "2025-01-03", [0.0, 0.0, 1.0]),
    ("d", "k", "river floods many homes", "many homes by the river", "many homes", None, "2025-01-01", [0.5, 0.5, 0.01]),
    ("e", "k", "river floods several homes", "many homes by the river", "many homes", None, "2025-01-01", [0.5, 0.5, 0.0]),
    ("f", "other", "Council opens the bridge", None, None, "http://x/1", None, [1.0, 0.0, 0.0]),
    ("g", "k", None, None, None, None, None, None),
]


def test_rules_and_groups(spark):
    rows = prepared(spark, ROWS)
    edges = {(r["a"], r["b"], r["reason"]) for r in dedupe.duplicate_edges(rows, ["w"]).collect()}
    assert edges == {("a", "b", "canonical_url"), ("a", "c", "title"), ("d", "e", "semantic")}
    shown, totals = dedupe.duplicate_summary(rows, ["w"])
    assert {(r["root"], r["representative"], r["size"], r["reasons"]) for r in shown.collect()} == {("a", "a", 3, "canonical_url,title"), ("d", "e", 2, "semantic")}
    assert tuple(totals.first()) == (7, 4, 3, 2)
    assert dedupe.duplicate_edges(rows.limit(0), ["w"]).count() == 0


def test_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "TILE", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(f"a{i:02d}", "k", [float(v) for v in r]) for i, r in enumerate(x)], "article_id string, w string, vector array<double>")
    got = {(r["a"], r["b"]) for r in dedupe.similar_pairs(df, ["w"], 0.9).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == {(f"a{i:02d}", f"a{j:02d}") for i, j in itertools.combinations(range(40), 2) if u[i] @ u[j] >= 0.9}


def test_similar_pairs_of_a_large_window_come_from_broadcast_parts(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "TILE", 50)
    monkeypatch.setattr(dedupe, "SIDE_BYTES", 60 * 80 * 8)
    monkeypatch.setattr(dedupe, "BLOCK", 16)
    monkeypatch.setattr(dedupe, "WIDE", 32)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(50, 80)), 4, axis=0) + rng.normal(size=(200, 80)) * 0.3
    x[7], x[8] = 0.0, x[9]
    df = spark.createDataFrame([(f"a{i:03d}", "k" if i < 170 else "l", [float(v) for v in r]) for i, r in enumerate(x)], "article_id string, w string, vector array<float>")
    got = [(r["a"], r["b"]) for r in dedupe.similar_pairs(df, ["w"], 0.93).collect()]
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    expected = {(f"a{i:03d}", f"a{j:03d}") for i, j in itertools.combinations(range(200), 2) if (i < 170) == (j < 170) and u[i] @ u[j] >= 0.93}
    assert len(got) == len(set(got)) and set(got) == expected and 20 < len(expected) < 300


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (2, 5), (5, 2), (4, 4)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(30):
        cost = rng.integers(0, 9, shape).astype(float)
        pairs = K.assign(cost)
        small, large = min(shape), max(shape)
        flip = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(flip[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(pairs) == small and len({a for a, _ in pairs}) == small == len({b for _, b in pairs})
        assert sum(cost[a, b] for a, b in pairs) == best


def test_best_assignment_prefers_more_matches(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.1), (1, 2, 0.2, 0.3), (2, 1, 0.1, 0.2), (9, 9, 0.25, 0.4), (9, 8, 0.0, 0.6), (5, 5, 0.2, 0.5), (6, 6, 0.3, None)], "cluster_id long, track_id long, distance double, cost double")
    assert {tuple(r) for r in K.best_assignment(df).collect()} == {(1, 2, 0.2, 0.3), (2, 1, 0.1, 0.2), (9, 9, 0.25, 0.4)}
    assert K.best_assignment(df.limit(0)).count() == 0


def test_lifecycle(spark):
    tracks = spark.createDataFrame([(1, [1.0, 0.0], 20, 0), (2, [0.0, 1.0], 5, 2)], "track_id long, centroid array<double>, sample_count long, missed_runs int")
    clusters = spark.createDataFrame([(7, [0.0, 1.0], 12), (8, [1.0, 1.0], 40)], "cluster_id long, centroid array<double>, size long")
    matches = spark.createDataFrame([(7, 1)], "cluster_id long, track_id long")
    got = {r["match_type"]: r for r in K.lifecycle(tracks, matches, clusters).collect()}
    assert got["matched"]["sample_count"] == 32 and got["matched"]["is_learned"] and got["matched"]["missed_runs"] == 0
    assert np.allclose(got["matched"]["centroid"], np.array([0.8, 0.2]) / np.hypot(0.8, 0.2))
    assert not got["missing"]["active"] and got["missing"]["missed_runs"] == 3
    assert got["new"]["sample_count"] == 40 and not got["new"]["is_learned"]


def test_members_centroids_and_exemplars(spark):
    m = spark.createDataFrame(
        [("r", 1, "a", 1, 0.5, 0), ("r", 1, "a", 1, 0.5, 0), ("r", 1, "b", 2, 7.0, 0), ("r", None, "c", 3, 0.1, 1), ("r", 1, "d", 4, 0.1, 1), ("r", 1, "e", 5, None, None)],
        "run_id string, cluster_id long, article_id string, embedding_id long, membership_strength double, is_noise int",
    )
    e = spark.createDataFrame([(1, [3.0, 0.0], 2, "complete"), (2, [0.0, 3.0], 2, "complete"), (5, [float("nan"), 1.0], 2, "complete")], "embedding_id long, embedding_vector array<float>, embedding_dim int, status string")
    vectors = K.with_vectors(K.members(m), e)
    centres = K.centroids(vectors)
    row = centres.first()
    assert row["size"] == 2 and np.allclose(row["centroid"], [0.5**0.5] * 2)
    cos = K.member_cosines(vectors, centres)
    assert K.coherence(cos).first()["coherence"] == 0.7071
    assert [r["article_id"] for r in K.exemplars(cos, 1).collect()] == ["a"]
    assert K.fingerprints(K.members(m)).first()["fingerprint"] == K.fingerprints(K.members(m.orderBy(F.desc("article_id")))).first()["fingerprint"]


def test_agreement_bounds(spark):
    rows = [(f"a{i}", i % 3) for i in range(30)]
    x = spark.createDataFrame(rows, "article_id string, label long")
    y = x.withColumn("label", 10 - F.col("label"))
    assert tuple(K.run_agreement(x, y).first()) == (30, 1.0, 1.0)
    assert {r["survival"] for r in K.survival(x, y).collect()} == {1.0}
    assert K.run_agreement(x.limit(0), y).first()["articles"] == 0


def test_density_finds_blobs_and_noise():
    rng = np.random.default_rng(3)
    blobs = np.concatenate([rng.normal(c, 0.05, (12, 2)) for c in ((0, 0), (3, 3), (0, 4))] + [rng.uniform(-20, 20, (4, 2))])
    labels, strength = density.density_labels(blobs)
    for k in range(3):
        assert len(set(labels[12 * k : 12 * k + 12])) == 1
    assert len(set(labels[:36])) == 3 and ((strength >= 0) & (strength <= 1)).all()
    assert (density.density_labels(np.zeros((2, 2)))[0] == -1).all()
    assert len(set(density.density_labels(np.zeros((9, 2)))[0])) >= 1


def test_stability_of_clear_groups(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(4)[:3] * 5
    rows = [("w", f"a{i:02d}", [float(v) for v in centres[i % 3] + rng.normal(0, 0.02, 4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "w string, article_id string, vector array<double>")
    r = density.stability(df, ["w"], rounds=5).first()
    assert r["ari_median"] > 0.9 and r["rounds"] == 5
    assert density.cluster_windows(df.limit(3), ["w"]).where("label >= 0").count() == 0


def test_stability_reports_small_windows_survival_and_information(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(4) * 5
    vector = lambda i, k: [float(v) for v in centres[i % k] + rng.normal(0, 0.02, 4)]
    rows = [("w", f"a{i:02d}", vector(i, 3)) for i in range(30)] + [("small", f"b{i}", vector(i, 2)) for i in range(8)] + [("tiny", f"c{i}", vector(i, 2)) for i in range(4)]
    df = spark.createDataFrame(rows, "w string, article_id string, vector array<double>")
    got = {r["w"]: r for r in density.stability(df, ["w"]).collect()}
    assert {w: r["status"] for w, r in got.items()} == {"w": "completed", "small": "completed", "tiny": "skipped_small_sample"}
    assert {w: (r["articles"], r["rounds"], r["failed_rounds"]) for w, r in got.items()} == {"w": (30, 25, 0), "small": (8, 25, 0), "tiny": (4, 0, 0)}
    assert [(c["size"], c["survival_median"]) for c in got["w"]["clusters"]] == [(10, 1.0)] * 3 and got["w"]["nmi_median"] > 0.9
    assert all(c["coherence"] > 0.99 and 0 < c["rounds"] <= 25 for c in got["w"]["clusters"])
    assert got["tiny"]["ari_median"] is None and got["tiny"]["clusters"] == []


def test_stability_is_the_same_in_one_task_and_in_many(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(24, 3))
    df = spark.createDataFrame([("w", f"a{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)], "w string, article_id string, vector array<double>")
    once = density.stability(df, ["w"], rounds=7).collect()
    monkeypatch.setattr(density, "APART", 10)
    assert density.stability(df, ["w"], rounds=7).collect() == once and once[0]["rounds"] == 7


def test_information_of_labels():
    a = np.array([0, 0, 1, 1, -1, -1])
    assert density._nmi(a, 7 - a) == pytest.approx(1.0) and density._nmi(a, np.zeros(6, int)) == 0.0 and density._nmi(a[:2], a[:2]) == 1.0
    assert density._nmi(np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])) == 0.0


def test_density_clusters_work_on_one_of_each_group_of_duplicates(spark, monkeypatch):
    from mediagauge.plans import clusters as plans

    rows = prepared(spark, ROWS).withColumnRenamed("w", "canonical_topic_id").withColumn("period", F.lit("2025-01-01").cast("date"))
    monkeypatch.setattr(plans, "_prepared", lambda *_: rows)
    assert {r["article_id"] for r in plans.density_clusters(spark, "").collect()} == {"a", "e", "f"}
    assert {(r["canonical_topic_id"], r["articles"], r["status"]) for r in plans.stability_report(spark, "").collect()} == {("k", 2, "skipped_small_sample"), ("other", 1, "skipped_small_sample")}


def test_duplicates_of_all_articles_cross_topics_years_and_missing_topics(spark, monkeypatch):
    from mediagauge.plans import clusters as plans

    schema = "article_id string, title string, summary string, body string, canonical_url string, f string, canonical_topic_id string, vector array<double>"
    text = ("many homes by the river", "many homes")
    rows = [
        ("a", "first title of all", "s", "b", "http://x/1", "2024-12-31", "t", None),
        ("b", "second title of all", "s", "b", "http://x/1", "2025-01-01", "t", None),
        ("c", "river floods many homes", *text, None, "2025-01-01", None, [0.5, 0.5, 0.01]),
        ("d", "river floods several homes", *text, None, None, "u", [0.5, 0.5, 0.0]),
        ("e", "river floods many towns", *text, None, "2025-01-01", "u", [0.5, 0.5]),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("fetched_at", F.col("f").cast("timestamp"))
    monkeypatch.setattr(plans, "_articles", lambda *_: (df.drop("vector"), df.select("article_id", "vector").where("vector is not null")))
    assert {tuple(r) for r in plans.dup_edges_all(spark, "").collect()} == {("a", "b", "canonical_url"), ("c", "d", "semantic")}
    assert tuple(plans.dedupe_stats_all(spark, "").first()) == (5, 3, 2, 2)
    assert {(r["root"], r["representative"], r["size"]) for r in plans.dup_representatives_all(spark, "").collect()} == {("a", "b", 2), ("c", "c", 2)}
    assert plans.dup_edges(spark, "").count() == 0
