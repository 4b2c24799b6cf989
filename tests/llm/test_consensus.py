"""Truth discovery and the strict majority."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mediagauge.llm import consensus
from mediagauge.llm.consensus import chi2_low, consensus_items, discover, strict_consensus, valid_votes

VOTES = "vote_id long, batch string, article_id string, field_name string, annotator string, label string, t string"


@pytest.fixture
def aliases(spark):
    return spark.createDataFrame([("f", "Yes ", "1"), ("f", "ano", "1"), ("f", "no", "0"), ("g", "no", "2")], "field_name string, alias string, canonical_label string")


def votes(spark, rows):
    return spark.createDataFrame(rows, VOTES).withColumn("labelled_at", F.col("t").cast("timestamp")).drop("t")


def test_latest_valid_vote_counts(spark, aliases):
    rows = [
        (1, "b", "a", "f", "M1", "no", "2025-01-01"),
        (2, "b", "a", "f", " m1 ", "YES", "2025-01-02"),
        (3, "b", "a", "f", "m2", "yes", None),
        (4, "b", "a", "f", "m2", "ANO ", None),
        (4, "b", "a", "f", "m2", "ANO ", None),
        (5, "b", "a", "f", "m3", "no", "2025-01-01"),
        (6, "b", "a", "f", "m4", "yes", "2025-01-01"),
        (7, "b", "a", "f", "m4", "???", "2025-01-02"),
        (8, "b", "a", None, "m5", "no", "2025-01-01"),
        (9, "b", "a", "f", None, "no", "2025-01-01"),
        (10, "b", "a", "f", "  ", "no", "2025-01-01"),
        (11, "b", "gone", "f", "m1", "no", "2025-01-01"),
        (12, "b", "gone", "f", "m2", "no", "2025-01-01"),
        (13, "b", "gone", "f", "m3", "no", "2025-01-01"),
        (14, "b", "two", "f", "m1", "no", "2025-01-01"),
        (15, "b", "two", "f", "m2", None, "2025-01-01"),
    ]
    df = votes(spark, rows)
    got = {(r["article_id"], r["annotator"], r["label"]) for r in valid_votes(df, aliases).where("article_id = 'a'").collect()}
    assert got == {("a", "m1", "1"), ("a", "m2", "1"), ("a", "m3", "0")}
    articles = spark.createDataFrame([("a", "x"), ("a", "y"), ("two", "x"), (None, "x")], "article_id string, label string")
    assert [tuple(r) for r in strict_consensus(df, aliases, articles).collect()] == [("a", "f", "1")]
    assert strict_consensus(df.limit(0), aliases, articles).count() == 0


def test_reliable_annotators_win(spark):
    rng = random.Random(0)
    rows = []
    for i in range(300):
        truth = rng.choice("012")
        for who, p in (("good", 0.97), ("fair", 0.9), ("bad1", 0.35), ("bad2", 0.35), ("bad3", 0.35)):
            rows.append((f"a{i}", "f", who, truth if rng.random() < p else rng.choice([x for x in "012" if x != truth])))
        rows.append((f"a{i}", "truth", "-", truth))
    df = spark.createDataFrame(rows, "article_id string, field_name string, annotator string, label string")
    found = discover(df.where("field_name = 'f'"), anchor=None)
    truth = df.where("field_name = 'truth'").select("article_id", F.col("label").alias("truth"))
    items = consensus_items(found).join(truth, "article_id")
    weighted = items.agg(F.avg((F.col("consensus_label") == F.col("truth")).cast("double"))).first()[0]
    weights = {r["annotator"]: r["weight"] for r in found.annotators.collect()}
    by_item = {}
    for a, f, _, label in rows:
        by_item.setdefault(a, {})[f] = [*by_item.get(a, {}).get(f, []), label]
    majority = sum(max(sorted(set(v["f"])), key=v["f"].count) == v["truth"][0] for v in by_item.values()) / len(by_item)
    assert weighted > majority + 0.05 and min(weights["good"], weights["fair"]) > 0.9 and max(weights[f"bad{i}"] for i in (1, 2, 3)) < 0.7


def test_rare_annotators_gain_little(spark):
    low = spark.createDataFrame([(1.0,), (10.0,), (100.0,)], "n double").select((chi2_low(F.col("n")) / F.col("n")).alias("r"))
    r = [x["r"] for x in low.collect()]
    assert r[0] < r[1] < r[2] < 1


def test_found_labels_are_those_of_the_discovery(spark, monkeypatch):
    """Without anchors the weights overrule some majorities, and the found rows change."""
    aliases = spark.createDataFrame([("f", x, x) for x in "012"], "field_name string, alias string, canonical_label string")
    rng = random.Random(1)
    rows, n = [], 0
    for i in range(200):
        truth = rng.choice("012")
        for who, p in (("good", 1.0), ("fair", 0.97), ("bad1", 0.35), ("bad2", 0.35), ("bad3", 0.35)):
            n += 1
            rows.append((n, "b", f"a{i}", "f", who, truth if rng.random() < p else rng.choice([x for x in "012" if x != truth]), "2025-01-01"))
    articles = spark.createDataFrame([(f"a{i}",) for i in range(200)], "article_id string")
    df = votes(spark, rows)
    whole = strict_consensus(df, aliases, articles).count()
    plain = consensus.discover
    monkeypatch.setattr(consensus, "discover", lambda v, **kw: plain(v, anchor=None))
    assert strict_consensus(df, aliases, articles).count() < whole
