"""Label buckets and quality metrics."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mediagauge.operators import evaluation as E


@pytest.mark.parametrize(
    ("field", "value", "label"),
    [("concern_bucket", 0.7, "high"), ("purchase_relevance", 0.3, "1"), ("seg_b2b_relevance", 0.19, "0"), ("seg_b2b_relevance", 0.2, "1"), ("seg_b2b_relevance", 0.46, "2"), ("seg_b2b_relevance", 0.45, "2"), ("topic_relevance", 0.55, "1"), ("topic_relevance", None, None), ("topic_relevance", float("nan"), None)],
)
def test_buckets(spark, field, value, label):
    _, low, high = E.CUTOFFS[field]
    names = ("low", "medium", "high") if field == "concern_bucket" else ("0", "1", "2")
    assert spark.createDataFrame([(value,)], "v double").select(E.bucket(F.col("v"), low, high, names).alias("l")).first()["l"] == label


def test_metrics(spark):
    gold = spark.createDataFrame([("1", "f", "x"), ("2", "f", "x"), ("3", "f", "y"), ("4", "f", None), ("9", "f", "x")], "article_id string, field_name string, label string")
    votes = spark.createDataFrame([("1", "f", "m", "x"), ("2", "f", "m", "y"), ("3", "f", "m", "y"), ("4", "f", "m", "y"), ("8", "f", "m", "x")], "article_id string, field_name string, annotator string, label string")
    row = E.metrics(E.confusion(gold, votes, ["annotator"]), ["annotator"]).first()
    assert (row["support"], row["correct"], row["accuracy"], row["macro_f1"]) == (3, 2, 0.6667, 0.6667)
    assert row["tvd"] == 0.3334
    assert tuple(E.coverage_gaps(gold.where("label is not null"), votes).first()) == (1, 2)
    cube = E.accuracy_cube(gold, votes)
    assert cube.where("field_name = '(all)' and field_group = '(all)'").first()["support"] == 3
    assert E.metrics(E.confusion(gold.limit(0), votes, ["annotator"]), ["annotator"]).count() == 0


def test_agreement_and_patterns(spark):
    rows = [("1", "f", a, x) for a, x in zip("abcd", "xxxy", strict=True)] + [("2", "f", a, x) for a, x in zip("abcd", "xxyz", strict=True)] + [("3", "f", "a", None)]
    votes = spark.createDataFrame(rows, "article_id string, field_name string, annotator string, label string")
    pairs = {(r[0], r[1]): (r[2], r[3]) for r in E.pairwise_agreement(votes).collect()}
    assert len(pairs) == 6 and pairs["a", "b"] == (2, 1.0) and pairs["a", "c"] == (2, 0.5)
    assert {tuple(r) for r in E.vote_patterns(votes, list("abcd")).collect()} == {("3/1", 1), ("2/1/1", 1)}
