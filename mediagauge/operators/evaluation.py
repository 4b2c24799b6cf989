"""Quality of labels: buckets, confusion, accuracy, macro-F1, distributions, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.functions.text import fold_key


def bucket(c: Column, low: float, high: float, names: tuple[str, str, str] = ("0", "1", "2")) -> Column:
    """Name of the third that a value falls into; null and NaN stay null."""
    fine = c.isNotNull() & ~F.isnan(c)
    return F.when(fine, F.when(c < low, names[0]).when(c < high, names[1]).otherwise(names[2]))


# Cutoffs of each field's labels, and the signal that it comes from.
CUTOFFS = {
    "topic_relevance": ("topic_relevance_score", 0.55, 0.80),
    "concern_bucket": ("concern_level", 0.34, 0.67),
    "purchase_relevance": ("purchase_intent", 0.25, 0.67),
    "avoidance_relevance": ("avoidance_signals", 0.25, 0.67),
    "seg_young_urban_relevance": ("seg_young_urban", 0.20, 0.45),
    "seg_family_relevance": ("seg_family", 0.20, 0.45),
    "seg_senior_relevance": ("seg_senior", 0.20, 0.45),
    "seg_b2b_relevance": ("seg_b2b", 0.20, 0.45),
}


def signal_labels(signals: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, field_name, label``: the label that each signal falls into, and the frame; nulls left out."""
    parts = []
    for field, (signal, low, high) in CUTOFFS.items():
        names = tuple(C.BUCKET_LABELS) if field == "concern_bucket" else ("0", "1", "2")
        parts.append(F.struct(F.lit(field).alias("field_name"), bucket(F.col(signal), low, high, names).alias("label")))
    frame = F.when(F.col("frame").isin(*C.FRAME_LABELS), F.col("frame")).otherwise("other")
    parts.append(F.struct(F.lit("dominant_frame").alias("field_name"), frame.alias("label")))
    return signals.select(*keys, F.explode(F.array(*parts)).alias("p")).select(*keys, "p.*").where("label is not null")


def resolved_labels(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """Latest vote per article, field and annotator with its canonical label, null if no spelling fits."""
    rows = labels.select("article_id", "field_name", fold_key(F.col("annotator")).alias("annotator"), fold_key(F.col("label")).alias("alias"), "labelled_at", "vote_id")
    rows = rows.where("article_id is not null and field_name is not null and annotator is not null")
    latest = rows.groupBy("article_id", "field_name", "annotator").agg(F.max(F.struct("labelled_at", "vote_id", "alias")).alias("r"))
    known = aliases.select("field_name", fold_key(F.col("alias")).alias("alias"), "canonical_label").groupBy("field_name", "alias").agg(F.min("canonical_label").alias("label"))
    return latest.select("article_id", "field_name", "annotator", F.col("r.alias").alias("alias")).join(known, ["field_name", "alias"], "left").drop("alias")


def field_group() -> Column:
    """Group of field_name."""
    pairs = [(f, g) for g, fields in C.LABEL_FIELDS.items() for f in fields]
    return reduce(lambda acc, p: acc.when(F.col("field_name") == p[0], p[1]), pairs[1:], F.when(F.col("field_name") == pairs[0][0], pairs[0][1]))


def confusion(gold: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, expected, predicted, n`` over items with both labels; inputs share article_id, field_name."""
    both = gold.select("article_id", "field_name", F.col("label").alias("expected")).join(predictions.withColumnRenamed("label", "predicted"), ["article_id", "field_name"])
    return both.where("expected is not null and predicted is not null").groupBy(*keys, "expected", "predicted").agg(F.count("*").alias("n"))


def metrics(table: DataFrame, keys: list[str]) -> DataFrame:
    """Support, correct, accuracy, macro-F1 and total variation distance of a confusion table.

    Macro-F1 averages the labels that occur on either side, four decimals; the distance is
    between label distributions rounded to four decimals, so it has five itself.
    """
    hit = F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)
    totals = table.groupBy(*keys).agg(F.sum("n").alias("support"), F.sum(hit).alias("correct"))
    side = F.explode(F.array(F.struct(F.col("expected").alias("label"), F.col("n").alias("e"), F.lit(0).cast("bigint").alias("p"), hit.cast("bigint").alias("tp")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("e"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("tp"))))
    per = table.select(*keys, side.alias("s")).select(*keys, "s.*").groupBy(*keys, "label").agg(F.sum("e").alias("e"), F.sum("p").alias("p"), F.sum("tp").alias("tp"))
    joined = per.join(totals.select(*keys, "support"), keys) if keys else per.crossJoin(totals.select("support"))
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (F.col("e") + F.col("p"))).otherwise(0.0)
    gap = F.abs(F.round(F.col("e") / F.col("support"), 4) - F.round(F.col("p") / F.col("support"), 4))
    scores = joined.groupBy(*keys).agg(F.round(F.avg(f1), 4).alias("macro_f1"), F.round(F.sum(gap) * 0.5, 5).alias("tvd"))
    out = totals.join(scores, keys) if keys else totals.crossJoin(scores)
    return out.withColumn("accuracy", F.round(F.col("correct") / F.col("support"), 4)).select(*keys, "support", "correct", "accuracy", "macro_f1", "tvd")


def accuracy_cube(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Support, correct and accuracy overall, per group, per field and per annotator and field, in one pass."""
    both = gold.select("article_id", "field_name", F.col("label").alias("expected")).join(predictions, ["article_id", "field_name"]).where("expected is not null and label is not null")
    both = both.withColumn("field_group", field_group()).withColumn("hit", (F.col("expected") == F.col("label")).cast("bigint"))
    keys = ["field_group", "field_name", "annotator"]
    cube = both.groupingSets([keys[:n] for n in range(4)], *keys).agg(F.count("*").alias("support"), F.sum("hit").alias("correct"))
    named = [F.coalesce(k, F.lit("(all)")).alias(k) for k in keys]
    return cube.select(*named, "support", "correct", F.round(F.col("correct") / F.col("support"), 4).alias("accuracy"))


def topic_accuracy(gold: DataFrame, predictions: DataFrame, topics: DataFrame) -> DataFrame:
    """Support, correct and accuracy per topic and field, per topic, and per field; ``topics`` has article_id and topic, once each.

    Items of articles without a topic count under (missing).
    """
    both = gold.select("article_id", "field_name", F.col("label").alias("expected")).join(predictions, ["article_id", "field_name"]).where("expected is not null and label is not null")
    both = both.join(topics.select("article_id", F.col("topic").alias("of_topic")), "article_id", "left").withColumn("topic", F.coalesce("of_topic", F.lit("(missing)")))
    both = both.withColumn("hit", (F.col("expected") == F.col("label")).cast("bigint"))
    cube = both.groupingSets([["topic", "field_name"], ["topic"], ["field_name"]], "topic", "field_name").agg(F.count("*").alias("support"), F.sum("hit").alias("correct"))
    named = [F.coalesce(k, F.lit("(all)")).alias(k) for k in ("topic", "field_name")]
    return cube.select(*named, "support", "correct", F.round(F.col("correct") / F.col("support"), 4).alias("accuracy"))


def pairwise_agreement(votes: DataFrame) -> DataFrame:
    """Per pair of annotators: items both labelled, and the share on which they agree."""
    items = votes.where("label is not null").groupBy("article_id", "field_name").agg(F.sort_array(F.collect_list(F.struct("annotator", "label"))).alias("v"))
    ahead = F.transform("v", lambda x, i: F.transform(F.slice(F.col("v"), i + 2, F.size("v")), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    pairs = items.select(F.explode(F.flatten(ahead)).alias("p"))
    return pairs.groupBy(F.col("p.x.annotator").alias("left_annotator"), F.col("p.y.annotator").alias("right_annotator")).agg(
        F.count("*").alias("items"), F.round(F.avg((F.col("p.x.label") == F.col("p.y.label")).cast("double")), 4).alias("agreement")
    )


def vote_patterns(votes: DataFrame, annotators: list[str]) -> DataFrame:
    """How the votes of ``annotators`` split, such as 3/1, with the number of items."""
    mine = votes.where(F.col("annotator").isin(*annotators) & F.col("label").isNotNull())
    counts = mine.groupBy("article_id", "field_name", "label").agg(F.count("*").alias("n"))
    shape = F.array_join(F.transform(F.sort_array(F.collect_list("n"), asc=False), lambda x: x.cast("string")), "/")
    return counts.groupBy("article_id", "field_name").agg(shape.alias("pattern")).groupBy("pattern").agg(F.count("*").alias("items"))


def coverage_gaps(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Items expected without prediction and predicted without expectation."""
    key = ["article_id", "field_name"]
    g, p = gold.select(*key).distinct(), predictions.select(*key).distinct()
    missing = g.join(p, key, "left_anti").agg(F.count("*").alias("missing"))
    return missing.crossJoin(p.join(g, key, "left_anti").agg(F.count("*").alias("unexpected")))
