"""Consensus of disagreeing annotators by confidence-aware truth discovery.

Each annotator is weighted by the inverse of an upper confidence bound on the error variance:
the chi-squared quantile of the number of votes, divided by the sum of label distances to the
current consensus of the others. Few votes give a small quantile, so a rare contributor cannot gain much
weight by luck. Consensus and weights are computed in turn until the labels settle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagauge.functions.text import fold_key
from mediagauge.llm.vectors import maybe_broadcast
from mediagauge.session import discard, materialize

#: Standard normal quantile of half the significance level 0.05.
Z_LOW = -1.959963985
#: Distance added to each annotator's errors, so that faultless ones keep a finite weight.
PRIOR_ERROR = 0.5
MAX_ROUNDS = 10
#: Votes of an item from which a majority of more than half settles it.
ANCHOR = 3
#: Rounds stop when fewer than this share of the consensus labels changes.
SETTLED = 0.0005
ITEM = ["article_id", "field_name"]


@dataclass
class Consensus:
    """labels: scores of every label of an item; annotators: reliability of each; rounds used."""

    labels: DataFrame
    annotators: DataFrame
    rounds: int


def chi2_low(n: Column) -> Column:
    """Lower 2.5 % quantile of the chi-squared distribution by the Wilson-Hilferty transform."""
    h = F.lit(2.0) / (F.lit(9.0) * n)
    return F.greatest(n * F.pow(F.greatest(1.0 - h + Z_LOW * F.sqrt(h), F.lit(0.0)), 3), F.lit(1e-3))


def distance_to_others() -> Column:
    """Distance of a vote (label, weight) to the consensus of the item's other votes (spread).

    0 if the others alone would choose the label, 1 if they would not, in between for a tie; null
    where there are no others. An annotator's own vote is left out, as it would confirm itself.
    """
    others = F.filter("spread", lambda s: s["label"] != F.col("label"))
    most = F.array_max(F.transform(others, lambda s: s["score"]))
    own = F.array_max(F.transform(F.filter("spread", lambda s: s["label"] == F.col("label")), lambda s: s["score"]))
    rest = F.round(own - F.col("weight"), 8)
    level = F.size(F.filter(others, lambda s: F.round(s["score"], 8) == F.round(most, 8)))
    tied = F.lit(1.0) - F.lit(1.0) / (level + 1)
    alone = most.isNull() & (rest <= 0)
    return F.when(alone, F.lit(None).cast("double")).when(most.isNull() | (rest > F.round(most, 8)), 0.0).when(rest < F.round(most, 8), 1.0).otherwise(tied)


def valid_votes(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """``article_id, field_name, annotator, label``: the vote of each annotator that counts.

    Per article, field and annotator (trimmed, ignoring case) the latest labelled_at counts, null
    being the earliest, then the larger vote_id; if its label has no accepted spelling in that
    field the annotator has no vote. Null articles, fields and annotators, blank ones too, have
    none either. Copies of rows count once.
    """
    rows = labels.select(*ITEM, fold_key(F.col("annotator")).alias("annotator"), fold_key(F.col("label")).alias("alias"), "labelled_at", "vote_id")
    rows = rows.where("article_id is not null and field_name is not null and annotator is not null and annotator <> ''")
    latest = rows.groupBy(*ITEM, "annotator").agg(F.max(F.struct("labelled_at", "vote_id", "alias")).alias("r"))
    accepted = aliases.select("field_name", fold_key(F.col("alias")).alias("alias"), F.col("canonical_label").alias("label"))
    accepted = accepted.groupBy("field_name", "alias").agg(F.min("label").alias("label"))
    voted = latest.select(*ITEM, "annotator", F.col("r.alias").alias("alias"))
    return voted.join(maybe_broadcast(accepted), ["field_name", "alias"]).select(*ITEM, "annotator", "label")


def discover(votes: DataFrame, max_rounds: int = MAX_ROUNDS, anchor: int | None = ANCHOR) -> Consensus:
    """Consensus of votes (article_id, field_name, annotator, label; one per annotator and item).

    The first round weighs all annotators alike. Items on which more than half of at least
    ``anchor`` votes agree are anchors: their label is that one in every round, so weights are
    learned from what is known and decide the open items; None anchors nothing. ``labels`` has
    score (summed weight), label_votes, item_votes, is_consensus and anchored of every label that
    an item got; of equal scores the smaller label wins.
    ``annotators`` has votes, judged (those on items that others labelled too), errors, weight
    (relative to the largest) and reliability, the share of judged votes that the others confirm. No votes give empty results.
    """
    votes = materialize(votes, "votes")
    sizes = votes.groupBy("annotator").agg(F.count("*").alias("votes"))
    weights = materialize(sizes.select("annotator", "votes", F.lit(0.0).alias("judged"), F.lit(0.0).alias("errors"), F.lit(1.0).alias("weight")), "annotators")
    previous, rounds = None, 0
    for rounds in range(1, max_rounds + 1):
        weighed = votes.join(maybe_broadcast(weights.select("annotator", "weight")), "annotator")
        scores = weighed.groupBy(*ITEM, "label").agg(F.round(F.sum("weight"), 9).alias("score"), F.count("*").alias("label_votes"))
        scores = materialize(scores, "label-scores")
        spread = scores.groupBy(*ITEM).agg(
            F.min_by("label", F.struct(-F.col("score"), "label")).alias("heaviest"),
            F.max_by("label", "label_votes").alias("named"),
            F.max("label_votes").alias("most"),
            F.sum("label_votes").alias("item_votes"),
            F.collect_list(F.struct("label", "score")).alias("spread"),
        )
        anchored = F.lit(False) if anchor is None else (F.col("item_votes") >= anchor) & (F.col("most") * 2 > F.col("item_votes"))
        spread = spread.withColumn("anchored", anchored).withColumn("truth", F.when(F.col("anchored"), F.col("named")).otherwise(F.col("heaviest")))
        truth = materialize(spread.drop("heaviest", "named", "most"), "truth")
        judged = weighed.join(truth, ITEM).select("annotator", distance_to_others().alias("d"))
        errors = judged.groupBy("annotator").agg(F.count("*").alias("votes"), F.count("d").cast("double").alias("judged"), F.coalesce(F.sum("d"), F.lit(0.0)).alias("errors"))
        raw = errors.withColumn("weight", chi2_low(F.greatest(F.col("judged"), F.lit(1.0))) / (F.col("errors") + PRIOR_ERROR))
        top = raw.agg(F.max("weight")).first()[0]
        weights = materialize(raw.withColumn("weight", F.round(F.col("weight") / F.lit(top or 1.0), 9)), "annotators")
        changed = None
        if previous is not None:
            pair = truth.join(previous[1].select(*ITEM, F.col("truth").alias("old")), ITEM)
            changed = pair.agg(F.avg((F.col("truth") != F.col("old")).cast("double"))).first()[0] or 0.0
            discard(previous[0])
            discard(previous[1])
        previous = (scores, truth)
        if changed is not None and changed <= SETTLED:
            break
    scores, truth = previous
    labels = scores.join(truth, ITEM).withColumn("is_consensus", F.col("label") == F.col("truth")).drop("truth", "spread")
    annotators = weights.withColumn("reliability", F.round(1 - F.try_divide("errors", "judged"), 6))
    return Consensus(labels, annotators, rounds)


def consensus_items(found: Consensus) -> DataFrame:
    """One row per item: consensus_label, votes, agreement (share of votes for it), confidence (share of weight), anchored."""
    totals = found.labels.groupBy(*ITEM).agg(F.sum("score").alias("total"))
    chosen = found.labels.where("is_consensus").join(totals, ITEM)
    return chosen.select(
        *ITEM,
        F.col("label").alias("consensus_label"),
        F.col("item_votes").alias("votes"),
        F.round(F.col("label_votes") / F.col("item_votes"), 6).alias("agreement"),
        F.round(F.col("score") / F.col("total"), 4).alias("confidence"),
        "anchored",
    )


def strict_consensus(labels: DataFrame, aliases: DataFrame, articles: DataFrame, least_votes: int = ANCHOR) -> DataFrame:
    """``article_id, field_name, consensus_label`` of items of known articles with a label of over half the votes.

    A filter of what the truth discovery finds: its consensus labels that more than half of at
    least ``least_votes`` votes name.
    """
    known = articles.select("article_id").where("article_id is not null").distinct()
    found = discover(valid_votes(labels, aliases).join(known, "article_id", "left_semi"), anchor=least_votes)
    sure = found.labels.where(F.col("is_consensus") & (F.col("item_votes") >= least_votes) & (F.col("label_votes") * 2 > F.col("item_votes")))
    return sure.select(*ITEM, F.col("label").alias("consensus_label"))
