"""Deterministic research briefs from ranked segments, and checks of given briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.operators.ranking import confidence_words, drift_type, rank_segments

#: How far a claimed change may be from the measured one.
DELTA_TOLERANCE = 0.05


def brief(drift: DataFrame, topic: str) -> DataFrame:
    """One row: status, most affected segment, drift type, magnitude, three hypothesis segments, confidence in words.

    Status is ready if a segment is ready, insufficient_data if none has data, else warming.
    """
    ranked = rank_segments(drift).withColumn("drift_type", drift_type())
    top = F.min_by(F.struct("segment", "drift_type", "drift_magnitude", "confidence", "alert_level"), "rank")
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", "segment"))), lambda s: s["segment"])
    rolled = ranked.agg(
        top.alias("t"), F.array_join(F.slice(names, 1, 3), ",").alias("hypothesis_segments"), F.max((F.col("status") == "ready").cast("int")).alias("ready"),
        F.max((F.col("article_count") > 0).cast("int")).alias("data"), F.max("confidence").alias("best"), F.sum("article_count").alias("articles"),
    )
    status = F.when(F.col("ready") == 1, "ready").when(F.col("data") == 0, "insufficient_data").otherwise("warming")
    return rolled.select(
        F.lit(topic).alias("topic"), status.alias("status"), F.col("t.segment").alias("most_affected_segment"), F.col("t.drift_type").alias("drift_type"),
        F.col("t.drift_magnitude").alias("drift_magnitude"), F.col("t.alert_level").alias("alert_level"), "hypothesis_segments",
        confidence_words(F.col("t.confidence")).alias("confidence_label"), (F.col("best") < C.READY_CONFIDENCE).alias("low_confidence_warning"), "articles",
    )


def brief_issues(briefs: DataFrame, drift: DataFrame, selected: DataFrame) -> DataFrame:
    """``brief_id, code`` of what is wrong with briefs.

    ``briefs``: brief_id, status, most_affected_segment, alert_level, cited_articles (array),
    hypotheses (array of segment, signal, delta). ``selected``: article_id of the evidence; if it
    is empty, citations are not checked.
    """
    ranked = rank_segments(drift)
    facts = ranked.agg(
        F.min_by("segment", "rank").alias("top"), F.min_by("alert_level", "rank").alias("top_alert"), F.sum("article_count").alias("articles"),
        F.max((F.col("status") == "ready").cast("int")).alias("ready"), F.collect_set(F.when(F.col("article_count") > 0, F.col("segment"))).alias("with_data"),
    )
    chosen = selected.agg(F.collect_set("article_id").alias("chosen"))
    # Both are single rows.
    rows = briefs.crossJoin(F.broadcast(facts)).crossJoin(F.broadcast(chosen))
    missing = F.filter("hypotheses", lambda h: ~F.array_contains(F.col("with_data"), h["segment"]))
    checks = {
        "cited_article_not_selected": (F.size("chosen") > 0) & (F.size(F.array_except(F.coalesce("cited_articles", F.array().cast("array<string>")), "chosen")) > 0),
        "insufficient_data_with_articles": (F.col("status") == "insufficient_data") & (F.col("articles") > 0),
        "ready_without_ready_segment": (F.col("status") == "ready") & (F.col("ready") == 0),
        "most_affected_segment_not_top_ranked": F.col("most_affected_segment") != F.col("top"),
        "alert_level_differs_from_top_segment": F.col("alert_level") != F.col("top_alert"),
        "hypothesis_segment_missing_from_evidence": F.size(missing) > 0,
    }
    codes = F.filter(F.array(*[F.when(test, code) for code, test in checks.items()]), lambda c: c.isNotNull())
    general = rows.select("brief_id", F.explode(codes).alias("code"))
    deltas = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), F.col(f"delta_{k}").alias("measured")) for k in C.SIGNALS]))
    measured = drift.select("segment", deltas.alias("d")).select("segment", "d.*")
    claims = briefs.select("brief_id", F.explode("hypotheses").alias("h")).select("brief_id", "h.*")
    off = claims.join(F.broadcast(measured), ["segment", "signal"]).where(F.abs(F.col("delta") - F.coalesce("measured", F.lit(0.0))) > DELTA_TOLERANCE)
    return general.union(off.select("brief_id", F.lit("hypothesis_delta_mismatch").alias("code")).distinct())
