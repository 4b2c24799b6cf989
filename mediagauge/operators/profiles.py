"""Audience-segment profiles: weighted signals and frames, baselines, drift, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.functions.literal import literal_table


def unpivot_segments(signals: DataFrame, keep: list[str]) -> DataFrame:
    """One row per signal and segment with a positive weight: ``keep``, the signals, frame, segment, weight."""
    pairs = F.array(*[F.struct(F.lit(s).alias("segment"), F.col(f"seg_{s}").alias("weight")) for s in C.SEGMENTS])
    rows = signals.select(*keep, *[F.coalesce(F.nanvl(F.col(k), F.lit(0.0)), F.lit(0.0)).alias(k) for k in C.SIGNALS], "frame", F.explode(pairs).alias("p"))
    return rows.select(*keep, *C.SIGNALS, "frame", "p.segment", "p.weight").where("weight > 0 and not isnan(weight)")


def _segment_dim(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(enumerate(C.SEGMENTS)), "pos int, segment string")


def weighted_profiles(signals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per ``keys`` and segment: weighted mean of each signal (4 decimals), articles, dominant frame.

    The frame with the largest summed weight dominates, of equal ones the first by name. Signals
    that are null or NaN count as 0, weights that are not positive do not count.
    """
    keys = [*(keys or []), "segment"]
    rows = unpivot_segments(signals, [k for k in keys if k != "segment"] + ["article_id"])
    sums = [F.sum(F.col(k) * F.col("weight")).alias(k) for k in C.SIGNALS]
    parts = rows.groupBy(*keys, "frame").agg(*sums, F.sum("weight").alias("w"), F.count("*").alias("n"))
    means = [F.round(F.sum(k) / F.sum("w"), 4).alias(k) for k in C.SIGNALS]
    frame = F.min_by("frame", F.struct(-F.round("w", 9), "frame")).alias("dominant_frame")
    return parts.groupBy(*keys).agg(*means, F.sum("n").alias("article_count"), frame)


def segment_profile(signals: DataFrame) -> DataFrame:
    """All segments in their order; one without signals has zeros and a neutral frame."""
    dim = F.broadcast(_segment_dim(signals.sparkSession))
    joined = dim.join(weighted_profiles(signals), "segment", "left")
    zero = {k: F.coalesce(k, F.lit(0.0)) for k in C.SIGNALS}
    filled = joined.withColumns(zero | {"article_count": F.coalesce("article_count", F.lit(0)), "dominant_frame": F.coalesce("dominant_frame", F.lit("neutral"))})
    return filled.select("segment", *C.SIGNALS, "article_count", "dominant_frame")


def seed_baselines(spark: SparkSession, topics: list[str] | None = None) -> DataFrame:
    """Prior of every topic and segment, as if never learned."""
    rows = [(t, s, *v, 0, False) for t in (topics or C.SEED_TOPICS) for s, v in C.SEED_PRIORS.items()]
    return literal_table(spark, rows, "topic string, segment string, concern_level double, purchase_intent double, avoidance_signals double, dominant_frame string, sample_count int, is_learned boolean")


def confidence(articles: Column, samples: Column, learned: Column) -> Column:
    """Half coverage of the current window, half quality of the baseline, four decimals."""
    a, b = C.CONFIDENCE_WEIGHTS
    coverage = F.least(F.lit(1.0), articles / F.lit(float(C.CONFIDENCE_SCALE)))
    quality = F.when(learned, F.least(F.lit(1.0), samples / F.lit(float(C.CONFIDENCE_SCALE)) + C.UNLEARNED_QUALITY)).otherwise(F.lit(C.UNLEARNED_QUALITY))
    return F.round(a * coverage + b * quality, 4)


def alert_level(magnitude: Column, has_data: Column) -> Column:
    """no_data, none, mild or strong."""
    return F.when(~has_data, "no_data").when(magnitude >= C.STRONG_ALERT, "strong").when(magnitude >= C.MILD_ALERT, "mild").otherwise("none")


def segment_status(articles: Column, learned: Column, conf: Column) -> Column:
    """no_data, ready or warming."""
    return F.when(articles == 0, "no_data").when(learned & (conf >= C.READY_CONFIDENCE), "ready").otherwise("warming")


def drift_from(profile: DataFrame, baseline: DataFrame, domain: str) -> DataFrame:
    """Deltas, magnitude, alert, frame shift, confidence and status of profiles against baselines by segment.

    Without a baseline deltas are null and the magnitude is 0; without articles the magnitude is 0.
    """
    b = baseline.select("segment", *[F.col(k).alias(f"base_{k}") for k in C.SIGNALS], F.col("dominant_frame").alias("baseline_frame"), "sample_count", "is_learned")
    joined = profile.join(b, "segment", "left")
    has_data = F.col("article_count") > 0
    deltas = {f"delta_{k}": F.when(has_data, F.round(F.col(k) - F.col(f"base_{k}"), 4)) for k in C.SIGNALS}
    weights = C.DOMAIN_WEIGHTS[domain]
    joined = joined.withColumns(deltas)
    total = F.lit(0.0)
    for k in C.SIGNALS:
        total = total + F.lit(weights[k]) * F.abs(F.coalesce(f"delta_{k}", F.lit(0.0)))
    joined = joined.withColumn("drift_magnitude", F.round(total, 4))
    learned = F.coalesce("is_learned", F.lit(False))
    joined = joined.withColumn("confidence", confidence(F.col("article_count"), F.coalesce("sample_count", F.lit(0)), learned))
    shift = has_data & F.col("baseline_frame").isNotNull() & (F.col("dominant_frame") != F.col("baseline_frame"))
    out = joined.withColumns({"frame_shift": shift, "alert_level": alert_level(F.col("drift_magnitude"), has_data), "status": segment_status(F.col("article_count"), learned, F.col("confidence"))})
    return out.select(
        "segment", "article_count", *C.SIGNALS, *deltas, "drift_magnitude", "frame_shift", "alert_level", "dominant_frame", "baseline_frame", "confidence", "status"
    )


def choose_baseline(baselines: DataFrame, keys: list[str]) -> DataFrame:
    """Of several baselines: learned before seeded, then most samples, then latest, then topic by name."""
    w = Window.partitionBy(*keys).orderBy(F.desc("is_learned"), F.desc("sample_count"), F.col("updated_at").desc_nulls_last(), "topic")
    return baselines.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def ema_fold(updates: DataFrame, keys: list[str], start: dict[str, float], ts: str) -> DataFrame:
    """Baselines after all updates in time order: 0.8 old + 0.2 new, rounded at every step.

    Only updates with enough articles count; each adds one to sample_count, the last frame stays.
    The updates of one key are bounded by the number of profile snapshots, not of articles.
    """
    fields = [F.col(ts).alias("ts"), *C.SIGNALS, "dominant_frame"]
    steps = updates.where(F.col("article_count") >= C.MIN_BASELINE_ARTICLES).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("steps"))
    zero = F.struct(*[F.lit(float(start[k])).alias(k) for k in C.SIGNALS], F.lit("neutral").alias("dominant_frame"), F.lit(0).alias("sample_count"))

    def step(state: Column, new: Column) -> Column:
        blended = [F.round(C.EMA_OLD * state[k] + C.EMA_NEW * new[k], 4).alias(k) for k in C.SIGNALS]
        return F.struct(*blended, new["dominant_frame"].alias("dominant_frame"), (state["sample_count"] + 1).alias("sample_count"))

    folded = steps.select(*keys, F.aggregate("steps", zero, step).alias("s"))
    return folded.select(*keys, "s.*", (F.col("s.sample_count") >= C.MIN_BASELINE_ARTICLES).alias("is_learned"))


def history(signals: DataFrame, ts: str, baseline: DataFrame, domain: str) -> DataFrame:
    """Per segment and day: mean signals of the day's profiles and their drift from the baseline."""
    daily = weighted_profiles(signals.withColumn("day", F.to_date(ts)), ["day"])
    b = F.broadcast(baseline.select("segment", *[F.col(k).alias(f"base_{k}") for k in C.SIGNALS]))
    total = F.lit(0.0)
    for k in C.SIGNALS:
        total = total + F.lit(C.DOMAIN_WEIGHTS[domain][k]) * F.abs(F.round(F.col(k) - F.col(f"base_{k}"), 4))
    return daily.join(b, "segment").select("segment", "day", *C.SIGNALS, "article_count", F.round(total, 4).alias("drift_magnitude"))
