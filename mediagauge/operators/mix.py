"""Mix of outlets in two windows, per-outlet profiles and panels that balance the outlets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.functions.literal import literal_table
from mediagauge.operators.profiles import weighted_profiles


def outlet_counts(rows: DataFrame) -> DataFrame:
    """``outlet_lc, articles``: distinct articles of each outlet; blank outlets do not count."""
    return rows.where("outlet_lc is not null and outlet_lc <> ''").groupBy("outlet_lc").agg(F.countDistinct("article_id").alias("articles"))


def shares(counts: DataFrame, value: str = "articles") -> DataFrame:
    """Counts with their share of the total, six decimals; zero and negative counts have none."""
    positive = counts.where(F.col(value) > 0)
    return positive.withColumn("share", F.round(F.col(value) / F.sum(value).over(Window.partitionBy()), 6))


def divergence(now: DataFrame, before: DataFrame, key: str = "outlet_lc") -> DataFrame:
    """One row: Jensen-Shannon divergence in bits of two share tables, null if either is empty."""
    both = now.select(key, F.col("share").alias("p")).join(before.select(key, F.col("share").alias("q")), key, "full").na.fill(0.0, ["p", "q"])
    m = (F.col("p") + F.col("q")) / 2

    def part(x: str) -> Column:
        return F.sum(F.when((F.col(x) > 0) & (m > 0), F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0))

    raw = both.agg((0.5 * part("p") + 0.5 * part("q")).alias("d"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    bounded = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("d"))), 4)
    return raw.select(F.when((F.col("p") > 0) & (F.col("q") > 0), bounded).alias("divergence"))


def mix_report(now: DataFrame, before: DataFrame) -> DataFrame:
    """Totals of both windows, divergence and the first warning that applies."""
    a, b = outlet_counts(now), outlet_counts(before)
    totals = a.agg(F.coalesce(F.sum("articles"), F.lit(0)).alias("current_total")).crossJoin(b.agg(F.coalesce(F.sum("articles"), F.lit(0)).alias("reference_total")))
    row = totals.crossJoin(divergence(shares(a), shares(b)))
    warning = (
        F.when(F.col("current_total") == 0, "no_current_articles")
        .when(F.col("reference_total") == 0, "no_reference_window")
        .when((F.col("current_total") < C.MIX_LOW_SAMPLE) | (F.col("reference_total") < C.MIX_LOW_SAMPLE), "low_sample")
        .when(F.col("divergence") >= C.MIX_SHIFT, "outlet_mix_shift")
        .otherwise("none")
    )
    return row.withColumn("warning", warning)


def outlet_profiles(signals: DataFrame) -> DataFrame:
    """Weighted profile of every outlet and segment."""
    return weighted_profiles(signals.where("outlet_lc is not null and outlet_lc <> ''"), ["outlet_lc"])


def panel_profile(profiles: DataFrame, panel: list[str]) -> DataFrame:
    """Per segment: the mean over the panel's outlets that have a profile, each counting alike.

    ``observed`` and ``missing`` list outlets in panel order; the frame that most outlets have
    dominates, of equally many the first by name.
    """
    spark = profiles.sparkSession
    order = F.broadcast(literal_table(spark, [(o.lower(), i) for i, o in enumerate(panel)], "outlet_lc string, pos int"))
    joined = profiles.join(order, "outlet_lc")
    means = [F.round(F.avg(k), 4).alias(k) for k in C.SIGNALS]
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "outlet_lc"))), lambda s: s["outlet_lc"])
    values = joined.groupBy("segment").agg(*means, F.sum("article_count").alias("article_count"), names.alias("observed"))
    votes = joined.groupBy("segment", "dominant_frame").agg(F.count("*").alias("n"))
    frames = votes.groupBy("segment").agg(F.min_by("dominant_frame", F.struct(-F.col("n"), "dominant_frame")).alias("dominant_frame"))
    everyone = F.array(*[F.lit(o.lower()) for o in panel])
    return values.join(frames, "segment").withColumn("missing", F.array_except(everyone, "observed"))


def normalized_drift(raw: DataFrame, balanced: DataFrame) -> DataFrame:
    """Drift with and without the outlet mix: effect, and what the difference means, per segment.

    Both inputs have segment and drift_magnitude; the balanced one also ``missing``.
    """
    b = balanced.select("segment", F.col("drift_magnitude").alias("balanced_magnitude"), "missing")
    joined = raw.select("segment", F.col("drift_magnitude").alias("raw_magnitude")).join(b, "segment", "left")
    effect = F.round(F.col("raw_magnitude") - F.col("balanced_magnitude"), 4)
    status = F.when(F.col("balanced_magnitude").isNull(), "no_panel_overlap").when(F.size("missing") > 0, "partial_panel").otherwise("ready")
    meaning = (
        F.when(F.col("source_mix_effect") >= C.EFFECT_MARGIN, "raw_drift_partly_source_mix")
        .when(F.col("source_mix_effect") <= -C.EFFECT_MARGIN, "source_mix_hides_drift")
        .when(F.col("source_mix_effect").isNotNull(), "stable_under_panel")
    )
    return joined.withColumn("source_mix_effect", effect).withColumn("panel_status", status).withColumn("interpretation", meaning).drop("missing")
