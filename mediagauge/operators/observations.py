"""Cluster signals, observations against tracks, and their rollup to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.functions.text import collapse_space
from mediagauge.functions.vector import cosine_distance
from mediagauge.operators.profiles import alert_level

KEY = ["run_id", "cluster_id"]
SEG = [f"seg_{s}" for s in C.SEGMENTS]
#: Added before rounding, so that exact halves go up whatever their last bit is.
TIE = 1e-9


def clean_label(c: Column, words: int = 8, chars: int = 80) -> Column:
    """A topic label of few words; null if nothing is left."""
    parts = F.filter(F.split(collapse_space(c), " "), lambda w: w != "")
    label = F.trim(F.substring(F.array_join(F.slice(parts, 1, words), " "), 1, chars))
    return F.when(label != "", label)


def normalize_label(c: Column) -> Column:
    """Letters and digits in lower case, everything else one blank."""
    return collapse_space(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", " ")))


def label_penalty(a: Column, b: Column) -> Column:
    """0 for equal labels, 0.25 if one contains the other, else the Jaccard distance of their words; 1 if one is empty."""
    x, y = normalize_label(a), normalize_label(b)
    xs, ys = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    distance = F.round(1.0 - F.size(F.array_intersect(xs, ys)) / F.size(F.array_union(xs, ys)), 4)
    return F.when((x == "") | (y == ""), 1.0).when(x == y, 0.0).when(x.contains(y) | y.contains(x), 0.25).otherwise(distance)


def signal_vector(prefix: str, domain: str) -> Column:
    """Signals weighted by the domain."""
    return F.array(*[F.coalesce(F.col(f"{prefix}{k}"), F.lit(0.0)) * F.lit(C.DOMAIN_WEIGHTS[domain][k]) for k in C.SIGNALS])


def pair_metrics(pairs: DataFrame, domain: str) -> DataFrame:
    """``signal_distance, label_penalty, cost`` of cluster and track pairs; cost is null beyond the gate.

    Pairs have distance, label, the signals, and those of the track with the prefix ``base_``.
    """
    a, b, c = C.MATCH_WEIGHTS
    out = pairs.withColumn("signal_distance", cosine_distance(signal_vector("", domain), signal_vector("base_", domain)))
    out = out.withColumn("label_penalty", label_penalty(F.col("label"), F.col("base_label")))
    cost = F.round(a * F.col("distance") + b * F.col("signal_distance") + c * F.col("label_penalty"), 4)
    return out.withColumn("cost", F.when(F.col("distance") <= C.MATCH_GATE, cost))


def cluster_signals(members: DataFrame, signals: DataFrame, articles: DataFrame) -> DataFrame:
    """Signals, segment shares, frame and label of every cluster from the latest signal of each member.

    The deterministic stand-in for a language model: means over member articles (4 decimals), the
    most frequent frame (first by name), the title of the strongest member. Members without a
    signal count for member_count only; a cluster without any has nulls and frame neutral.
    """
    fields = ["extracted_at", "signal_id", *C.SIGNALS, *SEG, "frame"]
    latest = signals.where("article_id is not null").groupBy("article_id").agg(F.max(F.struct(*fields)).alias("s")).select("article_id", "s.*")
    one = members.groupBy(*KEY, "article_id").agg(F.max("strength").alias("strength"))
    joined = one.join(latest, "article_id", "left").join(articles.select("article_id", "title"), "article_id", "left")
    clean = lambda k: F.when(~F.isnan(k), F.col(k))
    base = joined.groupBy(*KEY).agg(
        F.count("*").alias("member_count"),
        F.round(F.avg("strength"), 6).alias("mean_strength"),
        *[F.round(F.avg(clean(k)) + TIE, 4).alias(k) for k in [*C.SIGNALS, *SEG]],
        F.max_by("title", F.struct(F.coalesce("strength", F.lit(-1.0)), "article_id")).alias("title"),
    )
    votes = joined.where("frame is not null").groupBy(*KEY, "frame").agg(F.count("*").alias("n"))
    frames = votes.groupBy(*KEY).agg(F.min_by("frame", F.struct(-F.col("n"), "frame")).alias("frame"))
    out = base.join(frames, KEY, "left")
    return out.withColumn("frame", F.coalesce("frame", F.lit("neutral"))).withColumn("label", clean_label(F.col("title"))).drop("title")


def observation_confidence(members: Column, strength: Column, samples: Column, learned: Column) -> Column:
    """Half coverage and strength of the cluster, half quality of the track."""
    coverage = F.least(F.lit(1.0), members / F.lit(float(C.CONFIDENCE_SCALE)))
    quality = (coverage + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(strength, F.lit(0.0))))) / 2
    base = F.when(learned, F.least(F.lit(1.0), samples / F.lit(float(C.CONFIDENCE_SCALE)) + C.UNLEARNED_QUALITY)).otherwise(C.UNLEARNED_QUALITY)
    return F.round(C.CONFIDENCE_WEIGHTS[0] * quality + C.CONFIDENCE_WEIGHTS[1] * base, 4)


def direction(match_type: Column, deltas: list[Column], frame_shift: Column) -> Column:
    """emerging, fading, rising, falling, mixed or stable, from weighted deltas."""
    total, moved = F.lit(0.0), F.lit(False)
    for d in deltas:
        total, moved = total + d, moved | (F.abs(d) >= C.MIXED_STEP)
    return (
        F.when(match_type == "new", "emerging").when(match_type == "missing", "fading").when(total >= C.RISING, "rising").when(total <= -C.RISING, "falling").when(frame_shift | moved, "mixed").otherwise("stable")
    )


def observations(current: DataFrame, tracks: DataFrame, matches: DataFrame, domain: str) -> DataFrame:
    """One row per matched, new or missing story.

    ``current``: cluster_id and cluster signals; ``tracks``: track_id, the same columns, and
    sample_count and is_learned of the track (its members and whether these suffice, if absent);
    ``matches``: cluster_id, track_id, distance. A matched one has deltas, 0.7 signal drift + 0.3
    centroid distance as magnitude; a new or missing one has no deltas and magnitude 0.
    """
    columns = ["member_count", "mean_strength", *C.SIGNALS, *SEG, "frame", "label"]
    now = current.select("cluster_id", *columns)
    samples = F.col("sample_count") if "sample_count" in tracks.columns else F.col("member_count")
    learned = F.col("is_learned") if "is_learned" in tracks.columns else samples >= C.MIN_BASELINE_ARTICLES
    then = tracks.select("track_id", samples.alias("base_samples"), learned.alias("base_learned"), *[F.col(c).alias(f"base_{c}") for c in columns])
    matched = matches.select("cluster_id", "track_id", "distance")
    rows = now.join(matched, "cluster_id", "full").join(then, "track_id", "full")
    kind = F.when(F.col("cluster_id").isNull(), "missing").when(F.col("track_id").isNull(), "new").otherwise("matched")
    rows = rows.withColumn("match_type", kind)
    both = F.col("match_type") == "matched"
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = rows.withColumns({f"delta_{k}": F.when(both, F.round(value(k) - value(f"base_{k}"), 4)).otherwise(0.0) for k in C.SIGNALS})
    weighted = [F.lit(C.DOMAIN_WEIGHTS[domain][k]) * F.col(f"delta_{k}") for k in C.SIGNALS]
    drift = F.lit(0.0)
    for d in weighted:
        drift = drift + F.abs(d)
    rows = rows.withColumn("signal_drift", F.round(drift, 4))
    rows = rows.withColumn("drift_magnitude", F.when(both, F.round(0.7 * F.col("signal_drift") + 0.3 * F.col("distance"), 4)).otherwise(0.0))
    shift = both & (F.col("frame") != F.col("base_frame"))
    conf = observation_confidence(F.coalesce("member_count", "base_member_count"), F.coalesce("mean_strength", "base_mean_strength"), F.coalesce("base_samples", F.lit(0)), F.coalesce("base_learned", F.lit(False)))
    return rows.withColumns({"frame_shift": F.coalesce(shift, F.lit(False)), "confidence": conf}).withColumn("direction", direction(F.col("match_type"), weighted, F.col("frame_shift")))


def segment_rollup(obs: DataFrame) -> DataFrame:
    """Observations per segment: weighted signals now and before, drift, story counts, direction.

    A story weighs its members times its share of the segment. Now: matched and new ones; before:
    matched and missing ones; magnitude: matched ones. New or missing stories of at least half of
    the weight make the segment emerging or fading.
    """
    parts = F.array(*[F.struct(F.lit(s).alias("segment"), F.coalesce(f"seg_{s}", F.lit(0.0)).alias("share"), F.coalesce(f"base_seg_{s}", F.lit(0.0)).alias("base_share")) for s in C.SEGMENTS])
    long = obs.withColumn("p", F.explode(parts)).withColumn("w", F.coalesce("member_count", F.lit(0)) * F.col("p.share")).withColumn("b", F.coalesce("base_member_count", F.lit(0)) * F.col("p.base_share"))
    t = F.col("match_type")
    here = t.isin("matched", "new") & (F.col("w") > 0)
    there = t.isin("matched", "missing") & (F.col("b") > 0)
    pair = F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("b"))
    mean = lambda v, test, w: F.round(F.try_divide(F.sum(F.when(test, v * w)), F.sum(F.when(test, w))), 4)
    rolled = long.groupBy("p.segment").agg(
        *[mean(F.coalesce(F.col(k), F.lit(0.0)), here, F.col("w")).alias(k) for k in C.SIGNALS],
        *[mean(F.coalesce(F.col(f"base_{k}"), F.lit(0.0)), there, F.col("b")).alias(f"base_{k}") for k in C.SIGNALS],
        mean(F.col("drift_magnitude"), (t == "matched") & (pair > 0), pair).alias("drift_magnitude"),
        F.coalesce(F.sum(F.when(here, F.col("member_count"))), F.lit(0)).alias("article_count"),
        F.sum((t == "matched").cast("bigint")).alias("matched"),
        F.sum(((t == "new") & here).cast("bigint")).alias("new"),
        F.sum(((t == "missing") & there).cast("bigint")).alias("missing"),
        F.coalesce(F.sum(F.when(here, F.col("w"))), F.lit(0.0)).alias("now_weight"),
        F.coalesce(F.sum(F.when((t == "new") & here, F.col("w"))), F.lit(0.0)).alias("new_sum"),
        F.coalesce(F.sum(F.when((t == "missing") & there, F.col("b"))), F.lit(0.0)).alias("missing_sum"),
    )
    rolled = rolled.withColumn("new_weight", F.round(F.coalesce(F.try_divide("new_sum", "now_weight"), F.lit(0.0)), 4))
    rolled = rolled.withColumn("missing_weight", F.round(F.coalesce(F.try_divide("missing_sum", F.col("now_weight") + F.col("missing_sum")), F.lit(0.0)), 4))
    rolled = rolled.withColumn("drift_magnitude", F.coalesce("drift_magnitude", F.lit(0.0)))
    way = F.when(F.col("new_weight") >= 0.5, "emerging").when(F.col("missing_weight") >= 0.5, "fading").otherwise("tracked")
    has = (F.col("now_weight") + F.col("missing_sum")) > 0
    out = rolled.withColumn("direction", way).withColumn("alert_level", alert_level(F.col("drift_magnitude"), has))
    return out.drop("now_weight", "new_sum", "missing_sum")


def select_observations(obs: DataFrame, count: int = 4, fading: bool = False) -> DataFrame:
    """The ``count`` strongest matched or new stories; if the top segment fades, the last gives way to the strongest missing one."""
    from pyspark.sql import Window

    order = [F.desc("drift_magnitude"), F.desc("confidence"), F.desc(F.coalesce("member_count", F.lit(0))), F.coalesce("track_id", "cluster_id")]
    group = (F.col("match_type") == "missing").cast("int")
    ranked = obs.withColumn("gone", group).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    live = count - 1 if fading else count
    return ranked.where(((F.col("gone") == 0) & (F.col("rank") <= live)) | (F.lit(fading) & (F.col("gone") == 1) & (F.col("rank") == 1))).drop("gone")
