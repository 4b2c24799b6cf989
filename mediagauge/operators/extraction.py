"""Signals of articles: pluggable extractors, normalisation of their answers, relevance, entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.functions.text import canonical_frame, collapse_space, fold_key
from mediagauge.functions.vector import softmax

#: An extractor takes articles (article_id, title, summary, body) and returns article_id, raw_json.
Extractor = Callable[[DataFrame], DataFrame]
ANSWER = "concern_level string, purchase_intent string, avoidance_signals string, dominant_frame string, " + ", ".join(f"seg_{s}_relevance string" for s in C.SEGMENTS)

# Words by which the built-in extractor recognises a signal or a frame, in Czech, German and English.
CUES = {
    "concern_level": "obav krize zdraz varuj nedostat problem sorge krise teuer warn mangel worry crisis dear warn shortage",
    "purchase_intent": "koup nakup slev cena kauf rabatt preis buy purchase discount price",
    "avoidance_signals": "odmit odklad bojkot omez ablehn verschieb boykott meid reject postpone boycott avoid",
}
FRAME_CUES = {
    "conflict": "spor kritiz stret streit kritisi konflikt dispute criticis conflict",
    "fear": "obav hrozb strach angst gefahr drohung fear threat danger",
    "opportunity": "prilezitost podpor rozvoj chance forder ausbau opportunity support growth",
}


def clamp(c: Column, low: float = 0.0, high: float = 1.0, default: float | None = None) -> Column:
    """A number within limits; what is no number, or NaN, is the default."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def cue_extractor(articles: DataFrame) -> DataFrame:
    """The deterministic default: shares of cue words in title, summary and body, as a JSON answer."""
    from mediagauge.functions.text import strip_marks

    text = strip_marks(F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("body", F.lit("")))))
    count = lambda words: F.regexp_count(F.col("t"), F.lit("(?U)\\b(" + "|".join(words.split()) + ")"))
    rows = articles.select("article_id", text.alias("t"))
    level = lambda words: F.least(F.lit(1.0), count(words) / F.lit(5.0))
    counts = {f: count(w) for f, w in FRAME_CUES.items()}
    most = F.greatest(*counts.values())
    frame = F.lit("neutral")
    for name in sorted(FRAME_CUES, reverse=True):
        frame = F.when((most > 0) & (counts[name] == most), name).otherwise(frame)
    answer = F.struct(*[F.round(level(w), 4).cast("string").alias(k) for k, w in CUES.items()], frame.alias("dominant_frame"), *[F.lit("0.25").alias(f"seg_{s}_relevance") for s in C.SEGMENTS])
    return rows.select("article_id", F.to_json(answer).alias("raw_json"))


def normalized_answers(answers: DataFrame, domain: str) -> DataFrame:
    """Answers (article_id, raw_json, affinity_tag) as signals with segment shares.

    The answer may be fenced or surrounded by words. In order: limits and defaults (0.5 concern,
    else 0, neutral, relevances 0.25), shares by softmax, 0.7 / 0.3 blend with the affinity's
    prior (unknown: mainstream), signals that the domain does not use set to 0.
    """
    parsed = answers.withColumn("a", F.from_json(F.nullif(F.regexp_extract("raw_json", r"(?s)\{.*\}", 0), F.lit("")), ANSWER))
    defaults = dict(zip(C.SIGNALS, (0.5, 0.0, 0.0), strict=True))
    used = C.DOMAIN_WEIGHTS[domain]
    values = [(clamp(F.col(f"a.{k}"), default=defaults[k]) if used[k] else F.lit(0.0)).alias(k) for k in C.SIGNALS]
    frame = canonical_frame(F.col("a.dominant_frame"), C.FRAME_ALIASES)
    known = F.when(frame.isin(*C.FRAMES), frame).otherwise("neutral")
    shares = softmax([clamp(F.col(f"a.seg_{s}_relevance"), default=0.25) for s in C.SEGMENTS])
    priors = F.create_map(*[x for a, v in C.AFFINITY_PRIORS.items() for x in (F.lit(a), F.array(*[F.lit(float(p)) for p in v]))])
    prior = F.coalesce(F.try_element_at(priors, F.coalesce("affinity_tag", F.lit("mainstream"))), F.array(*[F.lit(float(p)) for p in C.AFFINITY_PRIORS["mainstream"]]))
    blended = [F.round(0.7 * x + 0.3 * prior[i], 4).alias(f"seg_{s}") for i, (s, x) in enumerate(zip(C.SEGMENTS, shares, strict=True))]
    return parsed.select("article_id", *values, known.alias("frame"), *blended)


def extract_pending(articles: DataFrame, signals: DataFrame, domain: str, extractor: Extractor = cue_extractor) -> DataFrame:
    """Signals of the articles that have none yet."""
    pending = articles.join(signals.select("article_id").distinct(), "article_id", "left_anti")
    return normalized_answers(extractor(pending).withColumn("affinity_tag", F.lit(None).cast("string")), domain)


def relevance(terms: list[str], title: Column, text: Column, similarity: Column | None = None) -> Column:
    """Best relevance over topic terms: 1 in the title, 0.95 in the text, else the similarity within 0..1; 1 without terms."""
    wanted = [t.strip().lower() for t in dict.fromkeys(terms) if t and t.strip()]
    if not wanted:
        return F.lit(1.0)
    low_title, low_text = F.lower(F.coalesce(title, F.lit(""))), F.lower(collapse_space(F.concat_ws(" ", title, text)))
    soft = F.lit(0.0) if similarity is None else F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(similarity, F.lit(0.0)))), 4)
    scores = [F.when(low_title.contains(t), 1.0).when(low_text.contains(t), 0.95).otherwise(soft) for t in wanted]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def entities(text: Column, limit: int = 6) -> Column:
    """Runs of two to four capitalised words as ``text, norm``, each norm once, in order of occurrence."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,3}"), F.lit(0))
    return F.slice(F.array_distinct(F.transform(found, lambda e: F.lower(collapse_space(e)))), 1, limit)


def derived_links(articles: DataFrame, aliases: DataFrame) -> DataFrame:
    """Topic links from the articles' own topics: exact alias, else the article's canonical id; relevance 1."""
    from mediagauge.functions.text import normalize_topic

    keyed = articles.where("topic is not null").select("article_id", "topic", "language", "canonical_topic_id", normalize_topic(F.col("topic")).alias("alias_key"))
    known = aliases.groupBy("alias_key").agg(F.min_by("canonical_topic_id", "pos").alias("known"))
    return keyed.join(F.broadcast(known), "alias_key", "left").select("article_id", "topic", F.coalesce("known", "canonical_topic_id").alias("canonical_topic_id"), F.lit(1.0).alias("relevance"))


def numeric_claims(text: Column) -> Column:
    """Numbers within 32 characters after the name of a signal."""
    return F.regexp_extract_all(fold_key(text), F.lit(r"(?:concern|purchase|avoidance)[^0-9+-]{0,32}([+-]?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
