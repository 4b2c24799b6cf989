"""Text functions against plain Python."""

from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.functions import text as T
from mediagauge.functions import vector as V
from mediagauge.operators import latest

TEXTS = ["Ceny  energií", "Žluťoučký_kůň-2", "  ", "", "A b\tc", "N̊orm", "e-mail", "İstanbul Straße", "x" * 10_000, None]


def on(spark, expr, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(expr(F.col("v"))).collect()]


def test_topic_forms(spark):
    def plain(x):
        if x is None:
            return None
        x = "".join(c for c in unicodedata.normalize("NFKD", x.strip().lower()) if not unicodedata.combining(c))
        return " ".join(re.sub(r"[^\w\s]", " ", re.sub(r"[_\-]+", " ", x)).split())

    assert on(spark, T.normalize_topic, TEXTS) == [plain(x) for x in TEXTS]
    assert on(spark, T.slugify, ["Ceny energií!", "", "???", None]) == ["ceny-energii", "topic", "topic", None]
    assert on(spark, T.display_name, ["ceny-energií", " ", "éclair"]) == ["Ceny energií", "Topic", "Éclair"]


def test_titles(spark):
    assert on(spark, T.title_key, ["Krátký", "Most je OTEVŘEN!", "dvanactznaku", None, ""]) == [None, "most je otevřen", None, None, None]
    assert on(spark, lambda c: T.clip_words(c, 12), ["short", "some longer words here", "x" * 40, None]) == ["short", "some longer...", "x" * 12 + "...", None]


def test_embedding_text(spark):
    df = spark.createDataFrame(
        [("T", "Short. This sentence is long enough. Subscribe to our weekly newsletter now. Another sentence that counts too. A third sentence that is left out.", None), ("Title here", None, "A summary sentence that is long."), ("T", " ", ""), (None, None, None)],
        "t string, b string, s string",
    )
    got = [r[0] for r in df.select(T.embedding_text(F.col("t"), F.col("b"), F.col("s"), C.BOILERPLATE)).collect()]
    assert got == ["T - This sentence is long enough. Another sentence that counts too.", "Title here - A summary sentence that is long.", None, None]


@pytest.mark.parametrize(("raw", "frame"), [("Risk", "fear"), ("human-interest", "human_interest"), (None, "neutral"), ("", "neutral"), (" Debate ", "conflict")])
def test_frames(spark, raw, frame):
    assert on(spark, lambda c: T.canonical_frame(c, C.FRAME_ALIASES), [raw]) == [frame]


def test_urls_and_domains(spark):
    assert on(spark, T.normalize_url, ["HTTPS://Www.X.example/A/b/?q=1", "not a url", None]) == ["www.x.example/A/b?q=1", None, None]
    assert on(spark, lambda c: T.keyword_domain(c, C.DOMAIN_KEYWORDS, "generic"), ["Ceny benzin", "volby 2025", "covid", "sport", None]) == ["commerce", "civic", "health", "generic", "generic"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(F.round(V.cosine(F.col("a"), F.col("b")), 6)).collect()] == [0.96, 0.0, 0.0]
    assert [r[0] for r in df.select(V.cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.04, 1.0, 1.0]
    assert df.select(V.unit(F.col("a"))).first()[0] == [0.6, 0.8]
    shares = spark.range(1).select(*V.softmax([F.lit(0.25)] * 4)).first()
    assert tuple(shares) == (0.25,) * 4


def test_topics_resolve_by_language(spark):
    aliases = latest.alias_table(spark)
    raw = spark.createDataFrame([("Inflace", "cs"), ("inflation", "de"), ("POLITIK", None), ("Neue Sache", "de"), (None, "cs")], "topic string, language string")
    got = {r["topic"]: (r["canonical"], r["known"]) for r in latest.resolve_topics(raw, aliases).collect()}
    assert got == {"Inflace": ("inflation", True), "inflation": ("inflation", True), "POLITIK": ("politics", True), "Neue Sache": ("neue-sache", False)}


def test_latest_rows_and_order(spark):
    e = spark.createDataFrame([(1, "a", "complete", "2025-01-01", "v"), (2, "a", "failed", "2025-01-02", "v"), (3, "a", "complete", None, "v"), (4, None, "complete", None, "v")], "embedding_id long, article_id string, status string, t string, model_version string").withColumn("embedded_at", F.col("t").cast("timestamp"))
    assert latest.latest_embedding(e, True).first()["embedding_id"] == 1
    assert latest.latest_embedding(e, False).first()["embedding_id"] == 2
    assert [(r["pos"], r["embedding_id"]) for r in latest.in_given_order(e, "embedding_id", [3, 1, 3, 9]).orderBy("pos").collect()] == [(0, 3), (1, 1), (2, 3)]
    a = spark.createDataFrame([("CZ", None, 1), ("CZ", "cs", 2)], "country string, language string, x int")
    assert latest.null_safe_scope(a, a, ["country", "language"]).count() == 2


@pytest.mark.parametrize(("raw", "name"), [("Young-Urban Adults (18-30)", "young_urban"), ("Families", "family"), ("others!", "others"), (None, "")])
def test_segment_names(spark, raw, name):
    assert on(spark, lambda c: T.canonical_segment(c, C.SEGMENT_ALIASES), [raw]) == [name]


@pytest.mark.parametrize(("raw", "name"), [("Concern", "concern_spike"), ("odd | Purchase Surge / mixed", "purchase_surge"), ("odd", "odd"), (None, "")])
def test_drift_types(spark, raw, name):
    assert on(spark, lambda c: T.canonical_drift_type(c, C.DRIFT_TYPE_ALIASES), [raw]) == [name]
