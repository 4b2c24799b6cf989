"""Readers, writers and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.sources import scans, sinks
from mediagauge.streaming import profiles as SP

RSS = """<rss><channel><title>x</title><item><title>One</title><link>https://X.example/a/</link><description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>Two</title></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>At</title><link href="https://y.example/b?c=1"/><summary>s</summary><updated>2024-01-01T10:00:00Z</updated></entry></feed>"""


def test_feeds(spark):
    raw = spark.createDataFrame([("o", RSS), ("p", ATOM), ("bad", "<rss><item>"), ("none", None), ("evil", "<!DOCTYPE x [<!ENTITY a 'b'>]><rss/>")], "outlet string, xml string")
    rows = scans.with_article_id(scans.read_feeds(raw)).collect()
    assert [(r["outlet"], r["title"], r["canonical_url"]) for r in rows if r["ok"]] == [("o", "One", "x.example/a"), ("o", "Two", None), ("p", "At", "y.example/b?c=1")]
    assert {r["outlet"] for r in rows if not r["ok"]} == {"bad", "none", "evil"}
    assert rows[0]["published_at"].startswith("Mon") and len(rows[0]["article_id"]) == 64


def test_pages(spark):
    html = "<html><p class='x'>One &amp; <b>two</b>\n three</p><p></p><P>Four</P></html>"
    assert spark.createDataFrame([(html,), ("none",), (None,)], "h string").select(scans.page_text(F.col("h"))).collect() == [("One two three Four",), ("",), (None,)]


def test_catalog(spark):
    records = [{"outlet": "a", "rss_url": "https://A.example/rss/"}, {"outlet": "a", "rss_url": "https://z.example"}, {"outlet": "b", "rss_url": "https://a.example/rss", "enabled": "no"}, {"outlet": "c", "rss_url": "https://c.example", "country": "cz"}]
    feeds = scans.feed_catalog(spark, records)
    assert [r["outlet"] for r in feeds.collect()] == ["a", "c"]
    assert [r["outlet"] for r in scans.enabled_feeds(feeds, country=" CZ").collect()] == ["c"]


def test_files(spark, tmp_path):
    (tmp_path / "m.md").write_text("# t\n\n| # | label |\n|---|:--|\n| 1 | fear |\n| 2 | |\n", encoding="utf-8")
    assert [r["cells"] for r in scans.read_markdown_table(spark, str(tmp_path / "m.md")).orderBy("row").collect()] == [["#", "label"], ["1", "fear"], ["2", ""]]
    (tmp_path / "l.json").write_text(json.dumps([{"article_id": "1", "label": "x"}]))
    (tmp_path / "e.json").write_text(json.dumps({"predictions": [{"article_id": "2", "label": "y"}]}))
    (tmp_path / "k.json").write_text(json.dumps({"3": {"label": "z"}}))
    read = lambda n: [(r["article_id"], r["label"], r["record_id"]) for r in scans.read_json_records(spark, str(tmp_path / n), "article_id string, label string").collect()]
    assert read("l.json") == [("1", "x", None)] and read("e.json") == [("2", "y", None)] and read("k.json") == [(None, "z", "3")]
    (tmp_path / "j.jsonl").write_text('{"a": 1}\nnot json\n')
    assert [(r["a"], r["_corrupt_record"]) for r in scans.read_jsonl(spark, str(tmp_path / "j.jsonl"), "a int").collect()] == [(1, None), (None, "not json")]
    (tmp_path / "c.csv").write_text('a,b\n1,"x, ""y"""\n')
    assert scans.read_csv_records(spark, str(tmp_path / "c.csv")).first()["b"] == 'x, "y"'
    df = spark.createDataFrame([("```json\n{\"a\": 2}\n```",), ("no",)], "t string")
    assert [None if r[0] is None else r[0]["a"] for r in df.select(scans.fenced_json(F.col("t"), "a int")).collect()] == [2, None]


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 0.5), (None, "n", 0.1)], "k int, v string, r double")
    new = spark.createDataFrame([(1, "b", 0.9), (2, "c", 0.1), (2, "d", 0.2), (None, "z", 0.3)], "k int, v string, r double")
    rows = lambda df: sorted((tuple(r) for r in df.select("k", "v", "r").collect()), key=repr)
    assert rows(sinks.insert_or_ignore(old, new, ["k"], [F.col("v")])) == sorted([(1, "a", 0.5), (None, "n", 0.1), (2, "c", 0.1)], key=repr)
    assert rows(sinks.insert_or_replace(old, new, ["k"], [F.desc("v")])) == sorted([(1, "b", 0.9), (2, "d", 0.2), (None, "z", 0.3)], key=repr)
    merged = sinks.upsert(old.where("k = 1"), spark.createDataFrame([(1, "  ", 0.2), (3, "q", 0.4)], "k int, v string, r double"), ["k"], {"v": "new", "r": "max"})
    assert rows(merged) == [(1, "a", 0.5), (3, "q", 0.4)]


def test_tables_are_written_together(spark, tmp_path):
    good, root = spark.range(3), str(tmp_path / "db")
    sinks.write_together(spark, {"one": good, "two": good}, root, "r1")
    assert sinks.read_together(spark, root, "one", "r1").count() == 3
    bad = spark.range(2).select(F.raise_error(F.lit("stop")).alias("x"), "id")
    with pytest.raises(Exception, match="stop"):
        sinks.write_together(spark, {"one": spark.range(9), "two": bad}, root, "r1")
    assert sinks.read_together(spark, root, "one", "r1").count() == 3 == sinks.read_together(spark, root, "two", "r1").count()
    assert len(list((tmp_path / "db/data/r1").iterdir())) == 1
    sinks.write_together(spark, {"one": spark.range(5)}, root, "r1")
    assert sinks.read_together(spark, root, "one", "r1").count() == 5
    with pytest.raises(LookupError):
        sinks.read_together(spark, root, "one", "r")
    sinks.write_report({"a": "č"}, str(tmp_path / "x/report.json"))
    assert json.loads((tmp_path / "x/report.json").read_text())["a"] == "č"
    sinks.overwrite_partitions(spark.createDataFrame([(1, "p"), (2, "q")], "v int, k string"), f"{root}/p", ["k"])
    sinks.overwrite_partitions(spark.createDataFrame([(9, "q")], "v int, k string"), f"{root}/p", ["k"])
    assert {tuple(r) for r in spark.read.parquet(f"{root}/p").collect()} == {(1, "p"), (9, "q")}


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(1, "2025-01-01"), (1, "2025-01-01"), (2, "2025-01-02")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(path)
    stream = SP.read_stream(spark, path, "k int, ts timestamp")
    assert sorted(r["k"] for r in SP.run_available(SP.unique_by(stream, "k", "ts")).collect()) == [1, 2]
    rows = [("s", f"2025-0{i}-01", 0.5, 0.0, 0.0, 30) for i in (2, 1, 3)]
    p2 = str(tmp_path / "profiles")
    df = spark.createDataFrame(rows, "segment string, t string, concern_level double, purchase_intent double, avoidance_signals double, article_count long")
    df.select("segment", F.col("t").cast("timestamp").alias("window_start"), *C.SIGNALS, "article_count").coalesce(1).write.parquet(p2)
    schema = spark.read.parquet(p2).schema
    folded = SP.run_available(SP.fold_baselines(SP.read_stream(spark, p2, schema), dict.fromkeys(C.SIGNALS, 0.0)), "update")
    r = folded.first()
    assert (r["concern_level"], r["sample_count"]) == (0.244, 3)
