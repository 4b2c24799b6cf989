"""Caps per contributor against a plain ranking, batch by batch."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mediagauge.llm import contributors
from mediagauge.llm.contributors import cap_batch, cap_share, cap_signals, new_state, open_state

KEYS = ["run_id", "std_outlet"]


def ranked(rows, limit):
    groups = {}
    for r in rows.values():
        groups.setdefault((r[0], r[1]), []).append(r)
    keep, gone = set(), set()
    for key, g in groups.items():
        bad = lambda s: s is None or s != s
        g.sort(key=lambda r: (bad(r[3]), 0 if bad(r[3]) else -r[3], r[2]))
        keep |= {r[2] for r in (g if None in key else g[:limit])}
        gone |= {r[2] for r in ([] if None in key else g[limit:])}
    return keep, gone


def test_batches_equal_one_ranking(spark):
    rng = random.Random(2)
    state, rows = None, {}
    schema = "run_id string, std_outlet string, id long, score double"
    for _ in range(4):
        batch = {}
        for _ in range(120):
            i = rng.randrange(200)
            batch[i] = (rng.choice(["r", "r", "s"]), rng.choice(["x", "x", "x", "y", None]), i, rng.choice([None, float("nan"), 0.5, 0.5, rng.random()]))
        rows.update(batch)
        frame = spark.createDataFrame([*batch.values(), ("r", "x", None, 1.0)], schema)
        state = cap_batch(state or new_state(frame, KEYS, 4), frame)
        keep, gone = ranked(rows, 4)
        assert {r["id"] for r in state.kept.collect()} == keep
        assert {r["id"] for r in state.displaced.collect()} == gone
    again = open_state(spark, state.folder, 4)
    assert again.parts == state.parts and {r["id"] for r in again.displaced.collect()} == gone


def test_a_batch_writes_what_it_touches(spark):
    schema = "run_id string, std_outlet string, id long, score double"
    first = spark.createDataFrame([(f"r{i % 40}", "x", i, i / 400) for i in range(400)], schema)
    state = cap_batch(new_state(first, KEYS, 2), first, updates=False)
    second = cap_batch(state, spark.createDataFrame([("r3", "x", 1000, 0.99), ("r3", "x", 1001, 0.0)], schema), updates=False)
    changed = [b for b in state.parts if second.parts[b] != state.parts[b]]
    assert len(changed) == 1 and second.log[:1] == state.log
    new = {(r["id"], r["event"]) for r in spark.read.parquet(second.log[1]).collect()}
    assert new == {(1001, "displaced"), (323, "displaced")}


def test_found_rows_come_from_the_state(spark, monkeypatch):
    feeds = spark.createDataFrame([("x", "X", "x.example")], "outlet string, outlet_name string, host string")
    articles = spark.createDataFrame([("a", "x")], "article_id string, outlet string")
    rows = spark.createDataFrame([(i, "r", "a", "x", (i * 37 % 100) / 100) for i in range(90)], "signal_id long, run_id string, article_id string, outlet string, topic_relevance_score double")
    rows = rows.withColumn("extracted_at", F.timestamp_seconds("signal_id"))
    assert cap_signals(rows, articles, feeds, 8).displaced.count() == 82
    monkeypatch.setattr(contributors, "cutoffs", lambda kept, keys, limit: kept.limit(0).select(*keys, F.col("score").alias("cut_score"), F.col("id").alias("cut_id")))
    assert cap_signals(rows, articles, feeds, 8).displaced.count() != 82


def test_share(spark):
    rows = [("r", "x", i, i / 10) for i in range(10)] + [("r", "y", 20, None), ("r", "y", 21, float("nan")), ("r", None, 30, 0.1), ("s", "x", 40, None), ("s", "x", 41, None), (None, "x", 50, 0.1), ("r", "x", None, 0.1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "run_id string, std_outlet string, id long, score double, most int")
    got = {r["id"] for r in cap_share(df, ["run_id"], "std_outlet", 0.4).where("not stays").collect()}
    assert got == {0, 1, 2, 3, 4, 41}
    assert cap_share(df.limit(0), ["run_id"], "std_outlet", 0.4).count() == 0


def test_signals(spark):
    feeds = spark.createDataFrame([("x_y", "X Ý", "x-y.example"), ("b", "B", "b.example")], "outlet string, outlet_name string, host string")
    articles = spark.createDataFrame([("a1", "X Ý", "k"), ("a1", "x_y", "k"), (None, "b", "k")], "article_id string, outlet string, score string")
    spelled = ["x_y", " X_Y", "X Ý", "www.x-y.example", "x-y.example", None]
    rows = [(i, "r", "a1", spelled[i % 6], 0.5 if i else None, f"2025-01-{i + 1:02d}", "z") for i in range(12)]
    rows += [(3, "r", "a1", "x_y", 0.9, "2025-02-01", "z"), (3, "r", "a1", "x_y", 0.9, "2025-02-01", "z"), (50, "r", "zz", None, 0.9, "2025-01-01", "z"), (51, None, "a1", "b", 0.1, None, "z"), (None, "r", "a1", "b", 0.1, None, "z")]
    df = spark.createDataFrame(rows, "signal_id long, run_id string, article_id string, outlet string, topic_relevance_score double, t string, std_outlet string").withColumn("extracted_at", F.col("t").cast("timestamp"))
    state = cap_signals(df, articles, feeds, 8)
    assert {r["id"] for r in state.displaced.collect()} == {0, 9, 10, 11}
    assert {r["id"] for r in state.kept.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 50, 51}
    assert cap_signals(df.limit(0), articles, feeds).displaced.count() == 0
