"""Recurring lines against a plain count."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter, defaultdict

from mediagauge.llm import lines
from mediagauge.llm.lines import cleaned_bodies, line_keys, line_numbers, line_templates, repeated_lines, templated_lines


def feeds(spark):
    return spark.createDataFrame([("o1", "Ó One", "o1.example"), ("o2", "Two", "o2.example")], "outlet string, outlet_name string, host string")


def brute(rows, names):
    key = lambda x: re.sub("[0-9]+", "#", " ".join(unicodedata.normalize("NFC", x).split()).lower())
    bodies = {a: (names.get(o), b) for a, o, b in rows if a is not None and names.get(o)}
    totals = Counter(o for o, _ in bodies.values())
    seen = defaultdict(set)
    for a, (o, b) in bodies.items():
        for line in (b or "").split("\n"):
            seen[o, key(line)].add(a)
    out = set()
    for a, (o, b) in bodies.items():
        for i, line in enumerate((b or "").split("\n"), 1):
            n = len(seen[o, key(line)])
            if key(line) and n >= 4 and n * 20 >= totals[o]:
                out.add((a, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    names = {"o1": "o1", "Ó One": "o1", "Ó One ": "o1", "www.o2.example": "o2"}
    pool = ["Share this", "SHARE  this", "Čtěte dál", "Čtěte dál", "Seen 12 times", "seen 7 TIMES", "", "  ", "9"]
    rows = []
    for i in range(200):
        lines = [rng.choice(pool) if rng.random() < 0.4 else f"text {rng.random()} {'x' * rng.randrange(3)}" for _ in range(rng.randrange(0, 7))]
        rows.append((f"a{i}", rng.choice(list(names)), rng.choice(["\n", "\r\n"]).join(lines) if lines else rng.choice([None, ""])))
    rows += rows[:30] + [("n", None, "Share this"), ("u", "unknown", "Share this"), (None, "o1", "Share this")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "article_id string, outlet string, body string, template string, std_outlet int")
    got = {(r[0], r[1]) for r in repeated_lines(df, feeds(spark)).collect()}
    assert got == brute(rows, names)
    cleaned = {r["article_id"]: r for r in cleaned_bodies(df, feeds(spark)).collect()}
    gone_lines = {(r[0], r[1]) for r in templated_lines(df, feeds(spark))[1].collect()}
    texts = {a: b for a, _, b in rows if a}
    assert got <= gone_lines
    for a, b in texts.items():
        gone = {i for x, i in gone_lines if x == a}
        expected = None if b is None else "\n".join(x for i, x in enumerate(b.split("\n"), 1) if i not in gone)
        assert cleaned[a]["body"] == expected and cleaned[a]["removed"] == len(gone)
    assert line_templates(df, feeds(spark)).where("documents >= 4").count() > 0
    assert repeated_lines(df.limit(0), feeds(spark)).count() == 0


def test_numbers_join_what_differs_in_digits_only():
    keys = line_keys("Čteno 46×\nčteno   7×\n\nČteno x×\n" + "w " * 20_000)
    numbers = [line_numbers(k) for k in keys]
    assert numbers[0] == numbers[1] != numbers[3] and numbers[2] == (0, 0, 0)
    assert numbers[0][1] == numbers[3][1] and numbers[0][0] != numbers[3][0]


def test_names_fall_into_slots(spark):
    """Bylines that differ in a name become one template, whichever task saw them."""
    rng = random.Random(7)
    names = [a + b for a in ("ann", "bob", "cyr", "dan", "eve", "fil", "git", "hug") for b in ("a", "el", "in", "or", "us")]
    rows = []
    for i in range(160):
        last = f"Written by {rng.choice(names)} {rng.choice(names)}{i} today" if i % 2 else f"{rng.choice(names)}{i}th {rng.choice(names)} for the Agency"
        rows.append((f"a{i}", "o1", "\n".join([" ".join(rng.choice(names) + str(rng.random()) for _ in range(rng.randrange(4, 9))), last])))
    df = spark.createDataFrame(rows, "article_id string, outlet string, body string").repartition(7)
    found = {r["template"]: r["documents"] for r in line_templates(df, feeds(spark)).collect()}
    assert any(t.startswith("written by") and t.endswith("today") and n >= 70 for t, n in found.items())
    assert any(t.endswith("for the agency") and n >= 70 for t, n in found.items())
    cleaned = {r["article_id"]: r for r in cleaned_bodies(df, feeds(spark)).collect()}
    assert sum(r["removed"] == 1 for r in cleaned.values()) >= 150
    assert repeated_lines(df, feeds(spark)).count() == 0


def test_deliveries_that_differ(spark):
    rows = [(f"a{i}", "o1", f"unique {i} {'abcdefgh'[i]}\nShare this") for i in range(6)] + [("a0", "o1", "Share this\nother words\nthird"), ("a0", "nobody", "zz\nShare this")]
    df = spark.createDataFrame(rows, "article_id string, outlet string, body string")
    got = {r["article_id"]: r["body"] for r in cleaned_bodies(df, feeds(spark)).collect()}
    assert all("Share" not in b for b in got.values()) and got["a0"] in ("unique 0 a", "other words\nthird")


def test_found_lines_need_the_tree(spark, monkeypatch):
    df = spark.createDataFrame([(f"a{i}", "o1", "Share this") for i in range(6)], "article_id string, outlet string, body string")
    assert repeated_lines(df, feeds(spark)).count() == 6
    plain = lines.covering_nodes
    monkeypatch.setattr(lines, "covering_nodes", lambda *a, **k: plain(*a, **k).limit(0))
    assert repeated_lines(df, feeds(spark)).count() == 0
