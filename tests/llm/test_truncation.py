"""Endings, lengths and limits."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mediagauge.llm import truncation
from mediagauge.llm.truncation import BROKEN, DOUBTFUL, ENCODINGS, FINISHED, OPEN, ending, inspected_values, length_limits, lengths, truncated_values, truncation_rates


@pytest.mark.parametrize(
    ("value", "state"),
    [
        ("A whole sentence.", FINISHED),
        ('He said: "No."', FINISHED),
        ("„Teď je řada na nás.“", FINISHED),
        ("Stops in the mid", OPEN),
        ("Stops here…", OPEN),
        ("Stops [...]", OPEN),
        ("Stops [+426 chars]", OPEN),
        ("Stops (…) \n", OPEN),
        ("Whole. Next <a hre", BROKEN),
        ("Whole. Next &nb", BROKEN),
        ("Whole. Nex�", BROKEN),
        ("„So nicht“, sagt", OPEN),
        ("„So nicht“", OPEN),
        ("Seen by Dr.", DOUBTFUL),
        ("Es geschah am 3.", DOUBTFUL),
        ("It was written in 2024.", FINISHED),
    ],
)
def test_endings(value, state):
    assert ending(value)[0] == state


def test_title_and_lengths():
    assert ending("THE WHOLE title", "The whole  title")[0] == FINISHED
    assert ending("The whole ti", "The whole title")[0] == OPEN
    sizes = dict(zip(ENCODINGS, lengths('á<"\n🙂…'), strict=True))
    assert sizes == {"characters": 6, "utf8": 12, "utf16": 7, "html": 14, "json": 8, "crlf": 7, "characters_bare": 5, "utf8_bare": 9, "html_bare": 13, "json_bare": 7, "crlf_bare": 6}


def test_table(spark):
    rng = random.Random(0)
    feeds = spark.createDataFrame([("o", "O", "o.example"), ("p", "P", "p.example")], "outlet string, outlet_name string, host string")
    rows, cut = [], set()
    words = ["mayor", "bridge", "school", "price", "winter", "council"]
    for i in range(400):
        text = " ".join(" ".join(rng.choice(words) for _ in range(6)).capitalize() + "." for _ in range(rng.randrange(2, 9)))
        body = text + "\n" + rng.choice(["Share this story", "By Ann Lee", "(with agency material)", "Read 12 times", "Done."])
        summary = text.split(". ")[0].rstrip(".") + "."
        if i % 5 == 0:
            body = text[:70].rstrip()
            if not body.endswith("."):
                cut.add((f"a{i}", "body"))
        if i % 7 == 0:
            summary = text.split(". ")[0] + ". Read the full story…"
        if i % 11 == 0:
            summary = text[:40].rstrip(". ") + " (…)"
            cut.add((f"a{i}", "summary"))
        rows.append((f"a{i}", rng.choice(["o", "P"]), None if i % 2 else "Some title", summary, body))
    rows += rows[:20] + [("x", None, None, None, ""), ("y", "?", "T t", "T  T", "  "), (None, "o", None, "cut o", "cut o")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "article_id string, outlet string, title string, summary string, body string, tail int")
    got = {(r[0], r[1]) for r in truncated_values(df, feeds).collect()}
    assert len(got ^ cut) <= 2
    limits = {(r["std_outlet"], r["field_name"], r["length"]) for r in length_limits(inspected_values(df, feeds)).where(F.col("encoding") == "characters").collect()}
    assert limits & {(o, "body", n) for o in "op" for n in (69, 70)}
    rates = {(r["std_outlet"], r["field_name"]): r["n_cut"] for r in truncation_rates(df, feeds).collect()}
    assert sum(rates.values()) == len(got)
    assert truncated_values(df.limit(0), feeds).count() == 0


def test_limits_decide_what_endings_leave_open(spark, monkeypatch):
    """Values cut at a limit after an ordinal number, and pieces of a closing line of any length, are found by their length."""
    feeds = spark.createDataFrame([("o", "O", "o.example")], "outlet string, outlet_name string, host string")
    rng = random.Random(5)
    words = ["mayor", "bridge", "school", "price", "winter", "council", "harbour"]
    line = "read the whole story with all its pictures and every comment of our readers on the pages of the paper and in our weekly magazine " * 2
    rows, cut = [], set()
    for i in range(300):
        text = " ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4, 9))).capitalize() + "." for _ in range(rng.randrange(3, 12)))
        body = text + "\n" + line.strip()
        if i % 10 == 0:
            body = (text * 3)[:96].rsplit(" ", 1)[0].ljust(96, "x") + " 3."
            cut.add(f"a{i}")
        elif i % 10 in (1, 2):
            body = (text * 3)[:90].rstrip(". ") + f"z{i:03d}".translate(str.maketrans("0123456789", "abcdefghij")).ljust(9, "x")
            body = body.ljust(99, "y")
            cut.add(f"a{i}")
        elif i % 10 == 3:
            body = (text + "\n" + line)[: len(text) + 60].rstrip()
            body = "x" * max(0, 99 - len(body)) + body if len(body) <= 99 else body[len(body) - 99 :]
            cut.add(f"a{i}")
        rows.append((f"a{i}", "o", None, None, body))
    rows += [("whole", "o", None, None, "They met on the 3.")]
    df = spark.createDataFrame(rows, "article_id string, outlet string, title string, summary string, body string")
    got = {r[0] for r in truncated_values(df, feeds).collect()}
    assert len(got ^ cut) <= 2 and "whole" not in got
    plain = truncation.length_limits
    monkeypatch.setattr(truncation, "length_limits", lambda v: plain(v).limit(0))
    blind = {r[0] for r in truncated_values(df, feeds).collect()}
    assert len(got & cut) - len(blind & cut) >= 50
