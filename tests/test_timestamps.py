"""Timestamps: notations, zones, daylight saving, impossible values."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mediagauge.functions.zones import local_to_utc, transitions
from mediagauge.operators.timestamps import normalized_instants, parse_texts, parser_for, zone_table

PRAGUE, US = ("Europe/Prague", "CZ"), ("America/New_York", "US")


def us(*a, tz=timezone.utc) -> int:
    delta = datetime(*a, tzinfo=tz).astimezone(timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return delta // timedelta(microseconds=1)


def one(text, zone=PRAGUE):
    return parse_texts([text], [zone[0]], [zone[1]])[0]


CASES = [
    ("2025-01-06T22:17:48+01:00", PRAGUE, us(2025, 1, 6, 21, 17, 48)),
    ("2025-10-20T18:30:29", PRAGUE, us(2025, 10, 20, 16, 30, 29)),
    ("2024-09-17T20:57:38Z", PRAGUE, us(2024, 9, 17, 20, 57, 38)),
    ("2025-05-10 11:59:15.914", PRAGUE, us(2025, 5, 10, 9, 59, 15, 914000)),
    ("2025-08-07T02:35:38.250916846Z", US, us(2025, 8, 7, 2, 35, 38, 250916)),
    ("20240710T035023Z", US, us(2024, 7, 10, 3, 50, 23)),
    ("1739351646", PRAGUE, 1739351646_000000),
    ("1760644292849", PRAGUE, 1760644292849_000),
    ("1734775804.20", PRAGUE, 1734775804_200000),
    ("2025-04-12", PRAGUE, us(2025, 4, 11, 22)),
    ("2024-06-12 22:33:58 Europe/Berlin", US, us(2024, 6, 12, 20, 33, 58)),
    ("2024-03-12T12:01:21+01:00[Europe/Berlin]", US, us(2024, 3, 12, 11, 1, 21)),
    (" 2025-07-13 18:51:13 +02:00\n", US, us(2025, 7, 13, 16, 51, 13)),
    ("Fri, 19 Dec 2025 09:04:01 +0545", PRAGUE, us(2025, 12, 19, 3, 19, 1)),
    ("Sun, 30 Mar 2025 01:35:52 CET", PRAGUE, us(2025, 3, 30, 0, 35, 52)),
    ("Tue, 1 Jul 2025 10:00:00 EST", ("Australia/Sydney", "AU"), us(2025, 7, 1, 0)),
    ("Tue, 1 Jul 2025 10:00:00 EST", US, us(2025, 7, 1, 15)),
    ("Wed, 12 Feb 2025 15:23:36 IST", ("Asia/Kolkata", "IN"), us(2025, 2, 12, 9, 53, 36)),
    ("14. 9. 2025 15:40", PRAGUE, us(2025, 9, 14, 13, 40)),
    ("21. února 2024 v 13:15", PRAGUE, us(2024, 2, 21, 12, 15)),
    ("2. Juli 2024, 19:03 Uhr", ("Europe/Berlin", "DE"), us(2024, 7, 2, 17, 3)),
    ("19.10.24 17:57", ("Europe/Berlin", "DE"), us(2024, 10, 19, 15, 57)),
    ("11/12/2025 1:16 AM", US, us(2025, 11, 12, 6, 16)),
    ("11/12/2025 1:16", ("Europe/London", "GB"), us(2025, 12, 11, 1, 16)),
    ("August 10, 2025 at 7:56 a.m.", US, us(2025, 8, 10, 11, 56)),
    ("11/12/2025 12:05 am", ("Europe/London", "GB"), us(2025, 12, 11, 0, 5)),
    ("2024-10-27T02:30:00", PRAGUE, us(2024, 10, 27, 0, 30)),
    ("2024-03-31T02:30:00", PRAGUE, us(2024, 3, 31, 1, 30)),
]


@pytest.mark.parametrize(("text", "zone", "expected"), CASES)
def test_notations(text, zone, expected):
    assert one(text, zone) == expected


@pytest.mark.parametrize(
    "text",
    [None, "", "  ", "n/a", "-", "unknown", "just now", "včera", "vor 2 Stunden", "0000-00-00 00:00:00", "2024-02-30T10:00:00Z", "2025-13-05 08:00", "2024-11-31 12:00", "25:61", "2024-01-01T24:01:00Z", "x" * 5000, "13/13/2025 10:00 AM", "2024-01-01 13:00 PM"],
)
def test_no_instant(text):
    assert one(text) is None


def test_unknown_zone_gives_no_local_time():
    assert parse_texts(["2024-01-01T10:00:00", "2024-01-01T10:00:00Z"], [None, None], [None, None]) == [None, us(2024, 1, 1, 10)]


@settings(max_examples=150, deadline=None)
@given(st.datetimes(datetime(1950, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["Europe/Prague", "America/New_York", "Australia/Sydney", "Asia/Kolkata"]))
def test_local_times_equal_the_library(moment, zone):
    moment = moment.replace(microsecond=0)
    seconds = (moment - datetime(1970, 1, 1)) // timedelta(seconds=1)
    expected = moment.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc)
    got = int(local_to_utc(zone, np.array([seconds]))[0])
    assert got == (expected - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)


def test_a_mask_is_compiled_once():
    assert parser_for("9999-99-99") is parser_for("9999-99-99")
    assert transitions("Nowhere/Land") is None


def test_tables(spark):
    feeds = spark.createDataFrame(
        [("a_b", "Á B", "a-b.example", "Europe/Prague", "CZ"), ("us", "US Post", "us.example", "America/New_York", "US")],
        "outlet string, outlet_name string, host string, time_zone string, country string",
    )
    rows = [("1", "a_b", "2025-04-12", 1), ("1", "www.a-b.example", "2025-04-12", 2), ("2", "Á B ", "2025-04-12 10:00", 3), ("3", None, "2025-04-12 10:00", 4), ("4", "US", "04/12/2025 1:00 AM", 5), (None, "us", "1739351646", 6), ("5", "us", None, 7)]
    articles = spark.createDataFrame(rows, "article_id string, outlet string, published_at string, time_zone int")
    got = {r["article_id"]: r["published_us"] for r in normalized_instants(articles, feeds).collect()}
    assert got == {"1": us(2025, 4, 11, 22), "2": us(2025, 4, 12, 8), "4": us(2025, 4, 12, 5)}
    assert normalized_instants(articles.limit(0), feeds).count() == 0
    assert zone_table(feeds).where("tz_version is not null").select("time_zone").distinct().count() == 2
