"""Text cut off by field limits or in transfer.

The length of every value is recomputed as it would be under other encodings, escapings and
newline conventions. Lengths that pile up at one value within an outlet and field expose a
storage limit; the excess over nearby lengths is the probability that a value of this length was
cut there. The ending is the second look: how much more likely it is for a cut value than for a
whole one multiplies the odds. An ending that is certainly whole rules a cut out; one that may be
either, such as a piece of a closing line or an abbreviation, is decided by the limit.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagauge.llm.vectors import maybe_broadcast
from mediagauge.operators.outlets import with_standard_outlet
from mediagauge.session import materialize

#: The lengths that are compared, in the order in which they are stored.
ENCODINGS = ("characters", "utf8", "utf16", "html", "json", "crlf", "characters_bare", "utf8_bare", "html_bare", "json_bare", "crlf_bare")
FINISHED, OPEN, BROKEN, DOUBTFUL = 0, 1, 2, 3
#: Probability of a cut for a value at no exposed limit, and the most that a limit can give.
CUT_ELSEWHERE, CUT_AT_MOST = 0.05, 0.999
#: How many times likelier an ending is for cut values than for whole ones; a regular one is a line that closes many texts.
LIKELIER = {"finished": 0.0, "regular": 0.0005, "regular with a mark": 1.0, "piece of a regular one": 1.0, "doubtful": 1.0, "open": 20.0, "broken": 1000.0}
#: A tail closes texts regularly if so many values of the outlet and field end with it, and this share of them.
TAIL_COUNT, TAIL_SHARE_PERCENT = 3, 0.5
#: A length is a limit if so many values have it, and so many times more than lengths nearby have on average.
LIMIT_COUNT, LIMIT_RATIO, LIMIT_REACH = 5, 8, 25

_MARKER = re.compile(r"\s*(\[\s*(?:…|\.{3})\s*\]|\(\s*(?:…|\.{3})\s*\)|\[\s*\+\s*[0-9]+\s*\w+\s*\]|…|\.{3,}|�+)$")
_MARKUP = re.compile(r"<[a-zA-Z/!][^<>]*$|<$|&#?[a-zA-Z0-9]{0,8}$")
_ENDED = re.compile(r"[.!?。]['\"’”“»)\]]*$")
_SENTENCE = re.compile(r"(?<=[.!?])['\"’”“»)\]]*\s+")
_DIGITS = re.compile(r"[0-9]+")
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["dr", "mr", "mrs", "ms", "prof", "ing", "mgr", "bc", "tj", "tzn", "např", "mj", "tzv", "bzw", "ca", "nr", "bspw", "sog", "vgl", "jr", "vs"]
_STOP = re.compile(r"(?:^|[\s(\"'„“])(?:[^\W\d_]|[0-9]{1,2}|" + "|".join(ABBREVIATIONS) + r")\.$", re.IGNORECASE)


def _key(text: str) -> str:
    return _DIGITS.sub("#", " ".join(unicodedata.normalize("NFC", text).split()).lower())


def ending(value: str, title: str | None = None) -> tuple[int, str, str]:
    """State of a value's ending, its marker (digits masked) and the comparison form of its last words.

    FINISHED: the last sentence has its end mark, or the value repeats the whole title. BROKEN:
    it stops inside mark-up or a character. OPEN: it has no end mark, so the last words decide.
    DOUBTFUL: its full stop is that of an initial, an abbreviation or an ordinal number.
    """
    text = value.rstrip(" \t\r\n\f\v ​﻿")
    found = _MARKER.search(text)
    marker = found.group(1) if found else ""
    core = text[: found.start()] if found else text
    if not core.strip():
        return (BROKEN if marker else FINISHED), _DIGITS.sub("#", marker), ""
    line = core.rsplit("\n", 1)[-1]
    if "�" in marker or _MARKUP.search(line):
        return BROKEN, _DIGITS.sub("#", marker), ""
    if title and _key(text) == _key(title):
        return FINISHED, "", ""
    if _ENDED.search(core):
        doubtful = not marker and _STOP.search(line)
        return (DOUBTFUL, "", _key(line)) if doubtful else (FINISHED, _DIGITS.sub("#", marker), "")
    tail = _SENTENCE.split(line)[-1]
    return OPEN, _DIGITS.sub("#", marker), _key(tail + text[len(core) :])


def lengths(value: str) -> list[int]:
    """Lengths of a value under every entry of ENCODINGS; the bare ones without a closing marker."""
    characters = len(value)
    if value.isascii():
        utf8 = utf16 = characters
    else:
        utf8 = len(value.encode("utf-8", "surrogatepass"))
        utf16 = characters + sum(1 for c in value if c > "\uffff")
    whole = [characters, utf8, utf16, *_escaped(value, characters)]
    found = _MARKER.search(value)
    if not found:
        return [*whole, characters, utf8, *whole[3:]]
    bare = value[: found.start()]
    return [*whole, len(bare), len(bare.encode("utf-8", "surrogatepass")), *_escaped(bare, len(bare))]


def _escaped(text: str, characters: int) -> tuple[int, int, int]:
    """Lengths with HTML entities, JSON escapes and CR LF line ends."""
    feeds = text.count("\n")
    entities = characters + 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * (text.count('"') + text.count("'"))
    quoted = len(json.dumps(text, ensure_ascii=False)) - 2
    return entities, quoted, characters + feeds - text.count("\r\n")


def _inspect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for article, outlet, title, summary, body in zip(*(pdf[c] for c in ("article_id", "std_outlet", "title", "summary", "body")), strict=True):
            for field, value in (("summary", summary), ("body", body)):
                if not isinstance(value, str) or not value.strip():
                    continue
                state, marker, tail = ending(value, title if field == "summary" and isinstance(title, str) else None)
                number = (xxhash.xxh3_64_intdigest(tail) - (1 << 63)) if tail else 0
                # The text of a tail tells whether it stops inside a line that others finish.
                rows.append((article, outlet, field, state, marker, number, tail or None, np.array(lengths(value), dtype=np.int32)))
        yield pd.DataFrame(rows, columns=["article_id", "std_outlet", "field_name", "state", "marker", "tail", "tail_text", "sizes"])


_INSPECTED = "article_id string, std_outlet string, field_name string, state int, marker string, tail bigint, tail_text string, sizes array<int>"


def inspected_values(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """One row per article and non-blank field: the state of its ending, its last words and its lengths.

    Repeated deliveries count once. An outlet that no feed accepts stands under its own spelling,
    a null one under an empty name.
    """
    slim = articles.select("article_id", "outlet", "title", F.nullif("summary", F.lit("")).alias("summary"), F.nullif("body", F.lit("")).alias("body"))
    named = with_standard_outlet(slim.where("article_id is not null"), feeds.select("outlet", "outlet_name", "host"))
    named = named.withColumn("std_outlet", F.coalesce("std_outlet", F.lower(F.trim("outlet")), F.lit("")))
    rows = named.select("article_id", "std_outlet", "title", "summary", "body").mapInPandas(_inspect, _INSPECTED)
    fields = ["std_outlet", "state", "marker", "tail", "tail_text", "sizes"]
    one = rows.groupBy("article_id", "field_name").agg(F.max(F.struct(*fields)).alias("r"))
    return materialize(one.select("article_id", "field_name", "r.*"), "endings")


def length_limits(values: DataFrame) -> DataFrame:
    """``std_outlet, field_name, encoding, marker, length, n, cut, nearby, cut_probability``: lengths at which values pile up unfinished.

    ``n`` values have the length, ``cut`` of them without a sure sentence end, ``nearby`` is the
    average number for the lengths up to LIMIT_REACH away; cut_probability is the excess over it.
    """
    names = F.array(*[F.lit(e) for e in ENCODINGS])
    long = values.select("std_outlet", "field_name", "marker", (F.col("state") != FINISHED).cast("int").alias("open"), F.posexplode("sizes").alias("e", "length"))
    counts = long.groupBy("std_outlet", "field_name", "marker", "e", "length").agg(F.count("*").alias("n"), F.sum("open").alias("cut"))
    from pyspark.sql import Window

    w = Window.partitionBy("std_outlet", "field_name", "marker", "e").orderBy("length").rangeBetween(-LIMIT_REACH, LIMIT_REACH)
    near = counts.withColumn("nearby", (F.sum("n").over(w) - F.col("n")) / F.lit(2.0 * LIMIT_REACH))
    piled = near.where((F.col("cut") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_RATIO * F.col("nearby")))
    return piled.select(
        "std_outlet", "field_name", F.element_at(names, F.col("e") + 1).alias("encoding"), "marker", "length", "n", "cut", F.round("nearby", 3).alias("nearby"),
        F.round(F.least(1 - F.col("nearby") / F.col("n"), F.lit(CUT_AT_MOST)), 6).alias("cut_probability"),
    )


def _closing_tails(values: DataFrame) -> DataFrame:
    """Last words with which many values of an outlet and field end, and every shorter piece of them."""
    totals = values.groupBy("std_outlet", "field_name").agg(F.count("*").alias("total"))
    tails = values.where(F.col("state").isin(OPEN, DOUBTFUL)).groupBy("std_outlet", "field_name", "tail").agg(F.count("*").alias("n"), F.min("tail_text").alias("tail_text"))
    joined = tails.where(F.col("n") >= TAIL_COUNT).join(totals, ["std_outlet", "field_name"])
    return joined.where(F.col("n") * 100.0 >= F.col("total") * TAIL_SHARE_PERCENT).select("std_outlet", "field_name", "tail", "n", "tail_text")


def judged_values(articles: DataFrame, feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every value with ``at_limit``, ``limit_probability``, ``cut_probability`` and ``cut``, and the table of limits.

    The odds of a cut are those of the likeliest limit that the value's lengths meet, or of
    CUT_ELSEWHERE, times how much likelier its ending is for cut values; ``cut`` is a probability
    of a half or more. A null or blank value has no row.
    """
    values = inspected_values(articles, feeds)
    limits = materialize(length_limits(values), "length-limits")
    closing = materialize(_closing_tails(values), "closing-tails")
    # A tail has a share of its outlet's values, so there are at most 100 / TAIL_SHARE_PERCENT of them to compare.
    longer = closing.select("std_outlet", "field_name", F.col("tail_text").alias("whole"), F.col("n").alias("whole_n"))
    pieces = closing.join(longer, ["std_outlet", "field_name"]).where(
        F.col("whole").startswith(F.col("tail_text")) & (F.length("whole") > F.length("tail_text")) & (F.col("whole_n") > F.col("n"))
    )
    short = pieces.select("std_outlet", "field_name", "tail", F.lit(True).alias("piece")).distinct()
    closing = closing.join(short, ["std_outlet", "field_name", "tail"], "left").select("std_outlet", "field_name", "tail", F.lit(True).alias("closes"), F.coalesce("piece", F.lit(False)).alias("piece"))
    number = F.create_map(*[x for i, e in enumerate(ENCODINGS) for x in (F.lit(e), F.lit(i))])
    exposed = F.collect_set(F.struct(number[F.col("encoding")].alias("at"), "length", F.col("cut_probability").alias("p")))
    by_marker = limits.groupBy("std_outlet", "field_name", "marker").agg(exposed.alias("limits"))
    at = values.join(maybe_broadcast(by_marker), ["std_outlet", "field_name", "marker"], "left")
    met = F.transform(F.filter("limits", lambda x: F.get("sizes", x["at"]) == x["length"]), lambda x: x["p"])
    at = at.withColumn("limit_probability", F.coalesce(F.array_max(met), F.lit(0.0))).withColumn("at_limit", F.col("limit_probability") > 0)
    judged = at.join(maybe_broadcast(closing), ["std_outlet", "field_name", "tail"], "left")
    bracketed = F.col("marker").startswith("[") | F.col("marker").startswith("(")
    look = (
        F.when(F.col("state") == FINISHED, "finished")
        .when(F.col("state") == BROKEN, "broken")
        .when(F.col("closes").isNull(), F.when(F.col("state") == DOUBTFUL, "doubtful").otherwise("open"))
        .when(F.coalesce("piece", F.lit(False)), "piece of a regular one")
        .when(bracketed, "regular with a mark")
        .otherwise("regular")
    )
    times = F.create_map(*[F.lit(x) for pair in LIKELIER.items() for x in pair])[look]
    prior = F.greatest("limit_probability", F.lit(CUT_ELSEWHERE))
    odds = prior / (1 - prior) * times
    judged = judged.withColumn("cut_probability", F.round(odds / (1 + odds), 6))
    return judged.select("article_id", "field_name", "std_outlet", "marker", "at_limit", "limit_probability", "cut_probability", (F.col("cut_probability") >= 0.5).alias("cut")), limits


def truncated_values(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """``article_id, field_name`` of the bodies and summaries that were cut."""
    values, _ = judged_values(articles, feeds)
    return values.where("cut").select("article_id", "field_name")


def truncation_rates(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Per outlet and field: values, how many were cut, how many of these at a limit, the excess at limits, and the rate.

    ``limit_excess`` is the number of cuts that the lengths alone tell of.
    """
    values, _ = judged_values(articles, feeds)
    c = F.col("cut").cast("int")
    per = values.groupBy("std_outlet", "field_name").agg(
        F.count("*").alias("n_values"), F.sum(c).alias("n_cut"), F.sum(c * F.col("at_limit").cast("int")).alias("n_at_limit"), F.round(F.sum("limit_probability"), 2).alias("limit_excess")
    )
    return per.withColumn("cut_rate", F.round(F.col("n_cut") / F.col("n_values"), 6))
