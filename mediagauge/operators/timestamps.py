"""Normalisation of feed-supplied timestamps to one UTC instant.

Each text is tokenised into a mask of character classes (digits keep their count, a run of
letters is one ``a``, a run of white space one blank). A mask is mapped to a parser once per
worker; all texts of a mask are then converted together with numpy, local times through the
offset tables of ``mediagauge.functions.zones``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagauge.functions.zones import local_to_utc, transitions, zone_version
from mediagauge.operators.outlets import with_standard_outlet

# Month names by language, January first; an alternative form follows a slash.
MONTH_NAMES = {
    "en": "january february march april may june july august september october november december",
    "en short": "jan feb mar apr may jun jul aug sep/sept oct nov dec",
    "de": "januar/jänner februar/feber märz/maerz april mai juni juli august september oktober november dezember",
    "de short": "jän feb mrz apr mai jun jul aug sep okt nov dez",
    "cs genitive": "ledna února března dubna května června července srpna září října listopadu prosince",
    "cs": "leden únor březen duben květen červen červenec srpen září říjen listopad prosinec",
    "cs short": "led úno bře dub kvě čvn čvc srp zář říj lis pro",
}
# Words between date and time, and words after a time.
JOINING_WORDS = {"t", "v", "ve", "at", "um", "o"}
CLOCK_WORDS = {"uhr", "hodin", "hod", "h"}
# Weekday names, which are skipped.
WEEKDAY_NAMES = set(
    "mon monday tue tues tuesday wed wednesday thu thur thurs thursday fri friday sat saturday sun sunday "
    "mo montag di dienstag mi mittwoch do donnerstag fr freitag sa samstag sonnabend so sonntag "
    "po pondeli ut utery st streda ct ctvrtek pa patek sobota ne nedele".split()
)
# Minutes east of UTC of zone abbreviations, and where a country uses them otherwise.
ZONE_ABBREVIATIONS = {
    "z": 0, "utc": 0, "ut": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60,
    "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "sec": 60, "selc": 120,
    "eet": 120, "eest": 180, "msk": 180, "ist": 330, "jst": 540, "kst": 540,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
ABBREVIATIONS_BY_COUNTRY = {
    ("AU", "est"): 600, ("AU", "edt"): 660, ("AU", "cst"): 570, ("AU", "cdt"): 630, ("AU", "wst"): 480,
    ("IE", "ist"): 60, ("IL", "ist"): 120, ("CN", "cst"): 480, ("BD", "bst"): 360, ("CU", "cst"): -300,
}
#: Countries whose all-number dates with slashes begin with the month.
MONTH_FIRST_COUNTRIES = {"US", "PH", "PR", "GU"}

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
_DATE = (
    r"(?:a\.?,? )?(?:"
    r"(?P<y>9999)-(?P<m>99)-(?P<d>99)"
    r"|(?P<y_>9999)[/.](?P<m_>99?)[/.](?P<d_>99?)"
    r"|(?P<ymd>99999999)(?=a9)"
    r"|(?P<d1>99?)\. ?(?P<m1>99?)\. ?(?P<y1>9999|99)"
    r"|(?P<s1>99?)/(?P<s2>99?)/(?P<y2>9999|99)"
    r"|(?P<d3>99?)\.? (?P<mon3>a)\.?,? (?P<y3>9999)"
    r"|(?P<d4>99)-(?P<mon4>a)-(?P<y4>9999)"
    r"|(?P<mon5>a)\.? (?P<d5>99?),? (?P<y5>9999)"
    r")"
)
_TIME = r"(?P<H>99?)[:.](?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?|(?P<hms>999999)|(?P<hm>9999)(?=a$)"
_ZONE = (
    r"(?: ?(?P<sign>[+-])(?:(?P<oh>99)(?::(?P<om>99))?|(?P<off4>9999)))?"
    r"(?P<named> ?\[?(?P<iana>a(?:/a(?:[_-]a)*)+)\]?)?"
    r"(?: ?\(a\))?"
)
_LAYOUTS = [
    re.compile(r"(?P<neg>-)?(?P<epoch>9{1,14})(?:[.,](?P<ef>9+))?"),
    re.compile(rf"{_DATE}(?:(?:,? (?:(?P<join>a) )?|(?P<t>a)|, )(?:{_TIME})(?: ?(?P<ap>a)(?:\.(?P<ap2>a)\.)?)?(?: (?P<w2>a))?)?{_ZONE}"),
]


def _plain(word: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(ch))


MONTHS = {
    _plain(form): number
    for names in MONTH_NAMES.values()
    for number, forms in enumerate(names.split(), 1)
    for form in forms.split("/")
}


def mask_of(text: str) -> str:
    """The character-class mask of a trimmed text."""
    return "".join(_class(t) for t in _TOKEN.findall(text))


def _class(token: str) -> str:
    first = token[0]
    if "0" <= first <= "9":
        return "9" * len(token)
    if first.isspace():
        return " "
    return "a" if first.isalpha() else token


class _Parser:
    """What a mask says about its texts: a pattern to take them apart and the field of each part."""

    def __init__(self, mask: str, match: re.Match):
        parts, starts, at = [], {}, 0
        for i, token in enumerate(_TOKEN.findall(mask)):
            if token[0] == "9":
                parts.append(f"([0-9]{{{len(token)}}})")
            elif token == "a":
                parts.append(r"([^\W\d_]+)")
            else:
                parts.append(r"(\s+)" if token == " " else f"({re.escape(token)})")
            starts[at] = i
            at += len(token)
        self.pattern = re.compile("".join(parts), re.S)
        self.fields = {}
        self.spans = {}
        for name, value in match.groupdict().items():
            if value is None:
                continue
            begin, end = match.span(name)
            if begin == end:
                continue
            self.fields[name.rstrip("_")] = starts[begin]
            self.spans[name] = [starts[p] for p in sorted(starts) if begin <= p < end]
        weekday = re.match(r"a\.?,? (?=9)|a,? (?=a)", mask)
        self.weekday = 0 if weekday and "epoch" not in self.fields and self.fields.get("mon5") != 0 else None


@lru_cache(20_000)
def parser_for(mask: str) -> _Parser | None:
    """The parser of a mask; None if no layout denotes a date."""
    for layout in _LAYOUTS:
        if match := layout.fullmatch(mask):
            return _Parser(mask, match)
    return None


def _ints(texts: np.ndarray) -> np.ndarray:
    return texts.astype("U").astype(np.int64)


def _micros_of_fraction(texts: np.ndarray) -> np.ndarray:
    return np.array([int((t + "000000")[:6]) for t in texts], dtype=np.int64)


def _words(texts: np.ndarray, table: dict, missing: int) -> np.ndarray:
    memo = {t: table.get(_plain(t), missing) for t in set(texts)}
    return np.array([memo[t] for t in texts], dtype=np.int64)


def _convert(p: _Parser, texts: list[str], zones: np.ndarray, countries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds since 1970 and validity of texts that share a mask."""
    n = len(texts)
    parts = list(zip(*[p.pattern.fullmatch(t).groups() for t in texts], strict=True))
    get = lambda name: np.array(parts[p.fields[name]], dtype=object)
    has = p.fields.__contains__
    ok = np.ones(n, dtype=bool)
    if has("epoch"):
        digits = len(parts[p.fields["epoch"]][0])
        value = _ints(get("epoch"))
        micros = value * 1_000 if digits >= 12 else value * 1_000_000
        if has("ef"):
            fraction = _micros_of_fraction(get("ef"))
            micros = micros + (fraction if digits < 12 else fraction // 1_000)
        return (-micros if has("neg") else micros), ok

    if p.weekday is not None:
        ok &= _words(np.array(parts[p.weekday], dtype=object), dict.fromkeys(WEEKDAY_NAMES, 1), 0) == 1
    month_first = np.isin(countries.astype("U"), sorted(MONTH_FIRST_COUNTRIES))
    if has("ymd"):
        ymd = _ints(get("ymd"))
        y, m, d = ymd // 10_000, ymd // 100 % 100, ymd % 100
    elif has("s1"):
        one, two = _ints(get("s1")), _ints(get("s2"))
        y, m, d = _ints(get("y2")), np.where(month_first, one, two), np.where(month_first, two, one)
    else:
        tag = next(k[1:] for k in p.fields if re.fullmatch(r"d[0-9]?", k))
        y, d = _ints(get("y" + tag)), _ints(get("d" + tag))
        m = _words(get("mon" + tag), MONTHS, 0) if has("mon" + tag) else _ints(get("m" + tag))
    year_token = next((k for k in p.fields if re.fullmatch(r"y[0-9]?", k)), None)
    if year_token and len(parts[p.fields[year_token]][0]) == 2:
        y = np.where(y < 70, y + 2000, y + 1900)
    ok &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    first = ((np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1).astype("datetime64[M]")
    length = ((first + 1).astype("datetime64[D]") - first.astype("datetime64[D]")).astype(np.int64)
    ok &= d <= length
    days = first.astype("datetime64[D]").astype(np.int64) + d - 1

    zero = np.zeros(n, dtype=np.int64)
    if has("hms") or has("hm"):
        t = _ints(get("hms")) if has("hms") else _ints(get("hm")) * 100
        hour, minute, second = t // 10_000, t // 100 % 100, t % 100
    else:
        hour, minute, second = (_ints(get(k)) if has(k) else zero for k in "HMS")
    micro = _micros_of_fraction(get("f")) if has("f") else zero
    ok &= (hour < 24) & (minute < 60) & (second < 60)
    for joint in ("join", "t"):
        if has(joint):
            ok &= _words(get(joint), dict.fromkeys(JOINING_WORDS, 1), 0) == 1

    offset = np.zeros(n, dtype=np.int64)  # seconds east of UTC
    explicit = np.zeros(n, dtype=bool)
    for name in ("ap", "w2"):
        if not has(name):
            continue
        words = [_plain(w) for w in parts[p.fields[name]]]
        if name == "ap" and has("ap2"):
            words = [a + _plain(b) for a, b in zip(words, parts[p.fields["ap2"]], strict=True)]
        for i, w in enumerate(words):
            if w in ("am", "pm"):
                ok[i] &= 1 <= hour[i] <= 12
                hour[i] = hour[i] % 12 + 12 * (w == "pm")
            elif w in CLOCK_WORDS and not (has("ap2") and name == "ap"):
                pass
            else:
                minutes = ABBREVIATIONS_BY_COUNTRY.get((countries[i], w), ZONE_ABBREVIATIONS.get(w))
                if minutes is None or explicit[i]:
                    ok[i] = False
                else:
                    offset[i], explicit[i] = minutes * 60, True
    if has("sign"):
        if has("off4"):
            off = _ints(get("off4"))
            oh, om = off // 100, off % 100
        else:
            oh, om = _ints(get("oh")), _ints(get("om")) if has("om") else zero
        ok &= (oh <= 18) & (om < 60)
        sign = np.where(get("sign") == "-", -1, 1)
        # "GMT+01:00" and "Z" beside an offset: the offset counts.
        offset, explicit = sign * (oh * 3600 + om * 60), np.ones(n, dtype=bool)
    local = days * 86_400 + hour * 3600 + minute * 60 + second
    utc = local - offset
    if not explicit.all():
        if has("iana"):
            named = np.array(["".join(parts[i][k] for i in p.spans["iana"]) for k in range(n)], dtype=object)
        else:
            named = zones
        for zone in set(named[~explicit]):
            rows = (named == zone) & ~explicit if zone is not None else np.array([z is None for z in named]) & ~explicit
            converted = local_to_utc(zone, local[rows]) if zone else None
            if converted is None:
                ok[rows] = False
            else:
                utc[rows] = converted
    return utc * 1_000_000 + micro, ok


def parse_texts(texts: list[str | None], zones: list[str | None], countries: list[str | None]) -> list[int | None]:
    """Microseconds since 1970-01-01 UTC of each text, None where it denotes no existing instant.

    ``zones`` and ``countries`` say where each text is local. A text without zone and with an
    unknown ``zones`` entry gives None, as do words, placeholders and impossible dates.
    """
    zone_of = np.array(zones, dtype=object)
    country_of = np.array([c or "" for c in countries], dtype=object)
    result: list[int | None] = [None] * len(texts)
    groups: dict[str, list[int]] = {}
    trimmed: list[str] = []
    for i, text in enumerate(texts):
        t = "" if text is None else (text if text.isascii() else unicodedata.normalize("NFC", text)).strip(" \t\r\n\f\v ﻿​")
        trimmed.append(t)
        if t:
            groups.setdefault(mask_of(t), []).append(i)
    for mask, rows in groups.items():
        parser = parser_for(mask)
        if parser is None:
            continue
        micros, ok = _convert(parser, [trimmed[i] for i in rows], zone_of[rows], country_of[rows])
        for i, value, fine in zip(rows, micros.tolist(), ok.tolist(), strict=True):
            if fine:
                result[i] = value
    return result


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        clean = [[None if not isinstance(x, str) else x for x in pdf[c]] for c in ("published_at", "time_zone", "feed_country")]
        yield pd.DataFrame({"article_id": pdf["article_id"], "published_us": pd.array(parse_texts(*clean), dtype="Int64")})


def normalized_instants(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """``article_id, published_us``: one row per article whose published_at denotes an instant.

    Repeated deliveries give one row, the earliest instant if they differ. Null ids, null or
    empty texts and unknown zones give no row; other columns of
    either table are ignored, so they may have any name.
    """
    slim = articles.select("article_id", "outlet", "published_at").where("article_id is not null and published_at is not null")
    feed = feeds.select("outlet", "outlet_name", "host", "time_zone", F.upper(F.trim("country")).alias("feed_country"))
    resolved = with_standard_outlet(slim, feed, keep=["time_zone", "feed_country"])
    parsed = resolved.select("article_id", "published_at", "time_zone", "feed_country").mapInPandas(
        _parse_batches, "article_id string, published_us bigint"
    )
    return parsed.where("published_us is not null").groupBy("article_id").agg(F.min("published_us").alias("published_us"))


def zone_table(feeds: DataFrame) -> DataFrame:
    """The offset changes of the feeds' zones: ``time_zone, tz_version, from_utc_s, offset_s``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for zone in pdf["time_zone"]:
                if (found := transitions(zone)) is not None:
                    at, offsets = found
                    starts = np.concatenate([[np.iinfo(np.int64).min], at])
                    yield pd.DataFrame({"time_zone": zone, "tz_version": zone_version(), "from_utc_s": starts, "offset_s": offsets})

    zones = feeds.where("time_zone is not null").select("time_zone").distinct()
    return zones.mapInPandas(rows, "time_zone string, tz_version string, from_utc_s bigint, offset_s bigint")
