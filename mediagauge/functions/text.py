"""Text helpers: JVM-side column expressions, and Arrow-batched ones where Spark has no built-in."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A memo of a Python worker is emptied when it holds this many entries.
MEMO_LIMIT = 100_000


def strip_space(c: Column) -> Column:
    """``c`` without leading and trailing white space, no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold_key(c: Column) -> Column:
    """Trimmed, lower-case form under which labels and annotators are compared."""
    return F.lower(strip_space(c))


@F.pandas_udf(StringType())
def nfc_key(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFC, trimmed, lower-case form under which outlet spellings are compared."""
    memo: dict = {None: None}
    for s in batches:
        out = []
        for x in s:
            y = memo.get(x, memo)
            if y is memo:
                y = unicodedata.normalize("NFC", x).strip().lower()
                if len(memo) >= MEMO_LIMIT:
                    memo = {None: None}
                memo[x] = y
            out.append(y)
        yield pd.Series(out, dtype=object)


def clip_words(c: Column, limit: int) -> Column:
    """Collapsed text; if longer than ``limit``, cut at the last space before it, plus ``...``."""
    text = collapse_space(c)
    head = F.regexp_replace(F.substring(text, 1, limit), r" [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(head), F.lit("...")))


#: Latin letters whose decomposition (NFKD without marks) is another string, up to U+024F, by rule.
def _plain_letters() -> tuple[str, str]:
    source, target = [], []
    for code in range(0xC0, 0x250):
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _plain_letters()


def strip_marks(c: Column) -> Column:
    """Latin letters without diacritics, composed or decomposed, inside generated code."""
    return F.translate(F.regexp_replace(c, r"\p{M}+", ""), _ACCENTED, _PLAIN)


def normalize_topic(c: Column) -> Column:
    """Lookup form of a topic: lower case, no diacritics, everything but words one blank."""
    plain = strip_marks(F.lower(strip_space(c)))
    words = F.regexp_replace(F.regexp_replace(plain, "[_-]+", " "), r"(?U)[^\w\s]", " ")
    return collapse_space(words)


def slugify(c: Column) -> Column:
    """Topic as a slug; ``topic`` if nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(normalize_topic(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "topic").otherwise(slug)


def display_name(c: Column) -> Column:
    """Topic for display: hyphens to blanks, first letter upper case; ``Topic`` if empty."""
    text = collapse_space(F.regexp_replace(strip_space(c), "-", " "))
    return F.when(text == "", "Topic").otherwise(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000)))


def title_key(c: Column) -> Column:
    """Words of a title in lower case; null unless it has 12 characters and two words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))
    key = F.array_join(words, " ")
    return F.when((F.length(key) >= 12) & (F.size(words) >= 2), key)


def token_set(c: Column, stopwords: list[str]) -> Column:
    """Distinct lower-case words of over one character that are no number and no stop word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$") & ~F.array_contains(stop, w))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def sentences(c: Column) -> Column:
    """Sentences of a collapsed text."""
    return F.filter(F.split(collapse_space(F.coalesce(c, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")


def embedding_text(title: Column, body: Column, summary: Column, boilerplate: list[str]) -> Column:
    """Title and the first two telling sentences of the body, or of the summary if there is no body.

    Sentences under 20 characters or with a boilerplate phrase do not count; under ten characters
    in all the text is null.
    """
    blank = F.lit("")
    own = collapse_space(F.coalesce(body, blank))
    lead = F.when(own != "", own).otherwise(collapse_space(F.coalesce(summary, blank)))

    def telling(s: Column) -> Column:
        fine = F.length(s) >= 20
        for phrase in boilerplate:
            fine = fine & ~F.lower(s).contains(phrase)
        return fine

    told = F.slice(F.filter(sentences(lead), telling), 1, 2)
    head = collapse_space(F.coalesce(title, blank))
    text = F.trim(F.concat_ws(" - ", F.when(head != "", head), F.when(F.size(told) > 0, F.array_join(told, " "))))
    return F.when(F.length(text) >= 10, text)


def canonical_frame(c: Column, aliases: dict[str, str]) -> Column:
    """Frame of a spelling: trimmed, lower case, hyphens and blanks to underscores; null or empty is neutral."""
    key = F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")
    table = F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])
    return F.when(c.isNull() | (c == ""), "neutral").otherwise(F.coalesce(F.try_element_at(table, key), key))


def normalize_url(c: Column) -> Column:
    """Host in lower case, path without closing slash, query; null for what is no URL."""
    host, path, query = (F.try_parse_url(c, F.lit(part)) for part in ("HOST", "PATH", "QUERY"))
    return F.concat(F.lower(host), F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))


def keyword_domain(c: Column, rules: dict[str, list[str]], default: str) -> Column:
    """Domain of the first rule with a keyword in the topic."""
    text, out = F.lower(F.trim(c)), None
    for domain, words in rules.items():
        test = None
        for w in words:
            test = text.contains(w) if test is None else test | text.contains(w)
        out = F.when(test, domain) if out is None else out.when(test, domain)
    return out.otherwise(default)


def age_days(ts: Column, as_of: Column) -> Column:
    """Whole days before ``as_of``, at least 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(ts)) / 86_400).cast("int"))


def _mapped(c: Column, table: dict[str, str]) -> Column:
    """The value that ``table`` has for c, null if none."""
    return F.get(F.map_values(F.map_filter(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), lambda k, _: k == c)), 0)


def canonical_segment(c: Column, aliases: dict[str, str]) -> Column:
    """A segment's name without brackets, in snake case, through the aliases; empty for null."""
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", ""))), r"[- ]", "_")
    key = F.regexp_replace(bare, "[^a-z0-9_]", "")
    return F.coalesce(_mapped(key, aliases), key)


def canonical_drift_type(c: Column, aliases: dict[str, str]) -> Column:
    """A drift type through the aliases; of several types divided by | or / the first known one; empty for null."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[- ]", "_"), "[^a-z0-9_|/]", "")
    parts = F.transform(F.split(key, r"[|/]+"), lambda p: F.trim(p, F.lit("_")))
    known = F.filter(F.transform(parts, lambda p: _mapped(p, aliases)), lambda p: p.isNotNull())
    return F.coalesce(_mapped(key, aliases), F.get(known, 0), key)
