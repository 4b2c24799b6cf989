"""Readers of feeds, pages, catalogs and label files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge.functions.text import collapse_space, normalize_url

#: Paragraphs and characters of a page's body text.
MAX_PARAGRAPHS, MAX_BODY = 20, 6_000


def page_text(html: Column) -> Column:
    """Text of a page's first paragraphs: tags and entities removed, white space collapsed."""
    blocks = F.slice(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), 1, MAX_PARAGRAPHS)
    bare = F.transform(blocks, lambda b: collapse_space(F.regexp_replace(F.regexp_replace(b, r"(?s)<[^>]*>", " "), r"&#?\w+;", " ")))
    return F.substring(F.array_join(F.filter(bare, lambda b: b != ""), " "), 1, MAX_BODY)


_ITEM = "outlet string, title string, url string, summary string, published_at string, ok boolean"


def read_feeds(raw: DataFrame) -> DataFrame:
    """Items of RSS 2.0 and Atom documents (outlet, xml); a feed that cannot be parsed gives one row with ok false.

    The documents are landed by any fetcher; parsing is a map over them, one feed a row.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xml.etree import ElementTree

        local = lambda tag: tag.rsplit("}", 1)[-1].lower()
        for pdf in batches:
            rows = []
            for outlet, xml in zip(pdf["outlet"], pdf["xml"], strict=True):
                try:
                    if "<!DOCTYPE" in (xml or "") or "<!ENTITY" in (xml or ""):
                        raise ValueError("document types are not accepted")
                    tree = ElementTree.fromstring(xml or "")
                except (ElementTree.ParseError, ValueError):
                    rows.append((outlet, None, None, None, None, False))
                    continue
                for item in (e for e in tree.iter() if local(e.tag) in ("item", "entry")):
                    parts: dict[str, str | None] = {}
                    for child in item:
                        parts.setdefault(local(child.tag), child.get("href") or (child.text or "").strip() or None)
                    rows.append((outlet, parts.get("title"), parts.get("link"), parts.get("description") or parts.get("summary"), parts.get("pubdate") or parts.get("published") or parts.get("updated"), True))
            yield pd.DataFrame(rows, columns=["outlet", "title", "url", "summary", "published_at", "ok"])

    return raw.select("outlet", "xml").mapInPandas(parse, _ITEM)


def with_article_id(items: DataFrame) -> DataFrame:
    """Items with canonical_url and article_id, its hash."""
    return items.withColumn("canonical_url", normalize_url(F.col("url"))).withColumn("article_id", F.sha2("canonical_url", 256))


def feed_catalog(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Catalog records with defaults; of equal outlets, then of equal normalised URLs, the first stays."""
    rows = [
        (i, str(r["outlet"]).strip(), r["rss_url"], r.get("affinity_tag") or "mainstream", str(r.get("country") or "GLOBAL").upper(), str(r.get("language") or "en").lower(), str(r.get("enabled", True)).lower() in ("true", "1", "yes", "on"))
        for i, r in enumerate(records)
    ]
    df = spark.createDataFrame(rows, "pos int, outlet string, rss_url string, affinity_tag string, country string, language string, enabled boolean")
    by_outlet = df.groupBy("outlet").agg(F.min_by(F.struct(*df.columns), "pos").alias("r")).select("r.*")
    by_url = by_outlet.groupBy(normalize_url(F.col("rss_url")).alias("k")).agg(F.min_by(F.struct(*df.columns), "pos").alias("r")).select("r.*")
    return by_url.orderBy("pos").drop("pos")


def yaml_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog from a YAML file with a list ``feeds``; needs a YAML library."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a YAML catalog needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        return feed_catalog(spark, (yaml.safe_load(f) or {}).get("feeds", []))


def enabled_feeds(feeds: DataFrame, country: str | None = None, outlet: str | None = None) -> DataFrame:
    """Enabled feeds, of a country or outlet if given, whatever the case."""
    df = feeds.where("enabled")
    if country:
        df = df.where(F.upper(F.trim("country")) == country.strip().upper())
    return df.where(F.lower("outlet") == outlet.strip().lower()) if outlet else df


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; all columns are text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_json_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of a JSON document: a list, an object with labels, predictions, signals, records or items, or a map by id.

    ``record`` is the DDL of one record; a map's key becomes ``record_id``.
    """
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json(F.when(F.ltrim("value").startswith("["), F.col("value")), f"array<struct<{record}>>")
    rows = text.select(F.explode(listed).alias("r")).select("r.*", F.lit(None).cast("string").alias("record_id"))
    for name in ("labels", "predictions", "signals", "records", "items"):
        inner = F.from_json(F.get_json_object("value", f"$.{name}"), f"array<struct<{record}>>")
        rows = rows.unionByName(text.select(F.explode(inner).alias("r")).select("r.*", F.lit(None).cast("string").alias("record_id")))
    keyed = F.from_json(F.when(F.ltrim("value").startswith("{"), F.col("value")), f"map<string, struct<{record}>>")
    envelope = ["labels", "predictions", "signals", "records", "items"]
    by_id = text.select(F.explode(keyed)).where(~F.col("key").isin(*envelope)).select("value.*", F.col("key").alias("record_id"))
    return rows.unionByName(by_id)


def read_jsonl(spark: SparkSession, path: str, record: str) -> DataFrame:
    """One object a line; a line that is none has nulls and its text in ``_corrupt_record``."""
    return spark.read.schema(record + ", _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def read_markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """``row, cells`` of the pipe table in a Markdown file, header (row 0) first, separator left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    table = lines.where(F.trim("value").startswith("|") & ~F.trim("value").rlike(r"^\|[\s:|-]+\|?$")).select("line", cells.alias("cells"))
    from pyspark.sql import Window

    return table.withColumn("row", F.row_number().over(Window.orderBy("line")) - 1).select("row", "cells")


def fenced_json(c: Column, schema: str) -> Column:
    """Object in a text that may be wrapped in a Markdown fence or surrounded by words; null if there is none."""
    return F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema)


def json_vector(c: Column) -> Column:
    """Array of doubles from a JSON list; null if it is none."""
    return F.from_json(c, "array<double>")
