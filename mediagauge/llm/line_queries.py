"""Queries on lines that recur within one outlet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mediagauge.llm.lines import cleaned_bodies, line_templates, repeated_lines
from mediagauge.tables import table


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines that recur in a large share of their outlet's articles."""
    return repeated_lines(table(spark, root, "articles"), table(spark, root, "feeds"))


def p5_cleaned(spark: SparkSession, root: str) -> DataFrame:
    """Each body without its recurring lines."""
    return cleaned_bodies(table(spark, root, "articles"), table(spark, root, "feeds"))


def p5_templates(spark: SparkSession, root: str) -> DataFrame:
    """The recurring templates of every outlet."""
    return line_templates(table(spark, root, "articles"), table(spark, root, "feeds"))


_SPACE = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQL = {
    "p5_found": rf"""
with keys as (
  select lower(trim(nfc_normalize(s))) as k, min(outlet) as std from (
    select outlet, unnest([outlet, outlet_name, host, 'www.' || host]) as s from feeds) group by 1),
one as (
  select a.article_id, max(k.std) as std, max(a.body) as body
  from articles a join keys k on lower(trim(nfc_normalize(a.outlet))) = k.k where a.article_id is not null group by 1),
lines as (
  select article_id, std, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as line_no
  from one where body is not null),
keyed as (
  select article_id, std, line_no,
    regexp_replace(lower(trim(regexp_replace(nfc_normalize(line), '{_SPACE}', ' ', 'g'))), '[0-9]+', '#', 'g') as k from lines),
totals as (select std, count(*) as total from one group by 1),
frequent as (
  select std, k from (select std, k, count(distinct article_id) as n from keyed where k <> '' group by 1, 2) join totals using (std)
  where n >= 4 and n * 20 >= total)
select article_id, line_no from keyed join frequent using (std, k)
"""
}
QUERIES = {"p5_found": p5_found, "p5_cleaned": p5_cleaned, "p5_templates": p5_templates}
