"""Queries that run as streams over everything that is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.plans import sqltext as S
from mediagauge.streaming.profiles import read_stream, run_available, unique_by, windowed_profiles
from mediagauge.tables import table


def _stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_stream(spark, f"{root.rstrip('/')}/{name}.parquet", table(spark, root, name).schema)


def stream_profile(spark: SparkSession, root: str) -> DataFrame:
    """Weekly segment profiles over all signal rows, as a windowed stream that keeps late rows."""
    stream = windowed_profiles(_stream(spark, root, "signals"), "extracted_at", "7 days", "2000 days")
    return run_available(stream, "complete")


def stream_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Events per type after repeats of an event_id were dropped by the stream."""
    rows = run_available(unique_by(_stream(spark, root, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")), "event_id", "ts"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))


_MEANS = ", ".join(f"round(sum({k} * weight) / sum(weight), 4) as {k}" for k in C.SIGNALS)
SQL = {
    "stream_profile": f"""with raw as (select *, 'x' as frame, time_bucket(interval 7 day, extracted_at at time zone 'UTC', timestamp '1970-01-01') as window_start from signals),
        {S.segments("raw", "window_start")} select window_start, segment, {_MEANS}, count(*) as article_count from seg group by all""",
    "stream_ingest": "select event_type, count(distinct event_id) as n from events group by 1",
}
QUERIES = {f.__name__: f for f in (stream_profile, stream_ingest)}
