"""Continuous profiles, ingest without repeats, and baselines as state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mediagauge import config as C
from mediagauge.functions.text import canonical_frame
from mediagauge.operators.profiles import unpivot_segments
from mediagauge.session import shared_dir


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive below a folder, or of one file by its name."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at)
    if status.isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def unique_by(stream: DataFrame, key: str, ts: str, delay: str = "30 days") -> DataFrame:
    """The first row of each key; a repeat later than ``delay`` behind the newest time is not known any more."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def windowed_profiles(stream: DataFrame, ts: str, width: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Weighted sums per window and segment; complete when the watermark has passed the window."""
    framed = stream.withColumn("frame", canonical_frame(F.col("dominant_frame"), C.FRAME_ALIASES))
    rows = unpivot_segments(framed.withWatermark(ts, delay), [ts, "article_id"])
    sums = [F.sum(F.col(k) * F.col("weight")).alias(f"sum_{k}") for k in C.SIGNALS]
    grouped = rows.groupBy(F.window(ts, width).alias("w"), "segment").agg(*sums, F.sum("weight").alias("weight"), F.count("*").alias("article_count"))
    means = [F.round(F.col(f"sum_{k}") / F.col("weight"), 4).alias(k) for k in C.SIGNALS]
    return grouped.select(F.col("w.start").alias("window_start"), "segment", *means, "article_count")


def fold_baselines(stream: DataFrame, start: dict[str, float]) -> DataFrame:
    """Baselines by segment as state: each profile with enough articles blends in, in time order within a batch."""
    out = "segment string, " + ", ".join(f"{k} double" for k in C.SIGNALS) + ", sample_count int"
    state = ", ".join(f"{k} double" for k in C.SIGNALS) + ", sample_count int"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        values = list(held.get) if held.exists else [*(start[k] for k in C.SIGNALS), 0]
        rows = pd.concat(list(batches)).sort_values("window_start")
        for _, r in rows[rows["article_count"] >= C.MIN_BASELINE_ARTICLES].iterrows():
            values = [*(round(C.EMA_OLD * v + C.EMA_NEW * r[k], 4) for v, k in zip(values, C.SIGNALS, strict=False)), values[-1] + 1]
        held.update(tuple(values))
        yield pd.DataFrame([[key[0], *values]], columns=["segment", *C.SIGNALS, "sample_count"])

    return stream.groupBy("segment").applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over everything that is there, then stop; the rows it put out, from the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    path, numbers = f"{base}/out", []

    def write(batch: DataFrame, number: int) -> None:
        if each:
            each(batch, number)
        # A batch that is run again after a failure overwrites what it wrote before.
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        numbers.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if not query.lastProgress or not numbers:
        return spark.createDataFrame([], stream.schema)
    # In complete mode every batch holds the whole result, so the last one counts.
    kept = numbers[-1:] if mode == "complete" else sorted(set(numbers))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/{n}" for n in kept])
