"""Resolution of the spellings of an outlet to its standard code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagauge.functions.text import nfc_key


def outlet_keys(feeds: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per accepted spelling key of a feed: code, name, host, host with "www.".

    Columns ``outlet_key, std_outlet`` and those of ``keep``. A key that several feeds claim
    belongs to the smallest code, so a join never multiplies rows.
    """
    keep = keep or []
    spelled = feeds.select(
        F.col("outlet").alias("std_outlet"),
        *keep,
        F.explode(F.array("outlet", "outlet_name", "host", F.concat(F.lit("www."), F.col("host")))).alias("spelling"),
    )
    keyed = spelled.select(nfc_key("spelling").alias("outlet_key"), "std_outlet", *keep).where(
        "outlet_key is not null and outlet_key <> ''"
    )
    first = F.min(F.struct("std_outlet", *keep)).alias("s")
    return keyed.groupBy("outlet_key").agg(first).select("outlet_key", "s.*")


def with_standard_outlet(df: DataFrame, feeds: DataFrame, column: str = "outlet", keep: list[str] | None = None) -> DataFrame:
    """``df`` plus ``std_outlet`` (null if unknown) and the feed columns of ``keep``.

    The feed side has one row per spelling; Spark broadcasts it while its size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides beyond it.
    """
    keys = outlet_keys(feeds, keep)
    return df.withColumn("outlet_key", nfc_key(column)).join(keys, "outlet_key", "left").drop("outlet_key")
