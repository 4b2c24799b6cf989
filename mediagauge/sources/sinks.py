"""Writers: insert-or-ignore, insert-or-replace, upsert, several tables at once, reports.

All of them are merges expressed as joins over keyed tables. Files are written to a new folder
and put in place at the end, so a failed write leaves the old table as it was.
"""

from __future__ import annotations

import json
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows, and of new keys the first new row in the given order. Null keys equal each other."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    a, b = first.alias("a"), existing.select(*keys).alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return existing.unionByName(a.join(b, same, "left_anti"), allowMissingColumns=True)


def insert_or_replace(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows replace existing ones of equal key; of several new rows the last in the given order counts."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), *order)
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], merge: dict[str, str]) -> DataFrame:
    """Full outer merge by key: ``merge`` says per column max, min, new (non-empty new value) or old."""
    a = existing.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in merge])
    b = new.groupBy(*keys).agg(*[(F.min if how == "min" else F.max)(c).alias(f"__new_{c}") for c, how in merge.items()])
    joined = a.join(b, keys, "full")
    out = []
    for c, how in merge.items():
        old, fresh = F.col(f"__old_{c}"), F.col(f"__new_{c}")
        if how in ("max", "min"):
            out.append((F.greatest if how == "max" else F.least)(old, fresh).alias(c))
        elif how == "new":
            out.append(F.coalesce(F.when(F.trim(fresh.cast("string")) != "", fresh), old).alias(c))
        else:
            out.append(F.coalesce(old, fresh).alias(c))
    return joined.select(*keys, *out)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_together(spark: SparkSession, tables: dict[str, DataFrame], root: str, run_id: str) -> None:
    """Write the tables of one run below ``root``, all or none; ``read_together`` reads them.

    Each write goes to a folder of its own; a run counts as written once its manifest is renamed
    into place, which is one step. The latest manifest of a run replaces earlier ones, a failed
    write leaves no trace but unread files, which are removed.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    data = f"{root}/data/{run_id}/{version}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{data}/{name}")
        draft = f"{root}/manifests/.draft-{version}"
        told = json.dumps({"run_id": run_id, "tables": {name: f"{data}/{name}" for name in tables}})
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(draft)
        source, fs = _fs(spark, draft)
        target, _ = _fs(spark, f"{root}/manifests/{run_id}@{version}")
        if not fs.rename(source, target):
            raise OSError(f"could not put the manifest of {run_id} in place")
    except BaseException:
        unread, fs = _fs(spark, data)
        fs.delete(unread, True)
        raise


def read_together(spark: SparkSession, root: str, name: str, run_id: str) -> DataFrame:
    """The table ``name`` of a run as its latest manifest has it; raises if the run was never written."""
    folder, fs = _fs(spark, f"{root}/manifests")
    found = sorted(f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName().startswith(f"{run_id}@")) if fs.exists(folder) else []
    if not found:
        raise LookupError(f"run {run_id} is not there")
    told = json.loads(spark.read.text(f"{root}/manifests/{found[-1]}").first()[0])
    return spark.read.parquet(told["tables"][name])


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace exactly the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_report(report: dict, path: str) -> None:
    """A small report as a readable JSON file."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(report, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
