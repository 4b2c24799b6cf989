"""Session defaults and tables that cut lineage.

Intermediate results that are read more than once are written as Parquet into the folder
that ``spark.checkpoint.dir`` names, which all executors share, so a lost executor never
loses them. Only a local master may fall back to a temporary folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def build_session(app: str = "mediagauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; raises on a cluster that names none."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _local_dirs:
        holder = tempfile.TemporaryDirectory(prefix="mediagauge-")
        atexit.register(holder.cleanup)
        _local_dirs[key] = "file://" + holder.name
    return _local_dirs[key]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The schema is kept, an empty input gives an empty table.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``materialize`` that nothing reads any more."""
    spark = df.sparkSession
    base = shared_dir(spark).split("://", 1)[-1]
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for parent in parents:
        if base.lstrip("/") not in parent:
            continue
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
