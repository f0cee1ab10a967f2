"""Session defaults and the few settings the library reads from a session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

UTC = "UTC"


def build(app: str = "leadloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for.

    The shuffle partition count is only a starting point: adaptive execution
    joins small partitions and splits skewed ones at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": UTC,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Naive timestamps are UTC everywhere in this library."""
    if spark.conf.get("spark.sql.session.timeZone") != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)
    return spark


_LOCAL_BASE: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only a session whose tasks run inside the driver (``local[n]``) may do without: it gets a folder of its own.
    Anywhere else a missing setting is an error, since executors would each write to their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_BASE:
        _LOCAL_BASE.append(tempfile.mkdtemp(prefix="leadloom-"))
    return _LOCAL_BASE[0]


def _on_exit(spark: SparkSession, folder: str) -> None:
    """Let the driver delete the folder when it ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder for intermediate tables on the shared storage; deleted when the driver ends."""
    folder = f"{shared_base(spark)}/{label}-{uuid.uuid4().hex}"
    _on_exit(spark, folder)
    return folder


#: Shuffle files of a finished query go at once instead of with the driver's next garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table that is read more than once to the shared folder, as parquet, and read it back.

    Parquet prunes columns and keeps statistics, and the rows survive lost executors.  The shuffle files of the write
    are dropped when it ends: the table stands for them.
    """
    spark = df.sparkSession
    folder, before = shared_folder(spark, label), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Stage a table so later steps neither recompute it nor depend on single executors."""
    return stage(df, "rows")
