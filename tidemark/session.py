"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    AQE coalesces small shuffle partitions and splits skewed join partitions at
    run time, so no operator hard-codes a partition count.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; where it names none and Spark is one process, one in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate").rstrip("/")


def intermediate_folder(spark: SparkSession) -> str:
    """The application's own part of the checkpoint folder; it is removed at the end."""
    folder = f"{checkpoint_folder(spark)}/tidemark-{spark.sparkContext.applicationId}"
    _FOLDERS[folder] = spark
    return folder


def store_intermediate(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and return the stored table.

    For results that several later steps read: the plan before it runs once, later
    scans still prune columns, and a lost executor costs a re-read, not a recomputation.
    The application's folder goes when the Python process ends, or with ``drop_intermediates``.
    """
    spark = df.sparkSession
    path = f"{intermediate_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_FOLDERS: dict[str, SparkSession] = {}


def drop_intermediates() -> None:
    """Remove what ``store_intermediate`` has written; results that still read it become invalid."""
    while _FOLDERS:
        folder, spark = _FOLDERS.popitem()
        context = spark.sparkContext
        if context._jsc is None:  # stopped: the folder's own retention removes the files
            continue
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


atexit.register(drop_intermediates)
