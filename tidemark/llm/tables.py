"""Where the operators keep intermediate tables, and connected components over stored edges."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where it is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="llm-")
    context.setCheckpointDir(folder)
    return folder


def give_back() -> None:
    """Hand memory that this Python process has freed back to the system; workers live on between tasks and stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def unused(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores in front as make it none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: tasks import it there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), f"{os.path.basename(top)}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(top)))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    The plan up to here runs once and a lost executor costs a re-read. The files of a
    session go when its Python process ends (``drop_stored`` removes them earlier).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stored() -> None:
    """Remove the intermediate tables written so far; results that still read them become invalid."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session is gone: the folder's own retention removes the files
            return


atexit.register(drop_stored)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id over undirected ``edges`` (a, b).

    Alternates two star steps: every node hands its larger neighbours, then its smaller
    ones, to its smallest neighbour. Both are grouped minima followed by a join on the
    node, so a node with very many edges is summed map-side and its rows can be split. Each
    round is written to the shared folder. An empty input gives an empty table.
    """
    pairs = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    pairs = stored(pairs, "edges")
    for _ in range(most_rounds):
        # large star: every larger neighbour of v moves to the smallest id around v
        both = pairs.select(F.col("lo").alias("v"), F.col("hi").alias("u")).union(
            pairs.select(F.col("hi").alias("v"), F.col("lo").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = (both.where("u > v").join(low, "v").where("u <> m")
                 .select(F.col("m").alias("lo"), F.col("u").alias("hi")).distinct())
        # small star: every smaller neighbour of v, and v itself, moves to the smallest of them
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(root, "hi")
        small = moved.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(
            root.select(F.col("m").alias("lo"), "hi")).distinct()
        after = stored(small, "edges")
        same = (pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h"))
                .union(after.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")))).collect())
        pairs = after
        if same[0] == same[1]:
            return pairs.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(
                pairs.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
    raise RuntimeError("components did not settle")
