"""Last known value in logs whose per-key length has no bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_known_before(df: DataFrame, key: list[str], order: str, value: Column, out: str,
                      chunk_rows: int = 1_000_000) -> DataFrame:
    """Add the last non-null ``value`` of strictly earlier rows of the same key.

    A single key may hold a large part of the log, so the scan runs in two levels:
    inside (key, chunk of ``order``), and over the one-row-per-chunk summaries.
    ``order`` is a number that is unique within a key.
    """
    work = df.withColumn("_value", value).withColumn("_chunk", F.floor(F.col(order) / chunk_rows))
    inside = Window.partitionBy(*key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        work.groupBy(*key, "_chunk")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
        .select(*key, "_chunk", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    )
    return (
        work.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, [*key, "_chunk"])
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_value", "_chunk", "_inside", "_carried")
    )
