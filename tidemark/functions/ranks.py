"""Cross-sectional ranking that never puts a whole cross-section into one task.

A date can hold as many rows as there are instruments, so a window partitioned
by date alone does not scale. Two forms replace it: a full average-tie rank by one
range shuffle, and a band that keeps only the best few names per date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import store_intermediate

SALTS = 256

# Rows up to which a table with a known bound is broadcast.
SMALL_TABLE = 1_000_000


def broadcast_if_bounded(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast hint for a table that cannot exceed ``rows`` rows, when that is few; else AQE decides by size."""
    return F.broadcast(df) if rows is not None and rows <= SMALL_TABLE else df


def missing_as_null(value: Column, kind: str) -> Column:
    """NaN is a missing value; other types have no NaN."""
    return F.when(~F.isnan(value), value) if kind in ("double", "float") else value


def average_rank(df: DataFrame, group: list[str], value: str, out: str, descending: bool = False) -> DataFrame:
    """Add the average-tie rank of ``value`` within ``group``; null and NaN values stay unranked."""
    return average_ranks(df, group, value, **{"down" if descending else "up": out})


def average_ranks(df: DataFrame, group: list[str], value: str, up: str | None = None, down: str | None = None) -> DataFrame:
    """Add the average-tie ranks of ``value`` within ``group``: ascending as column ``up``, descending as ``down``.

    Null and NaN values stay unranked; values are compared in their own type. One path for groups of any size. A range
    shuffle on (group, value, hash of the row) puts all rows in order; the hash lets Spark part even a
    value that many rows share. Ranks and ties inside a task's part of a group are windows over (group, part). Only the first
    and the last group of a part can go on in others: for these few, one small row per (group, part) tells what lies before
    a part and how the ties on its borders go on. ``df`` is read once
    and for the shuffle's sample; the rows with their local ranks are stored as a table in the checkpoint folder.
    """
    part = Window.partitionBy(*group, "_part")
    hashed = [c for c, kind in df.dtypes if not kind.startswith("map")]
    rows = df.select(*[c for c in df.columns if c not in (up, down)], missing_as_null(F.col(value), dict(df.dtypes)[value]).alias("_known"))
    placed = rows.repartitionByRange(*group, F.col("_known").asc_nulls_last(), F.xxhash64(*[c for c in hashed if c in rows.columns])).withColumn(
        "_part", F.spark_partition_id())
    local = store_intermediate(
        placed.withColumn("_rank", F.rank().over(part.orderBy(F.col("_known").asc_nulls_last())))
        .withColumn("_ties", F.count("_known").over(Window.partitionBy(*group, "_part", "_known")))
        .withColumn("_rows", F.count("_known").over(part)), "ranks")
    borders = _borders(local, group).select(
        *[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"), "_before", "_total", "_lo", "_hi", "_lo_mean", "_hi_mean")
    here = _all(*[F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group], F.col("_part") == F.col("_p"))
    joined = local.join(F.broadcast(borders), here, "left")  # two rows per part at most
    mean = F.when(F.col("_known") == F.col("_lo"), F.col("_lo_mean")).when(F.col("_known") == F.col("_hi"), F.col("_hi_mean")).when(
        F.col("_known").isNotNull(), F.coalesce("_before", F.lit(0)) + F.col("_rank") + (F.col("_ties") - 1) / F.lit(2.0))
    ranks = [mean.alias(up)] if up else []
    ranks += [(F.coalesce("_total", "_rows") + 1 - mean).alias(down)] if down else []
    return joined.select(*[c for c in df.columns if c not in (up, down)], *ranks)


def _borders(local: DataFrame, group: list[str]) -> DataFrame:
    """For the groups that stand in several parts: a row per part with what lies before it and the ranks of its least and largest value."""
    own = F.struct(*group)
    outer = local.groupBy("_part").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    outer = outer.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("g"))
    split = outer.groupBy("g").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(*[F.col(f"g.{c}").alias(f"_s_{c}") for c in group])
    known = local.where(F.col("_known").isNotNull()).join(
        F.broadcast(split), _all(*[F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in group]), "left_semi")
    ends = known.groupBy(*group, "_part").agg(
        F.first("_rows").alias("_rows"), F.min("_known").alias("_lo"), F.max("_known").alias("_hi"),
        F.min_by("_ties", "_rank").alias("_lo_ties"), F.max_by("_ties", "_rank").alias("_hi_ties"))
    whole = Window.partitionBy(*group)  # a row per part of a group
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).withColumn("_total", F.sum("_rows").over(whole))
    # a value on a border may go on in the next parts: its rows in all of them, and the place of the first
    sides = F.array_distinct(F.array(
        F.struct(F.col("_lo").alias("v"), F.col("_lo_ties").alias("ties"), (F.col("_before") + 1).alias("first")),
        F.struct(F.col("_hi").alias("v"), F.col("_hi_ties").alias("ties"), (F.col("_before") + F.col("_rows") - F.col("_hi_ties") + 1).alias("first"))))
    run = Window.partitionBy(*group, "_side.v")
    sides = ends.select(*group, "_part", "_before", "_total", "_lo", "_hi", F.explode(sides).alias("_side")).withColumn(
        "_mean", F.min("_side.first").over(run) + (F.sum("_side.ties").over(run) - 1) / F.lit(2.0))
    return sides.groupBy(*group, "_part").agg(
        F.first("_before").alias("_before"), F.first("_total").alias("_total"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"),
        F.min("_mean").alias("_lo_mean"), F.max("_mean").alias("_hi_mean"))


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for condition in conditions[1:]:
        out = out & condition
    return out


def best_rows(df: DataFrame, group: list[str], order: list[Column], rows: int, out: str = "pos") -> DataFrame:
    """The first ``rows`` rows of each group with their position.

    Spark cuts each map task to ``rows`` per group before the shuffle, so a group
    of any size reaches its task as at most ``rows`` rows per map task. Beyond the
    limit up to which Spark does that, rows are first cut in parts by a hash of the row, with the same result.
    """
    if rows > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        hashed = [c for c, kind in df.dtypes if not kind.startswith("map")]
        salt = F.pmod(F.xxhash64(*hashed), F.lit(SALTS))
        part = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_part", F.row_number().over(part))
        df = df.where(F.col("_part") <= rows).drop("_salt", "_part")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= rows)


def best_band(df: DataFrame, group: list[str], value: str, tiebreak: str, band: int,
              score: Column | None = None) -> DataFrame:
    """Rows that can have an average-tie rank of at most ``band``, with that rank.

    Sorted by ``score`` (default: ``value`` ascending) and ``tiebreak``, only the
    first ``2·band + 1`` rows are kept. A tie group cut by that limit reaches from
    some position m to beyond 2·band + 1, so its average is above ``band`` whether
    or not the missing rows are counted: the test ``avg_rank <= band`` is exact.
    """
    key = F.col(value) if score is None else score
    present = missing_as_null(F.col(value), dict(df.dtypes)[value]).isNotNull()
    kept = best_rows(
        df.where(present).withColumn("_score", key),
        group, [F.col("_score"), F.col(tiebreak)], 2 * band + 1,
    )
    ties = Window.partitionBy(*group, "_score")
    return kept.withColumn("avg_rank", F.avg(F.col("pos").cast("double")).over(ties)).drop("_score")
