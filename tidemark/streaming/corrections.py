"""Bars from a stream whose ticks may come late: each change of a bar is a new revision of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the store for state that does not fit in memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

MINUTE, HOUR = 60_000_000, 3_600_000_000  # microseconds


def _start(at: Column, unit: int) -> Column:
    return at - F.pmod(at, F.lit(unit))


def correcting_bars(ticks: DataFrame, watermark: str = "1 day", keep_seconds: int = 0) -> DataFrame:
    """A stream of ticks (symbol, timestamp, price, size_shares) → minute and hour bars with a revision number.

    (symbol, level, date, OHLC, volume_shares, turnover_twd, trade_count, revision): in each micro-batch every bar that a tick has
    changed comes once, with the next revision; the largest revision of a bar is its state. Ticks may come in any order within
    the watermark; it stands on the hour, and state goes when it has passed the start of the hour by ``keep_seconds``. A tick later than
    that is dropped. Ticks of one instant open a bar with their smallest and close it with their largest price. Rows
    without symbol, time or price are left out; a missing size counts as 0.

    A tick counts for its minute and for its hour; both are one keyed aggregate, folded map-side before the shuffle, so a symbol with
    a third of all ticks sends one row per bar and map task. The state of a bar is its columns and the times of the micro-batches that
    changed it (8 bytes each; Spark keeps a batch's time in its log, so a batch that is run again counts once); their number is the revision.
    State is read and written inside Spark, no row goes to Python. ``STATE_STORE`` as
    spark.sql.streaming.stateStore.providerClass holds more of it than memory does; progress and state are in the query's checkpoint.
    """
    known = ticks.where("symbol is not null and timestamp is not null and price is not null and not isnan(price)").fillna(0, subset=["size_shares"])
    at = F.unix_micros(F.col("timestamp").cast("timestamp"))
    rows = known.select("symbol", at.alias("at"), F.col("price").cast("double").alias("price"), F.col("size_shares").cast("long").alias("size"))
    late = rows.withColumn("hour", F.timestamp_micros(_start(F.col("at"), HOUR))).withWatermark("hour", f"{watermark} {keep_seconds} seconds")
    bars = F.array(F.struct(F.lit("minute").alias("level"), _start(F.col("at"), MINUTE).alias("start")),
                   F.struct(F.lit("hour").alias("level"), _start(F.col("at"), HOUR).alias("start")))
    each = late.select("symbol", "hour", "at", "price", "size", F.current_timestamp().alias("batch"), F.inline(bars))
    folded = each.groupBy("symbol", "hour", "level", "start").agg(
        F.min(F.struct("at", "price")).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max(F.struct("at", "price")).alias("last"), F.sum("size").alias("volume_shares"),
        F.sum(F.col("price") * F.col("size")).alias("turnover_twd"), F.count(F.lit(1)).alias("trade_count"),
        F.collect_set("batch").alias("batches"))
    date = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, int(start div 60000000))")
    return folded.select(
        "symbol", "level", date.alias("date"), F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"),
        "volume_shares", "turnover_twd", "trade_count", F.size("batches").cast("long").alias("revision"))


def newest_revisions(bars: DataFrame) -> DataFrame:
    """The last state of each bar in a table of revisions."""
    columns = [c for c in bars.columns if c not in ("symbol", "level", "date")]
    return bars.groupBy("symbol", "level", "date").agg(F.max_by(F.struct(*columns), "revision").alias("_bar")).select("symbol", "level", "date", "_bar.*")
