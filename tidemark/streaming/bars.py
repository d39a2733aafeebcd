"""Ticks to bars and sessions, on batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.store import PanelStore
from tidemark.sources.versions import VersionedStore


def _with_watermark(ticks: DataFrame, delay: str) -> DataFrame:
    """Event time has to be an instant for a watermark; local times are read in the session zone."""
    return ticks.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark("timestamp", delay)


def ticks_to_bars(ticks: DataFrame, interval: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """(symbol, timestamp, price, size_shares) → bars labelled by the start of their interval.

    All aggregates combine map-side, so a symbol with a third of all ticks sends one
    row per interval and map task. With a watermark the same plan runs on a stream and
    closes a bar once the watermark has passed its end.
    """
    source = _with_watermark(ticks, watermark) if watermark else ticks
    return source.groupBy("symbol", F.window("timestamp", interval).alias("_w")).agg(
        F.min_by("price", "timestamp").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "timestamp").alias("close"),
        F.sum("size_shares").alias("volume_shares"),
        F.sum(F.col("price") * F.col("size_shares")).alias("turnover_twd"),
        F.count(F.lit(1)).alias("trade_count"),
    ).select(
        "symbol", F.col("_w.start").cast("timestamp_ntz").alias("date"), "open", "high", "low", "close",
        "volume_shares", "turnover_twd", "trade_count",
    )


def sessions(ticks: DataFrame, gap_seconds: int) -> DataFrame:
    """(symbol, session_start, session_end, n, total): spells without a pause of ``gap_seconds`` or more.

    Two ticks in the same cell of ``gap_seconds`` are always closer than the gap, so
    ticks are first folded into cells, map-side and without sorting. Sessions are then
    chains of cells; a symbol has at most one cell per ``gap_seconds`` of calendar
    time, however many ticks it has.
    """
    at = F.col("timestamp")
    of_day = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    cell = F.floor((F.unix_date(F.to_date(at)).cast("long") * 86400 + of_day) / gap_seconds)
    cells = ticks.groupBy("symbol", cell.alias("_cell")).agg(
        F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"),
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"),
    )
    series = Window.partitionBy("symbol").orderBy("_cell")
    pause_over = F.col("_first") >= F.lag("_last").over(series) + F.expr(f"interval {gap_seconds} seconds")
    spell = F.sum(F.coalesce(F.col("_new"), F.lit(False)).cast("int")).over(
        series.rowsBetween(Window.unboundedPreceding, 0)
    )
    return cells.withColumn("_new", pause_over).withColumn("_spell", spell).groupBy("symbol", "_spell").agg(
        F.min("_first").alias("session_start"), F.max("_last").alias("session_end"),
        F.sum("n").alias("n"), F.sum("total").alias("total"),
    ).drop("_spell")


def stream_sessions(ticks: DataFrame, gap: str, watermark: str) -> DataFrame:
    """The streaming twin of :func:`sessions`: state per open session, emitted when the watermark passes."""
    return _with_watermark(ticks, watermark).groupBy(
        "symbol", F.session_window("timestamp", gap).alias("_w")
    ).agg(
        F.min("timestamp").cast("timestamp_ntz").alias("session_start"),
        F.max("timestamp").cast("timestamp_ntz").alias("session_end"),
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"),
    ).drop("_w")


def deduplicate(ticks: DataFrame, key: list[str], watermark: str) -> DataFrame:
    """Drop re-delivered ticks that arrive within the watermark of the first one."""
    return _with_watermark(ticks, watermark).dropDuplicatesWithinWatermark(key)


def upsert_stream(bars: DataFrame, store: PanelStore, table: str, checkpoint: str,
                  available_now: bool = True) -> StreamingQuery:
    """Write a stream of keyed rows into the store; a batch that is run again overwrites its own keys.

    Progress is kept in ``checkpoint``, so a restarted query continues after the last
    finished batch. A versioned store takes each batch of a checkpoint once and writes no more than its rows.
    """
    def deliver(batch: DataFrame, number: int) -> None:
        if isinstance(store, VersionedStore):
            store.write(table, batch, token=f"{checkpoint}#{number}")
        else:
            store.write(table, batch)

    writer = bars.writeStream.foreachBatch(deliver)
    writer = writer.option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
