"""Update runs over all symbols at once: daily, hourly, instruments, backfill."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.listing import backfill_plan, clip_at_delisting, existing_years
from tidemark.operators.quality import quality_report
from tidemark.operators.reconcile import compare_sources
from tidemark.schemas import empty, require_columns
from tidemark.sources.store import PanelStore


@dataclass(frozen=True)
class UpdateResult:
    """Per-symbol row counts, source mismatches and quality issues of one run, as DataFrames."""

    counts: DataFrame
    mismatches: DataFrame | None = None
    issues: DataFrame | None = None


def run_daily(store: PanelStore, bars: DataFrame, provider: str, official: DataFrame | None = None,
              write_raw: bool = True, check_quality: bool = True) -> UpdateResult:
    """Store normalised daily bars of all symbols, then compare with a second source and check quality."""
    require_columns(bars, "daily")
    if write_raw:
        store.write_raw(provider, "daily", bars)
    store.write("daily", bars)
    store.register_views(("daily",))
    return UpdateResult(
        counts=bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")),
        mismatches=None if official is None else compare_sources(bars, official),
        issues=quality_report(bars) if check_quality else None,
    )


def run_hourly(store: PanelStore, bars: DataFrame, provider: str, write_raw: bool = True) -> UpdateResult:
    require_columns(bars, "hourly")
    if write_raw:
        store.write_raw(provider, "hourly", bars)
    store.write("hourly", bars)
    return UpdateResult(counts=bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")))


def run_instruments(store: PanelStore, instruments: DataFrame) -> int:
    """Upsert the instrument list by symbol; returns the number of delivered rows."""
    delivered = instruments.count()
    if delivered:
        store.write_reference("instrument", instruments, ["symbol"])
    return delivered


def stored_years(store: PanelStore, tables: list[str]) -> DataFrame:
    """(table, symbol, year) already in the store."""
    found = empty(store.spark, "daily").select(
        F.lit("").alias("table"), "symbol", F.year("date").alias("year")
    )
    for table in tables:
        found = found.unionByName(existing_years(table, store.read(table)))
    return found


def plan_backfill(store: PanelStore, spans: DataFrame, tables: list[str],
                  delistings: DataFrame | None = None) -> DataFrame:
    """Work items that are still missing. With delistings, only delisted symbols, each up to its last day."""
    wanted = spans if delistings is None else clip_at_delisting(spans, delistings)
    return backfill_plan(wanted, tables, stored_years(store, tables))


def load_backfill(store: PanelStore, table: str, normalized: DataFrame, plan: DataFrame) -> DataFrame:
    """Store the landed rows that belong to planned items; returns the items that brought no row.

    Rows outside their item's dates are ignored, so a re-used code cannot leak in after a
    delisting. Items left over are simply planned again by the next run.
    """
    items = plan.where(F.col("table") == table)
    rows = normalized.withColumn("year", F.year("date")).join(
        items.select("symbol", "year", "seg_start", "seg_end"), ["symbol", "year"]
    ).where(F.col("date").between(F.col("seg_start"), F.col("seg_end")))
    store.write(table, rows.select(*normalized.columns))
    arrived = existing_years(table, store.read(table))
    return items.join(arrived, ["table", "symbol", "year"], "left_anti")
