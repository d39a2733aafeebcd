"""Listing history: seen log, listing intervals, delistings and fetch plans."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import best_rows

# Default gap between listings and first days of a month to probe.
GAP_DAYS, INACTIVE_DAYS, ACTIVE_DAYS, PROBE_DAYS = 90, 90, 30, 12
OFFICIAL, SAMPLED = "twse_terminated", "mi_index_sampling"


def latest_event_asof(seen: DataFrame, events: DataFrame, out: str = "event_date") -> DataFrame:
    """Backward as-of join: the latest event on or before each row's ``seen_date``, by symbol.

    Both sides pass through one shuffle by symbol; an event sorts before a row of
    the same date, so equality counts as a match. Events are unique per (symbol,
    date) and rows per (symbol, sample date), so a symbol's group is day-bounded.
    """
    marked = events.select("symbol", F.col("delist_date").alias("seen_date")).distinct().where(
        F.col("seen_date").isNotNull()
    ).withColumns({"_side": F.lit(0), "_event": F.col("seen_date")})
    rows = seen.withColumns({"_side": F.lit(1), "_event": F.lit(None).cast("date")})
    so_far = (
        Window.partitionBy("symbol").orderBy("seen_date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = rows.unionByName(marked, allowMissingColumns=True).withColumn(
        out, F.last("_event", ignorenulls=True).over(so_far)
    )
    return joined.where(F.col("_side") == 1).drop("_side", "_event")


def listing_intervals(seen: DataFrame, gap_days: int = GAP_DAYS, delistings: DataFrame | None = None) -> DataFrame:
    """(symbol, name, first_seen, last_seen, n_days) per listing spell.

    Without delistings a spell ends at a gap of more than ``gap_days``. With them it
    ends only where a delisting falls between two sightings, so a suspension does not
    split a company. The name is the one seen last.
    """
    by_symbol = Window.partitionBy("symbol").orderBy("seen_date")
    if delistings is None:
        rows = seen
        breaks = F.datediff("seen_date", F.lag("seen_date").over(by_symbol)) > gap_days
    else:
        rows = latest_event_asof(seen, delistings)
        breaks = ~F.col("event_date").eqNullSafe(F.lag("event_date").over(by_symbol)) & F.lag("seen_date").over(
            by_symbol
        ).isNotNull()
    spell = F.sum(F.coalesce(F.col("_break"), F.lit(False)).cast("int")).over(
        by_symbol.rowsBetween(Window.unboundedPreceding, 0)
    )
    marked = rows.withColumn("_break", breaks).withColumn("_spell", spell)
    return marked.groupBy("symbol", "_spell").agg(
        F.max_by("name", "seen_date").alias("name"),
        F.min("seen_date").alias("first_seen"),
        F.max("seen_date").alias("last_seen"),
        F.count(F.lit(1)).alias("n_days"),
    ).select("symbol", "name", "first_seen", "last_seen", "n_days")


def delisted_candidates(intervals: DataFrame, as_of: Column | date, active: DataFrame | None = None,
                        inactive_days: int = INACTIVE_DAYS) -> DataFrame:
    """Spells last seen before ``as_of − inactive_days`` whose symbol is not active."""
    cutoff = F.date_sub(as_of if isinstance(as_of, Column) else F.lit(as_of), inactive_days)
    gone = intervals.where(F.col("last_seen") < cutoff)
    if active is not None:
        gone = gone.join(active.select("symbol"), "symbol", "left_anti")
    return gone


def active_symbols(instruments: DataFrame, as_of: Column | date, within_days: int = ACTIVE_DAYS) -> DataFrame:
    """Symbols whose newest snapshot is at most ``within_days`` old; all symbols without snapshot dates."""
    if "snapshot_date" not in instruments.columns:
        return instruments.select("symbol").distinct()
    cutoff = F.date_sub(as_of if isinstance(as_of, Column) else F.lit(as_of), within_days)
    newest = instruments.groupBy("symbol").agg(F.max("snapshot_date").alias("latest"))
    return newest.where(F.col("latest") >= cutoff).select("symbol")


def merge_delisted(official: DataFrame | None, sampled: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """One row per delisted symbol, official rows before sampled ones, active symbols removed.

    A missing official list counts as empty. Ordered by date (nulls last) and symbol.
    """
    rows = sampled.select(
        "symbol", "name", F.lit(None).cast("date").alias("delist_date"), F.lit(SAMPLED).alias("source")
    )
    if official is not None:
        rows = official.select("symbol", "name", "delist_date", F.lit(OFFICIAL).alias("source")).unionByName(rows)
    if active is not None:
        rows = rows.join(active.select("symbol"), "symbol", "left_anti")
    order = [(F.col("source") == OFFICIAL).desc(), F.col("delist_date").asc_nulls_last(), F.col("name")]
    first = best_rows(rows, ["symbol"], order, 1).drop("pos")
    return first.orderBy(F.col("delist_date").asc_nulls_last(), "symbol")


def year_segments(spans: DataFrame, start: str = "start", end: str = "end", today: Column | None = None) -> DataFrame:
    """Each row's [start, end] cut at year ends and at ``today``: adds year, seg_start, seg_end."""
    last = F.least(F.col(end), today if today is not None else F.current_date())
    years = F.sequence(F.year(start), F.year(end))
    cut = spans.where(F.col(start) <= F.col(end)).withColumn("year", F.explode(years)).withColumns({
        "seg_start": F.greatest(F.col(start), F.make_date("year", F.lit(1), F.lit(1))),
        "seg_end": F.least(last, F.make_date("year", F.lit(12), F.lit(31))),
    })
    return cut.where(F.col("seg_start") <= F.col("seg_end"))


def month_plan(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Each row's months as (month, probe_start, probe_end), clipped to [start, end]."""
    months = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    plan = spans.where(F.col(start) <= F.col(end)).withColumn("month", F.explode(months))
    return plan.withColumns({
        "probe_start": F.greatest(F.col(start), F.col("month")),
        "probe_end": F.least(F.col(end), F.last_day("month")),
    })


def monthly_sample_dates(days: DataFrame, plan: DataFrame, probe_days: int = PROBE_DAYS) -> DataFrame:
    """First day with data of each planned month, searched over its first ``probe_days`` days.

    days: distinct (date); the result keeps months without a hit, with a null date.
    """
    wanted = plan.select(
        "month", "probe_start",
        F.explode(F.sequence(
            F.col("probe_start"), F.least(F.col("probe_end"), F.date_add("probe_start", probe_days - 1))
        )).alias("date"),
    )
    hits = wanted.join(days.select("date").distinct(), "date", "left_semi")
    first = hits.groupBy("month").agg(F.min("date").alias("sample_date"))
    return plan.select("month").distinct().join(first, "month", "left")


def require_every_month(sample: DataFrame) -> DataFrame:
    """Fail the job on a month without data: a hole would look like a listing gap."""
    complete = F.assert_true(
        F.col("sample_date").isNotNull(), F.concat(F.lit("no data in month "), F.col("month").cast("string"))
    )
    return sample.where(complete.isNull())


def sample_history(quotes: DataFrame, sample: DataFrame) -> DataFrame:
    """Seen log (symbol, name, seen_date): the rows of the sampled days."""
    dates = sample.select(F.col("sample_date").alias("date")).where(F.col("date").isNotNull())
    return quotes.join(dates, "date", "left_semi").select(
        "symbol", "name", F.col("date").alias("seen_date")
    ).distinct()


def backfill_plan(spans: DataFrame, tables: list[str], existing: DataFrame, today: Column | None = None) -> DataFrame:
    """Missing (table, symbol, year, seg_start, seg_end) work items.

    spans: (symbol, start, end), ``end`` already clipped at a delisting where there
    is one. existing: (table, symbol, year) already stored. The table list is a
    literal array, so nothing is cross-joined.
    """
    wanted = year_segments(spans, today=today).withColumn(
        "table", F.explode(F.array(*[F.lit(t) for t in tables]))
    )
    return wanted.join(existing, ["table", "symbol", "year"], "left_anti").select(
        "table", "symbol", "year", "seg_start", "seg_end"
    )


def existing_years(table: str, rows: DataFrame) -> DataFrame:
    """Stored (table, symbol, year) triples."""
    return rows.select(F.lit(table).alias("table"), "symbol", F.year("date").alias("year")).distinct()


def clip_at_delisting(spans: DataFrame, delistings: DataFrame, start: Column | None = None) -> DataFrame:
    """Spans of delisted symbols only, each ending on its delist date (open end when that is unknown)."""
    gone = delistings.select("symbol", "delist_date")
    if start is not None:
        gone = gone.where(F.col("delist_date").isNull() | (F.col("delist_date") >= start))
    joined = spans.join(gone, "symbol")
    return joined.withColumn("end", F.least("end", F.coalesce("delist_date", F.col("end")))).drop("delist_date")
