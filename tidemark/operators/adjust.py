"""Corporate actions: split and dividend adjustment, panel build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import broadcast_if_bounded

# Clip range of a single dividend factor.
FACTOR_FLOOR, FACTOR_CAP = 0.05, 1.0


def back_adjusted_close(bars: DataFrame, events: DataFrame, group: str = "instrument") -> DataFrame:
    """Add ``back_adjusted``: close times the ratios of all later events.

    events: (group, date, ratio), ratio = price after / price before. The running
    product goes backwards in time so that every row costs one multiplication.
    """
    later = Window.partitionBy(group).orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, -1)
    joined = bars.join(events.select(group, "date", F.col("ratio").alias("_ratio")), [group, "date"], "left")
    scale = F.coalesce(F.product(F.coalesce("_ratio", F.lit(1.0))).over(later), F.lit(1.0))
    return joined.withColumn("back_adjusted", F.round(F.col("close") * scale, 2)).drop("_ratio")


def forward_adjusted_close(bars: DataFrame, dividends: DataFrame, group: str = "instrument") -> DataFrame:
    """Add ``forward_adjusted``: close minus the dividends paid so far. dividends: (group, date, cash)."""
    so_far = Window.partitionBy(group).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    joined = bars.join(dividends.select(group, "date", F.col("cash").alias("_cash")), [group, "date"], "left")
    paid = F.sum(F.coalesce("_cash", F.lit(0.0))).over(so_far)
    return joined.withColumn("forward_adjusted", F.round(F.col("close") - paid, 2)).drop("_cash")


def _event_factor(previous_close: Column, cash: Column, ratio: Column) -> Column:
    """Null when there is no usable previous close or it is no more than a tenth of the cash paid."""
    factor = (1 - F.try_divide(cash, previous_close)) / (1 + ratio)
    clipped = F.least(F.greatest(factor, F.lit(FACTOR_FLOOR)), F.lit(FACTOR_CAP))
    return F.when(previous_close > cash / 10, clipped)


def with_dividend_factor(bars: DataFrame, events: DataFrame, group: str = "instrument") -> DataFrame:
    """Add ``factor``: product over the events with a later ex-date (latest rows have 1).

    events: (group, ex_date, cash, ratio). Bars and events go through one shuffle by
    group; an event sorts before a bar of the same date, so its previous close is
    strictly earlier and a bar on the ex-date is already past the event.
    """
    marked_bars = bars.withColumns({
        "_side": F.lit(1), "_cash": F.lit(None).cast("double"), "_ratio": F.lit(None).cast("double"),
    })
    marked_events = events.select(
        F.col(group), F.col("ex_date").alias("date"), F.lit(0).alias("_side"),
        F.col("cash").cast("double").alias("_cash"), F.col("ratio").cast("double").alias("_ratio"),
    )
    rows = marked_bars.unionByName(marked_events, allowMissingColumns=True)
    earlier = Window.partitionBy(group).orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, -1)
    valid_close = F.when(F.col("close") > 0, F.col("close"))
    rows = rows.withColumn("_previous", F.last(valid_close, ignorenulls=True).over(earlier))
    rows = rows.withColumn(
        "_factor",
        F.when(F.col("_side") == 0, _event_factor(F.col("_previous"), F.col("_cash"), F.col("_ratio"))),
    )
    later = (
        Window.partitionBy(group).orderBy(F.col("date").desc(), F.col("_side").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    product = F.product(F.coalesce("_factor", F.lit(1.0))).over(later)
    return (
        rows.withColumn("factor", product)
        .where(F.col("_side") == 1)
        .drop("_side", "_cash", "_ratio", "_previous", "_factor")
    )


def dividend_events(rows: DataFrame) -> DataFrame:
    """Vendor dividend rows → (instrument, ex_date, cash, ratio); rows without date or amount are dropped.

    Stock dividends are stated on a par value of 10, hence the division.
    """
    def amount(name: str) -> Column:
        number = F.col(name).try_cast("double")
        return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(number)

    ex_date = F.coalesce(F.nullif(F.col("CashExDividendTradingDate"), F.lit("")),
                         F.nullif(F.col("StockExDividendTradingDate"), F.lit("")))
    events = rows.select(
        "instrument",
        F.try_to_date(ex_date, "yyyy-MM-dd").alias("ex_date"),
        (amount("CashEarningsDistribution") + amount("CashStatutorySurplus")).alias("cash"),
        ((amount("StockEarningsDistribution") + amount("StockStatutorySurplus")) / 10.0).alias("ratio"),
    )
    return events.where(F.col("ex_date").isNotNull() & ((F.col("cash") > 0) | (F.col("ratio") > 0)))


def with_filled_factor(bars: DataFrame, factors: DataFrame, group: str = "instrument") -> DataFrame:
    """Add ``factor`` from an external (group, date, factor) map: forward fill, then backward fill, then 1."""
    known = factors.select(group, "date", F.col("factor").alias("_known"))
    ordered = Window.partitionBy(group).orderBy("date")
    before = F.last("_known", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    first_known = F.first("_known", ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    joined = bars.join(known, [group, "date"], "left")
    # Rows that forward fill leaves empty precede every known value, so the first known value fills them.
    return joined.withColumn("factor", F.coalesce(before, first_known, F.lit(1.0))).drop("_known")


def build_panel(bars: DataFrame, events: DataFrame | None = None, max_symbols: int | None = None) -> DataFrame:
    """Stored bars → research panel (date, instrument, open … volume, factor)."""
    if max_symbols is not None:
        # A bounded list: TakeOrdered keeps max_symbols rows per task.
        first = bars.select("symbol").distinct().orderBy("symbol").limit(max_symbols)
        bars = bars.join(broadcast_if_bounded(first, max_symbols), "symbol", "left_semi")
    rows = bars.withColumn("instrument", F.concat("market", "symbol"))
    rows = rows.withColumn("factor", F.lit(1.0)) if events is None else with_dividend_factor(rows, events)
    return rows.select(
        "date", "instrument", "open", "close", "high", "low",
        F.col("volume_shares").cast("double").alias("volume"), "factor",
    )


def adjusted_prices(panel: DataFrame) -> DataFrame:
    """Add ``adj``/``raw`` (and ``adj_open``/``raw_open``); one mask nulls raw and adjusted close together."""
    adjusted = F.col("close") * F.col("factor")
    finite = ~F.isnan(adjusted) & (F.abs(adjusted) != float("inf"))
    valid = (F.col("close") > 0) & finite & (adjusted > 0)
    return panel.withColumns({
        "adj": F.when(valid, adjusted),
        "raw": F.when(valid, F.col("close")),
        "adj_open": F.col("open") * F.col("factor"),
        "raw_open": F.col("open"),
    })
