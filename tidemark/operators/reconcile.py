"""Comparison of two sources and of an exported panel with its store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import change, history

# Fields of the institutional comparison and the tolerance of both comparisons.
INSTITUTIONAL_FIELDS = [
    "foreign_buy", "foreign_sell", "investment_trust_buy", "investment_trust_sell", "dealer_buy", "dealer_sell",
]
TOLERANCE = 0.005


def _paired_cells(primary: DataFrame, secondary: DataFrame, fields: list[str]) -> DataFrame:
    """(symbol, date, field, primary, secondary) from one join for all fields."""
    shared = [f for f in fields if f in primary.columns and f in secondary.columns]
    left = primary.select("symbol", "date", *[F.col(f).cast("double").alias(f"a_{f}") for f in shared])
    right = secondary.select("symbol", "date", *[F.col(f).cast("double").alias(f"b_{f}") for f in shared])
    cells = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("primary"), F.col(f"b_{f}").alias("secondary"))
        for f in shared
    ])
    return left.join(right, ["symbol", "date"]).select("symbol", "date", F.inline(cells))


def _beyond(tolerance: float) -> Column:
    """Relative to the primary value, absolute when that is zero; null and equal pairs never differ."""
    base, error = F.abs("primary"), F.abs(F.col("primary") - F.col("secondary"))
    return F.when(base > 0, F.try_divide(error, base)).otherwise(error) > tolerance


def compare_sources(primary: DataFrame, secondary: DataFrame, fields: tuple[str, ...] = ("close", "volume_shares"),
                    tolerance: float = TOLERANCE) -> DataFrame:
    """Mismatching cells with their absolute error."""
    cells = _paired_cells(primary, secondary, list(fields))
    return cells.where(_beyond(tolerance)).withColumn("error", F.abs(F.col("primary") - F.col("secondary")))


def compare_summary(primary: DataFrame, secondary: DataFrame, fields: tuple[str, ...] = ("close", "volume_shares"),
                    tolerance: float = TOLERANCE) -> DataFrame:
    """One row: cells checked, mismatches, passed (at least one cell and no mismatch)."""
    cells = _paired_cells(primary, secondary, list(fields))
    counts = cells.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(_beyond(tolerance)).alias("mismatches")
    )
    return counts.withColumn("passed", (F.col("checked") > 0) & (F.col("mismatches") == 0))


def institutional_mismatches(primary: DataFrame, secondary: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    found = compare_sources(primary, secondary, tuple(INSTITUTIONAL_FIELDS), tolerance)
    return found.select(
        "symbol", "date",
        F.concat(F.lit("institutional_"), F.col("field"), F.lit("_mismatch")).alias("check"),
        "primary", "secondary",
    )


def _status(bad: Column, warn_only: Column | None = None) -> Column:
    failed = F.when(warn_only, F.lit("warn")).otherwise(F.lit("fail")) if warn_only is not None else F.lit("fail")
    return F.when(bad, failed).otherwise(F.lit("pass"))


def panel_strays(panel: DataFrame, store: DataFrame, instruments: int = 5, dates: int = 3) -> DataFrame:
    """(check, sample, measure): the first instruments and dates that only the panel has, and the largest differences.

    The samples stand next to the counts of :func:`verify_panel`.
    """
    rows = panel.join(store.groupBy("instrument", "date").agg(
        F.max("close").alias("s_close"), F.max("volume_shares").cast("double").alias("s_volume")), ["instrument", "date"])
    largest = rows.agg(F.max(F.abs(F.col("close") - F.col("s_close"))).alias("close_equal"),
                       F.max(F.abs(F.col("volume") - F.col("s_volume"))).alias("volume_equal"))
    differences = largest.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("check"), F.lit(None).cast("string").alias("sample"), F.col(c).alias("measure"))
        for c in ("close_equal", "volume_equal")])))

    def only_here(column: str, check: str, n: int) -> DataFrame:
        extra = panel.select(column).distinct().join(store.select(column).distinct(), column, "left_anti")
        first = extra.orderBy(column).limit(n)
        return first.select(F.lit(check).alias("check"), F.col(column).cast("string").alias("sample"), F.lit(None).cast("double").alias("measure"))

    return differences.unionByName(only_here("instrument", "instruments_in_store", instruments)).unionByName(
        only_here("date", "dates_in_store", dates))


def verify_panel(panel: DataFrame, store: DataFrame) -> DataFrame:
    """Scorecard (check, status, measure) of an exported panel against the stored bars.

    panel: instrument, date, close, volume, factor · store: instrument, date, close, volume_shares.
    Two passes: one aggregate over the panel joined with the store, one over the
    panel's per-instrument windows; each reduces map-side to a single row.
    """
    store_rows = (
        store.groupBy("instrument", "date")
        .agg(F.max("close").alias("s_close"), F.max("volume_shares").cast("double").alias("s_volume"))
        .withColumn("in_store", F.lit(True))
    )
    joined = panel.join(store_rows, ["instrument", "date"], "left")
    close_gap, volume_gap = F.abs(F.col("close") - F.col("s_close")), F.abs(F.col("volume") - F.col("s_volume"))
    zero = F.col("close") <= 0
    totals = joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("in_store").isNull() | F.col("s_close").isNull()).alias("unmatched"),
        F.count_if(close_gap > 1e-9).alias("close_diff"),
        F.count_if(volume_gap > 0.5).alias("volume_diff"),
        F.count_if(zero).alias("zero_close"),
        F.count_if(zero & F.coalesce(F.col("s_close") > 0, F.lit(True))).alias("zero_only_here"),
        F.count_if(F.col("close").isNull()).alias("null_close"),
        F.min("factor").alias("factor_min"), F.max("factor").alias("factor_max"),
        F.datediff(F.max("date"), F.min("date")).alias("span_days"),
    )
    instruments = panel.select("instrument").distinct().join(
        store.select("instrument").distinct(), "instrument", "left_anti"
    ).agg(F.count(F.lit(1)).alias("extra_instruments"))
    dates = panel.select("date").distinct().join(
        store.select("date").distinct(), "date", "left_anti"
    ).agg(F.count(F.lit(1)).alias("extra_dates"))
    duplicates = panel.groupBy("instrument", "date").count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates")
    )

    rows = history("instrument")
    adjusted = F.col("close") * F.col("factor")
    jump = F.coalesce(F.abs(change(adjusted, rows)) > 0.6, F.lit(False))
    near_zero = (
        F.coalesce(F.col("close") <= 0, F.lit(False))
        | F.coalesce(F.lag("close").over(rows) <= 0, F.lit(False))
        | F.coalesce(F.lead("close").over(rows) <= 0, F.lit(False))
    )
    hole = (F.col("factor") >= 0.99) & (F.lag("factor").over(rows) < 0.9) & (F.lead("factor").over(rows) < 0.9)
    flags = panel.select(hole.alias("hole"), (jump & ~near_zero).alias("jump"), (jump & near_zero).alias("zero_jump"))
    windows = flags.agg(
        F.count_if("hole").alias("holes"), F.count_if("jump").alias("jumps"), F.count_if("zero_jump").alias("zero_jumps")
    )

    row = totals.select(
        "*", instruments.scalar().alias("extra_instruments"), dates.scalar().alias("extra_dates"), duplicates.scalar().alias("duplicates"),
        windows.select(F.struct("holes", "jumps", "zero_jumps")).scalar().alias("_windows")).select("*", "_windows.*")

    def line(check: str, status: Column, measure: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), status.alias("status"), measure.cast("double").alias("measure"))

    c = F.col
    jump_status = F.when(c("jumps") == 0, "pass").when(c("jumps") < c("rows") * 0.002, "warn").otherwise("fail")
    return row.select(F.inline(F.array(
        line("unique_date_instrument", _status(c("duplicates") > 0), c("duplicates")),
        line("unique_instrument_date", _status(c("duplicates") > 0), c("duplicates")),
        line("key_order", F.lit("pass"), F.lit(0)),
        line("date_span_days", F.lit("pass"), c("span_days")),
        line("instruments_in_store", _status(c("extra_instruments") > 0), c("extra_instruments")),
        line("dates_in_store", _status(c("extra_dates") > 0), c("extra_dates")),
        line("rows_in_store", _status(c("unmatched") > 0), c("unmatched")),
        line("close_equal", _status(c("close_diff") > 0), c("close_diff")),
        line("volume_equal", _status(c("volume_diff") > 0), c("volume_diff")),
        line("no_zero_close", _status(c("zero_close") > 0, c("zero_only_here") == 0), c("zero_close")),
        line("no_null_close", _status(c("null_close") > 0), c("null_close")),
        line("no_factor_hole", _status(c("holes") > 0), c("holes")),
        line("no_adjusted_jump", jump_status, c("jumps")),
        line("factor_range", _status(~((c("factor_min") > 0) & (c("factor_max") < 50))), c("factor_max")),
    )))


def scorecard_conclusion(scorecard: DataFrame) -> DataFrame:
    """One row: fails, warnings and the verdict."""
    counts = scorecard.agg(
        F.count_if(F.col("status") == "fail").alias("fails"),
        F.count_if(F.col("status") == "warn").alias("warnings"),
    )
    verdict = (
        F.when(F.col("fails") > 0, "failed").when(F.col("warnings") > 0, "passed with warnings").otherwise("passed")
    )
    return counts.withColumn("conclusion", verdict)
