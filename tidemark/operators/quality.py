"""Row checks, issue reports and the bar contract. Every result is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import change, history, trailing

PRICES = ["open", "high", "low", "close"]

# Limits of the checks.
TOLERANCE_ABS, TOLERANCE_REL = 0.06, 0.002
MAX_GAP_DAYS, MAX_MOVE = 15, 0.15
VOLUME_FACTOR, VOLUME_WINDOW = 20.0, 20


def clean_bars(df: DataFrame) -> DataFrame:
    """Rows whose four prices are all present and positive."""
    keep = F.lit(True)
    for price in PRICES:
        keep = keep & F.col(price).isNotNull() & (F.col(price) > 0)
    return df.where(keep)


def _issue(holds: Column, check: str, field: str, value: Column) -> Column:
    entry = F.struct(
        F.lit(check).alias("check"), F.lit(field).alias("field"), value.cast("double").alias("value")
    )
    return F.when(holds, entry)


def _issue_rows(df: DataFrame, issues: list[Column]) -> DataFrame:
    """(symbol, date, check, field, value): the issues of each row, unfolded."""
    found = df.select("symbol", "date", F.array_compact(F.array(*issues)).alias("_issues"))
    return found.select("symbol", "date", F.inline("_issues"))


def _nonpositive() -> list[Column]:
    return [_issue(F.col(p).isNull() | (F.col(p) <= 0), "ohlc_nonpositive", p, F.col(p)) for p in PRICES]


def _inconsistent() -> list[Column]:
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    tolerance = F.greatest(F.lit(TOLERANCE_ABS), top * TOLERANCE_REL)
    over, under = top - F.col("high"), F.col("low") - bottom
    return [_issue((over > tolerance) | (under > tolerance), "ohlc_inconsistent", "high_low", F.greatest(over, under))]


def _gap(max_days: int) -> list[Column]:
    days = F.datediff("date", F.lag("date").over(history("symbol")))
    return [_issue(days > max_days, "date_gap", "date", days)]


def _jump(max_move: float) -> list[Column]:
    move = change(F.col("close"), history("symbol"))
    return [_issue(F.abs(move) > max_move, "price_jump", "close", F.col("close"))]


def _spike(factor: float, window: int) -> list[Column]:
    frame = trailing(history("symbol"), window)
    needed = F.least(F.lit(window), F.count(F.lit(1)).over(Window.partitionBy("symbol")))
    median = F.when(
        F.count("volume_shares").over(frame) >= needed,
        F.percentile(F.col("volume_shares"), F.lit(0.5)).over(frame),
    )
    volume = F.col("volume_shares")
    return [_issue((median > 0) & (volume > median * factor), "volume_spike", "volume_shares", volume)]


def nonpositive_prices(df: DataFrame) -> DataFrame:
    """One issue per price column that is null or not positive."""
    return _issue_rows(df, _nonpositive())


def inconsistent_ohlc(df: DataFrame) -> DataFrame:
    """High below or low above open/close by more than rounding noise."""
    return _issue_rows(df, _inconsistent())


def date_gaps(df: DataFrame, max_days: int = MAX_GAP_DAYS) -> DataFrame:
    return _issue_rows(df, _gap(max_days))


def price_jumps(df: DataFrame, max_move: float = MAX_MOVE) -> DataFrame:
    return _issue_rows(df, _jump(max_move))


def volume_spikes(df: DataFrame, factor: float = VOLUME_FACTOR, window: int = VOLUME_WINDOW) -> DataFrame:
    """Volume above ``factor`` times the rolling median; short histories use their own length."""
    return _issue_rows(df, _spike(factor, window))


def quality_report(df: DataFrame, max_move: float = MAX_MOVE, max_gap_days: int = MAX_GAP_DAYS,
                   volume_factor: float = VOLUME_FACTOR, volume_window: int = VOLUME_WINDOW) -> DataFrame:
    """All issues of all symbols, from one scan and one shuffle by symbol. The report passes when it is empty."""
    return _issue_rows(df, [
        *_nonpositive(), *_inconsistent(), *_gap(max_gap_days), *_jump(max_move), *_spike(volume_factor, volume_window)
    ])


def quality_summary(issues: DataFrame) -> DataFrame:
    """One row: number of issues and whether the report passes."""
    return issues.agg(F.count(F.lit(1)).alias("issues")).withColumn("passed", F.col("issues") == 0)


# Rules of the stored-bar contract.
SYMBOL_PATTERN = r"^[0-9A-Z]{4,12}$"
CONTRACT_MARKET = "TSE"
CONTRACT_SOURCES = ("twse", "manual")


def contract_errors(df: DataFrame, allowed_columns: list[str] | None = None) -> DataFrame:
    """Add ``errors``: the broken rules of each row, empty for an acceptable bar.

    Doubles must be finite and not negative, counts whole numbers; high and low must
    bound every price that is present.
    """
    present = F.array_compact(F.array(*PRICES))
    rules: list[tuple[str, Column]] = [
        ("symbol", F.col("symbol").isNull() | ~F.col("symbol").rlike(SYMBOL_PATTERN)),
        ("date", F.col("date").isNull()),
        ("market", F.col("market").isNull() | (F.col("market") != CONTRACT_MARKET)),
        ("source", F.col("source").isNull() | ~F.col("source").isin(*CONTRACT_SOURCES)),
    ]
    for name in (*PRICES, "turnover_twd"):
        value = F.col(name)
        infinite = F.isnan(value) | (F.abs(value) == float("inf"))
        rules.append((name, value.isNotNull() & (infinite | (value < 0))))
    for name in ("volume_shares", "trade_count"):
        value = F.col(name).cast("double")
        rules.append((name, value.isNotNull() & (F.isnan(value) | (value != F.floor(value)) | (value < 0))))
    rules.append(("high", F.col("high").isNotNull() & (F.col("high") < F.array_max(present))))
    rules.append(("low", F.col("low").isNotNull() & (F.col("low") > F.array_min(present))))
    if allowed_columns is not None:
        unknown = [c for c in df.columns if c not in allowed_columns]
        rules += [(f"unknown:{name}", F.lit(True)) for name in unknown]
    checks = [F.when(broken, F.lit(name)) for name, broken in rules]
    return df.withColumn("errors", F.array_distinct(F.array_compact(F.array(*checks))))


def split_by_contract(df: DataFrame, allowed_columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows keep their ``errors``."""
    checked = contract_errors(df, allowed_columns)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
