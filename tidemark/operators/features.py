"""Indicators and the 20-column feature table (compressed row axis)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import change, full_mean, full_stddev, history, ratio, wilder_mean

# Column order of the feature table.
FEATURE_ORDER = [
    "symbol", "date", "close", "return_1d", "return_5d", "return_20d", "rsi_14", "ma5_ma20_ratio",
    "close_vs_ma20", "volatility_20d", "volume_ratio_20", "turnover_mean_20", "foreign_net_lots",
    "trust_net_lots", "tii_net_lots", "foreign_net_ratio", "margin_change_pct", "short_change_pct",
    "margin_short_ratio", "label_ret_1f",
]

FLOW_COLUMNS = ["foreign_net_lots", "trust_net_lots", "tii_net_lots", "foreign_net_ratio"]
MARGIN_COLUMNS = ["margin_change_pct", "short_change_pct", "margin_short_ratio"]


def add_returns(df: DataFrame, price: str = "close", n: int = 1, group: str = "symbol") -> DataFrame:
    return df.withColumn(f"return_{n}d", change(F.col(price), history(group), n))


def add_sma(df: DataFrame, price: str = "close", window: int = 5, group: str = "symbol") -> DataFrame:
    return df.withColumn(f"sma_{window}", full_mean(F.col(price), history(group), window))


def add_volume_ratio(df: DataFrame, volume: str = "volume_shares", window: int = 5,
                     group: str = "symbol") -> DataFrame:
    mean = full_mean(F.col(volume), history(group), window)
    return df.withColumn(f"volume_ratio_{window}", ratio(F.col(volume), mean))


def add_rsi(df: DataFrame, price: str = "close", n: int = 14, group: str = "symbol") -> DataFrame:
    """Relative strength from Wilder means over the moves that are known.

    50 where nothing has moved yet and where a move is unknown (a null close has none, nor has
    the row after it), 100 without losses. Unknown moves take no step of the means.
    """
    move = F.col(price) - F.lag(price).over(history(group))
    moves = df.withColumn("_move", move).withColumns({
        "_gain": F.greatest(F.col("_move"), F.lit(0.0)),
        "_loss": F.greatest(-F.col("_move"), F.lit(0.0)),
    }).withColumns({c: F.when(F.col("_move").isNotNull(), F.col(c)) for c in ("_gain", "_loss")})
    means = wilder_mean(moves, {"_up": "_gain", "_down": "_loss"}, n, group)
    rsi = F.lit(100.0) * F.try_divide(F.col("_up"), F.col("_up") + F.col("_down"))
    known = F.when(F.col("_move").isNotNull(), rsi)
    return means.withColumn(f"rsi_{n}", F.coalesce(known, F.lit(50.0))).drop(
        "_move", "_gain", "_loss", "_up", "_down"
    )


def add_volatility(df: DataFrame, window: int = 20, group: str = "symbol") -> DataFrame:
    """Sample deviation of one-row returns; expects ``return_1d``."""
    return df.withColumn(f"volatility_{window}d", full_stddev(F.col("return_1d"), history(group), window))


def add_label(df: DataFrame, price: str = "close", group: str = "symbol") -> DataFrame:
    following = F.lead(price).over(history(group))
    return df.withColumn("label_ret_1f", ratio(following, F.col(price)) - 1)


def price_features(daily: DataFrame) -> DataFrame:
    """All price and volume indicators; every window shares one shuffle and one sort by symbol."""
    out = daily.select("symbol", "date", "close", "volume_shares", "turnover_twd")
    for n in (1, 5, 20):
        out = add_returns(out, n=n)
    out = add_volume_ratio(add_sma(add_sma(out, window=5), window=20), window=20)
    out = add_label(add_volatility(add_rsi(out, n=14)))
    return out.withColumns({
        "turnover_mean_20": full_mean(F.col("turnover_twd"), history("symbol"), 20),
        "ma5_ma20_ratio": ratio(F.col("sma_5"), F.col("sma_20")),
        "close_vs_ma20": ratio(F.col("close"), F.col("sma_20")) - 1,
    }).drop("sma_5", "sma_20")


def _net_lots(*fields: str) -> Column:
    bought = sum((F.col(f"{f}_buy") for f in fields[1:]), F.col(f"{fields[0]}_buy"))
    sold = sum((F.col(f"{f}_sell") for f in fields[1:]), F.col(f"{fields[0]}_sell"))
    return (bought - sold) / 1000.0


def institutional_flows(institutional: DataFrame) -> DataFrame:
    return institutional.select(
        "symbol", "date",
        _net_lots("foreign").alias("foreign_net_lots"),
        _net_lots("investment_trust").alias("trust_net_lots"),
        _net_lots("foreign", "investment_trust", "dealer").alias("tii_net_lots"),
    )


def attach_institutional(df: DataFrame, institutional: DataFrame | None) -> DataFrame:
    if institutional is None:
        return df.withColumns({name: F.lit(None).cast("double") for name in FLOW_COLUMNS})
    joined = df.join(institutional_flows(institutional), ["symbol", "date"], "left")
    return joined.withColumn(
        "foreign_net_ratio", ratio(F.col("foreign_net_lots") * 1000, F.col("volume_shares"))
    )


def margin_changes(margin: DataFrame) -> DataFrame:
    rows = history("symbol")
    return margin.select(
        "symbol", "date",
        change(F.col("margin_balance"), rows).alias("margin_change_pct"),
        change(F.col("short_balance"), rows).alias("short_change_pct"),
        ratio(F.col("short_balance"), F.col("margin_balance")).alias("margin_short_ratio"),
    )


def attach_margin(df: DataFrame, margin: DataFrame | None) -> DataFrame:
    if margin is None:
        return df.withColumns({name: F.lit(None).cast("double") for name in MARGIN_COLUMNS})
    return df.join(margin_changes(margin), ["symbol", "date"], "left")


def ml_features(daily: DataFrame, institutional: DataFrame | None = None,
                margin: DataFrame | None = None) -> DataFrame:
    table = attach_margin(attach_institutional(price_features(daily), institutional), margin)
    return table.select(*FEATURE_ORDER)
