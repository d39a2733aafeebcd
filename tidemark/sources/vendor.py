"""Vendor payloads (one JSON object per row) → typed tables.

A normaliser is a function from a raw DataFrame to a typed one; it runs over the
landed rows of all symbols at once. Raw frames have a ``payload`` text column and
may carry a ``symbol`` column used when the payload names none.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.values import to_shares
from tidemark.schemas import conform

# Names under which the price vendor has delivered each field.
PRICE_ALIASES: dict[str, tuple[str, ...]] = {
    "symbol": ("stock_id", "symbol"),
    "date": ("date", "trade_date", "date_time"),
    "open": ("open", "open_price"),
    "high": ("max", "high", "max_price"),
    "low": ("min", "low", "min_price"),
    "close": ("close", "close_price"),
    "volume": ("Trading_Volume", "trading_volume", "volume"),
    "turnover": ("Trading_money", "trading_money", "turnover", "amount"),
    "trade_count": ("Trading_turnover", "Trading_tickets", "trading_turnover", "trade_count"),
}

# Vendor market types, margin units and source names.
MARKET_TYPES = {"twse": "TSE", "tpex": "OTC", "emerging": "EMG"}
MARGIN_LOT_SHARES = 1000.0
VENDOR, HOURLY_VENDOR = "finmind", "yfinance"


class Normalizer(Protocol):
    """Raw DataFrame → typed DataFrame; the plug-in point for further sources."""

    def __call__(self, raw: DataFrame, **options: object) -> DataFrame: ...


def _fields(raw: DataFrame) -> DataFrame:
    return raw.withColumn("_f", F.from_json("payload", "map<string,string>"))


def _field(name: str) -> Column:
    return F.try_element_at("_f", F.lit(name))


def _first_present(field: str) -> Column:
    """The value under the first alias that is a key of the row, even when that value is null."""
    picked = F.when(F.lit(False), F.lit(None).cast("string"))
    for alias in PRICE_ALIASES[field]:
        picked = picked.when(F.map_contains_key("_f", alias), _field(alias))
    return picked


def _number(value: Column) -> Column:
    return value.try_cast("double")


def _or_blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _symbol(raw: DataFrame, picked: Column) -> Column:
    named = F.nullif(picked, F.lit(""))
    return F.coalesce(named, F.col("symbol")) if "symbol" in raw.columns else named


def field_names(raw: DataFrame) -> DataFrame:
    """Distinct field names that occur in the payloads."""
    return _fields(raw).select(F.explode(F.map_keys("_f")).alias("field")).distinct()


def normalize_price_rows(raw: DataFrame, volume_unit: str, market: str = "TSE", source: str = VENDOR) -> DataFrame:
    """Price rows → ``daily``. Rows without a positive close are dropped; a missing or
    non-positive open is replaced by the close."""
    rows = _fields(raw).select(
        _symbol(raw, _first_present("symbol")).alias("symbol"),
        (F.col("market") if "market" in raw.columns else F.lit(market)).alias("market"),
        F.to_date(_first_present("date"), "yyyy-MM-dd").alias("date"),
        _number(_first_present("open")).alias("open"),
        _number(_first_present("high")).alias("high"),
        _number(_first_present("low")).alias("low"),
        _number(_first_present("close")).alias("close"),
        to_shares(_first_present("volume"), volume_unit).alias("volume_shares"),
        _number(_first_present("turnover")).alias("turnover_twd"),
        _number(_first_present("trade_count")).cast("long").alias("trade_count"),
        F.lit(source).alias("source"),
    )
    traded = rows.where(F.col("close") > 0)
    return conform(
        traded.withColumn("open", F.when(F.col("open") > 0, F.col("open")).otherwise(F.col("close"))), "daily"
    )


def normalize_instruments(raw: DataFrame) -> DataFrame:
    """Instrument list → ``instrument``. Unknown market types stay as they are; dates that do not
    parse become null. The vendor's date is a snapshot date, never a listing date."""
    kind = _or_blank(_field("type"))
    market = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MARKET_TYPES.items() for x in kv]), kind),
                        kind)
    return conform(_fields(raw).select(
        _first_present("symbol").alias("symbol"),
        F.coalesce(F.nullif(_field("stock_name"), F.lit("")), _field("name"), F.lit("")).alias("name"),
        market.alias("market"),
        _or_blank(_field("industry_category")).alias("industry"),
        F.lit(None).cast("date").alias("list_date"),
        F.try_to_date(_field("delist_date"), "yyyy-MM-dd").alias("delist_date"),
        F.coalesce(F.nullif(_field("status"), F.lit("")), F.lit("active")).alias("status"),
        F.try_to_date(_field("date"), "yyyy-MM-dd").alias("snapshot_date"),
    ), "instrument")


def _amount(*names: str) -> Column:
    """Sum of the named fields, anything missing or unreadable counting as zero."""
    parts = [F.coalesce(_number(_field(n)), F.lit(0.0)) for n in names]
    return sum(parts[1:], parts[0])


def normalize_institutional(raw: DataFrame, source: str = VENDOR) -> DataFrame:
    """Wide institutional rows → ``institutional``; the dealer side adds plain, own and hedging trades."""
    def dealer(side: str) -> Column:
        return _amount(f"Dealer_{side}", f"Dealer_self_{side}", f"Dealer_Hedging_{side}")

    return conform(_fields(raw).select(
        _symbol(raw, _field("stock_id")).alias("symbol"),
        F.to_date(_field("date"), "yyyy-MM-dd").alias("date"),
        _amount("Foreign_Investor_buy").alias("foreign_buy"),
        _amount("Foreign_Investor_sell").alias("foreign_sell"),
        _amount("Investment_Trust_buy").alias("investment_trust_buy"),
        _amount("Investment_Trust_sell").alias("investment_trust_sell"),
        dealer("buy").alias("dealer_buy"), dealer("sell").alias("dealer_sell"),
        F.lit(source).alias("source"),
    ), "institutional")


# Margin fields of the vendor.
MARGIN_FIELDS = {
    "margin_balance": "MarginPurchaseTodayBalance",
    "margin_buy": "MarginPurchaseBuy",
    "margin_sell": "MarginPurchaseSell",
    "short_balance": "ShortSaleTodayBalance",
    "short_sell": "ShortSaleSell",
    "short_cover": "ShortSaleBuy",
}


def normalize_margin(raw: DataFrame, source: str = VENDOR) -> DataFrame:
    """Margin rows in lots → ``margin`` in shares."""
    return conform(_fields(raw).select(
        _symbol(raw, _field("stock_id")).alias("symbol"),
        F.to_date(_field("date"), "yyyy-MM-dd").alias("date"),
        *[(_amount(field) * MARGIN_LOT_SHARES).alias(name) for name, field in MARGIN_FIELDS.items()],
        F.lit(source).alias("source"),
    ), "margin")


def _history_bars(raw: DataFrame, source: str) -> DataFrame:
    volume = F.when(F.col("Volume").isNull() | F.isnan("Volume"), F.lit(0.0)).otherwise(F.col("Volume"))
    return raw.select(
        "symbol", "market", F.col("ts").cast("timestamp_ntz").alias("date"),
        *[F.col(c).cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close")],
        F.bround(volume).cast("long").alias("volume_shares"),
        F.lit(None).cast("double").alias("turnover_twd"),
        F.lit(None).cast("long").alias("trade_count"),
        F.lit(source).alias("source"),
    )


def normalize_hourly_history(raw: DataFrame, source: str = HOURLY_VENDOR) -> DataFrame:
    """History frame (symbol, market, ts, Open … Volume) → ``hourly`` in local wall time.

    A row with any price null, NaN or zero is dropped; a missing volume is zero.
    """
    bars = _history_bars(raw, source)
    keep = F.lit(True)
    for price in ("open", "high", "low", "close"):
        keep = keep & F.col(price).isNotNull() & ~F.isnan(price) & (F.col(price) != 0)
    return conform(bars.where(keep), "hourly")


def normalize_daily_history(raw: DataFrame, source: str = HOURLY_VENDOR) -> DataFrame:
    """The same frame with daily rows → ``daily``; only the close has to be present."""
    bars = _history_bars(raw, source).withColumn("date", F.to_date("date"))
    return conform(bars.where(F.col("close").isNotNull() & ~F.isnan("close")), "daily")


def vendor_ticker(symbol: Column, market: Column) -> Column:
    """2330/TSE → 2330.TW, 6488/OTC → 6488.TWO; a symbol with a suffix stays."""
    suffix = F.when(F.upper(market) == "OTC", ".TWO").otherwise(".TW")
    return F.when(symbol.contains("."), symbol).otherwise(F.concat(symbol, suffix))
