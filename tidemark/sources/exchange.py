"""Exchange payloads: month tables, daily snapshot and whole-market report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import best_rows, broadcast_if_bounded
from tidemark.functions.values import plain_number, roc_slash_date, to_shares
from tidemark.schemas import conform

EXCHANGE = "twse"

# Column headings of the month table and of the market report.
DATE, OPEN, HIGH, LOW, CLOSE = "日期", "開盤價", "最高價", "最低價", "收盤價"
VOLUME, TURNOVER, TRADES = "成交股數", "成交金額", "成交筆數"
CODE, NAME = "證券代號", "證券名稱"
MONTH_HEADER = ["日期", "成交股數", "成交金額", "開盤價", "最高價", "最低價", "收盤價", "漲跌價差", "成交筆數"]

_TABLE = "struct<fields:array<string>,data:array<array<string>>>"


def _cell(name: str) -> Column:
    """The cell under a heading, null when the table has no such column."""
    place = F.array_position("_fields", F.lit(name))
    return F.when(place > 0, F.try_element_at("_row", F.nullif(place, F.lit(0)).cast("int")))


def normalize_month_tables(raw: DataFrame, volume_unit: str = "shares", market: str = "TSE") -> DataFrame:
    """Month payloads (symbol, payload) with header-indexed rows → ``daily``.

    Payloads whose status is not OK are skipped; a missing header falls back to the usual one.
    """
    parsed = raw.withColumn(
        "_p", F.from_json("payload", "stat string, fields array<string>, data array<array<string>>")
    ).where(F.col("_p.stat") == "OK")
    usual = F.array(*[F.lit(h) for h in MONTH_HEADER])
    header = F.when(F.size("_p.fields") > 0, F.col("_p.fields")).otherwise(usual)
    rows = parsed.select("symbol", header.alias("_fields"), F.explode("_p.data").alias("_row"))
    return conform(rows.select(
        "symbol", F.lit(market).alias("market"), roc_slash_date(_cell(DATE)).alias("date"),
        plain_number(_cell(OPEN)).alias("open"), plain_number(_cell(HIGH)).alias("high"),
        plain_number(_cell(LOW)).alias("low"), plain_number(_cell(CLOSE)).alias("close"),
        to_shares(plain_number(_cell(VOLUME)), volume_unit).alias("volume_shares"),
        plain_number(_cell(TURNOVER)).alias("turnover_twd"),
        plain_number(_cell(TRADES)).cast("long").alias("trade_count"),
        F.lit(EXCHANGE).alias("source"),
    ), "daily")


# Required snapshot fields and the texts that mean "no value".
SNAPSHOT_FIELDS = [
    "Date", "Code", "TradeVolume", "TradeValue", "OpeningPrice", "HighestPrice", "LowestPrice",
    "ClosingPrice", "Transaction",
]
NO_VALUE = ["", "--", "---"]


def _snapshot_text(name: str) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(F.try_element_at("_f", F.lit(name)), F.lit("")), ",", ""))
    return F.when(~text.isin(NO_VALUE), text)


# Snapshot numbers: field in the payload, column in the table, type.
_SNAPSHOT_NUMBERS = [
    ("OpeningPrice", "open", "double"), ("HighestPrice", "high", "double"), ("LowestPrice", "low", "double"),
    ("ClosingPrice", "close", "double"), ("TradeVolume", "volume_shares", "long"),
    ("TradeValue", "turnover_twd", "double"), ("Transaction", "trade_count", "long"),
]


def snapshot_rows(raw: DataFrame) -> DataFrame:
    """Snapshot payloads (one JSON object per row) → ``daily`` without validation; bad cells are null."""
    rows = raw.withColumn("_f", F.from_json("payload", "map<string,string>"))
    return conform(rows.select(
        F.try_element_at("_f", F.lit("Code")).alias("symbol"), F.lit("TSE").alias("market"),
        _compact_date_or_null().alias("date"),
        *[_snapshot_text(field).try_cast(dtype).alias(name) for field, name, dtype in _SNAPSHOT_NUMBERS],
        F.lit(EXCHANGE).alias("source"),
    ), "daily")


def _compact_date_or_null() -> Column:
    text = F.try_element_at("_f", F.lit("Date"))
    iso = F.concat((F.substring(text, 1, 3).try_cast("int") + 1911).cast("string"), F.substring(text, 4, 4))
    return F.when(text.rlike(r"^\d{7}$"), F.try_to_date(iso, "yyyyMMdd"))


def snapshot_problems(raw: DataFrame) -> DataFrame:
    """One row of counts: rows, rows with missing fields, bad dates, bad numbers, duplicate keys."""
    rows = raw.withColumn("_f", F.from_json("payload", "map<string,string>"))
    present = F.lit(True)
    for name in SNAPSHOT_FIELDS:
        present = present & F.coalesce(F.map_contains_key("_f", name), F.lit(False))
    bad_number = F.lit(False)
    for field, _, dtype in _SNAPSHOT_NUMBERS:
        text = _snapshot_text(field)
        bad_number = bad_number | (text.isNotNull() & text.try_cast(dtype).isNull())
    counts = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~present).alias("missing_fields"),
        F.count_if(_compact_date_or_null().isNull()).alias("bad_dates"), F.count_if(bad_number).alias("bad_numbers"),
    )
    repeated = snapshot_rows(raw).groupBy("symbol", "date").count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates")
    )
    return counts.withColumn("_k", F.lit(1)).join(repeated.withColumn("_k", F.lit(1)), "_k").drop("_k")


def normalize_snapshot(raw: DataFrame) -> DataFrame:
    """Fail-fast snapshot normalisation: any problem rejects the whole delivery."""
    found = snapshot_problems(raw).first().asDict()
    if found["rows"] == 0:
        raise ValueError("snapshot must be a non-empty list")
    problems = {k: v for k, v in found.items() if k != "rows" and v}
    if problems:
        raise ValueError(f"snapshot rejected: {problems}")
    return snapshot_rows(raw)


def _report_number(value: Column) -> Column:
    text = F.trim(F.regexp_replace(value, ",", ""))
    return F.when(~text.isin("---", "", "None"), text).try_cast("double")


def parse_market_reports(raw: DataFrame) -> DataFrame:
    """Market reports (iso_date, priority, payload) → quotes (symbol … turnover_twd, source_date).

    The quote table is at the top level or among ``tables``; of several payloads of a
    day (and ``part``, for a day delivered in parts) the first usable one counts. Only
    four-digit codes are kept.
    """
    parsed = raw.withColumn("_p", F.from_json(
        "payload", f"stat string, fields array<string>, data array<array<string>>, tables array<{_TABLE}>"
    )).where(F.col("_p.stat") == "OK")
    top = F.when((F.size("_p.fields") > 0) & (F.size("_p.data") > 0),
                 F.struct(F.col("_p.fields").alias("fields"), F.col("_p.data").alias("data")))
    nested = F.try_element_at(
        F.filter("_p.tables", lambda t: F.coalesce(F.array_contains(t["fields"], CODE), F.lit(False))), F.lit(1)
    )
    usable = parsed.withColumn("_t", F.coalesce(top, nested)).where(F.col("_t").isNotNull())
    day = ["iso_date", "part"] if "part" in raw.columns else ["iso_date"]
    first = best_rows(usable.select(*day, "priority", "_t"), day, [F.col("priority")], 1)
    rows = first.select(
        F.col("iso_date").alias("source_date"), F.col("_t.fields").alias("_fields"),
        F.explode("_t.data").alias("_row"),
    )
    volume = F.coalesce(_report_number(_cell(VOLUME)), F.lit(0.0)).cast("long")
    return rows.select(
        F.trim(_cell(CODE)).alias("symbol"), F.coalesce(_cell(NAME), F.lit("")).alias("name"),
        _report_number(_cell(CLOSE)).alias("close"), volume.alias("volume_shares"),
        _report_number(_cell(TURNOVER)).alias("turnover_twd"), "source_date",
    ).where(F.col("symbol").rlike(r"^\d{4}$"))


def recent_days(quotes: DataFrame, sample_days: int = 5, min_rows: int = 100) -> DataFrame:
    """Quotes of the last ``sample_days`` days that have more than ``min_rows`` rows."""
    days = quotes.groupBy("source_date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_rows)
    newest = days.orderBy(F.col("source_date").desc()).limit(sample_days).select("source_date")
    return quotes.join(broadcast_if_bounded(newest, sample_days), "source_date", "left_semi")
