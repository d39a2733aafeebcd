"""The driver tables seen as market data, on Spark.

``lineitem`` becomes weekly bars per supplier, ``events`` ticks per user, and so on.
Everything is derived from whole tables; the DuckDB side of each view is in
``oracle_views.py``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.adjust import build_panel
from tidemark.operators.calendar import calendar
from tidemark.operators.listing import sample_history
from tidemark.session import store_intermediate


def r6(value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """All doubles to six decimals, the precision both engines are compared at."""
    return df.select(*[r6(F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def market_of(key: str) -> Column:
    return F.when(F.col(key) % 3 == 0, "OTC").otherwise("TSE")


def symbol_of(key: str) -> Column:
    text = F.col(key).cast("string")
    return F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)


class Tables:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def _trades(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        tick = F.round((1 + F.col("l_discount") - F.col("l_tax")) * 100).cast("long")
        in_week = F.datediff(day, F.trunc(day, "week")).cast("long")
        # One whole number orders the trades of a week, which keeps first and last hash-aggregated.
        order = ((in_week * 2**40 + F.col("l_orderkey")) * 8 + F.col("l_linenumber")) * 32 + tick - 90
        return self.raw("lineitem").select(
            "*", F.trunc(day, "week").alias("date"), tick.alias("tick"), order.alias("seq"),
            (F.col("l_quantity") * 1000).alias("shares"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        """symbol, market, instrument, date, OHLC, volume_shares, turnover_twd, trade_count, source."""
        weekly = self._trades.groupBy("l_suppkey", "date").agg(
            F.min_by("tick", "seq").cast("double").alias("open"),
            F.max("tick").cast("double").alias("high"),
            F.min("tick").cast("double").alias("low"),
            F.max_by("tick", "seq").cast("double").alias("close"),
            F.sum("shares").cast("long").alias("volume_shares"),
            F.round(F.sum("l_extendedprice"), 2).alias("turnover_twd"),
            F.count(F.lit(1)).alias("trade_count"),
        )
        return weekly.select(
            symbol_of("l_suppkey").alias("symbol"), market_of("l_suppkey").alias("market"),
            F.concat(market_of("l_suppkey"), symbol_of("l_suppkey")).alias("instrument"), "date",
            "open", "high", "low", "close", "volume_shares", "turnover_twd", "trade_count",
            F.lit("twse").alias("source"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        return self.bars.drop("instrument")

    @cached_property
    def calendar(self) -> DataFrame:
        return calendar(self._trades)

    def _flow(self, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("shares")).otherwise(F.lit(0.0)))

    @cached_property
    def institutional(self) -> DataFrame:
        flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
        flows = self._trades.groupBy("l_suppkey", "date").agg(
            self._flow(flag == "R").alias("foreign_buy"), self._flow(flag == "A").alias("foreign_sell"),
            self._flow((flag == "N") & (status == "O")).alias("investment_trust_buy"),
            self._flow((flag == "N") & (status == "F")).alias("investment_trust_sell"),
            self._flow(line % 2 == 0).alias("dealer_buy"), self._flow(line % 2 == 1).alias("dealer_sell"),
        )
        return flows.withColumn("symbol", symbol_of("l_suppkey")).withColumn("source", F.lit("finmind")).drop("l_suppkey")

    @cached_property
    def institutional_second(self) -> DataFrame:
        """A second delivery: foreign sales 2 % higher, dealer sales missing when small."""
        return self.institutional.withColumns({
            "foreign_sell": F.col("foreign_sell") * 1.02,
            "dealer_sell": F.when(F.col("dealer_sell") >= 20000, F.col("dealer_sell")),
        })

    @cached_property
    def margin(self) -> DataFrame:
        line = F.col("l_linenumber")
        sums = self._trades.groupBy("l_suppkey", "date").agg(
            self._flow(line <= 4).alias("margin_balance"), self._flow(line == 1).alias("margin_buy"),
            self._flow(line == 2).alias("margin_sell"), self._flow(line > 4).alias("short_balance"),
            self._flow(line == 5).alias("short_sell"), self._flow(line == 6).alias("short_cover"),
        )
        return sums.withColumn("symbol", symbol_of("l_suppkey")).withColumn("source", F.lit("finmind")).drop("l_suppkey")

    @cached_property
    def second_source(self) -> DataFrame:
        """Another source of the same bars: only weeks with two or more trades, some values off."""
        return self.bars.where(F.col("trade_count") >= 2).withColumns({
            "close": F.when(F.col("close") == F.col("high"), F.col("close") * 1.01).otherwise(F.col("close")),
            "volume_shares": F.when(F.col("open") == F.col("low"), F.col("volume_shares") + 1000).otherwise(
                F.col("volume_shares")),
        })

    @cached_property
    def dirty(self) -> DataFrame:
        """Bars with missing, zero and inconsistent prices."""
        single, several = F.col("trade_count") == 1, F.col("trade_count") >= 3
        return self.bars.withColumns({
            "open": F.when(single & (F.col("close") > 105), None).otherwise(F.col("open")),
            "high": F.when(several & (F.col("open") == F.col("high")), F.col("low") - 1).otherwise(F.col("high")),
            "close": F.when(single & (F.col("close") < 95), 0.0)
            .when(single & (F.col("close") == 100), None).otherwise(F.col("close")),
        })

    @cached_property
    def ticks(self) -> DataFrame:
        return self.raw("events").select(
            F.col("user_id").cast("string").alias("symbol"), F.col("ts").alias("timestamp"),
            F.col("value").alias("price"), F.lit(1).cast("long").alias("size_shares"), "event_id",
        )

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.raw("supplier").select(
            "s_suppkey", symbol_of("s_suppkey").alias("symbol"), F.col("s_name").alias("name"),
            market_of("s_suppkey").alias("market"), "s_nationkey", "s_acctbal",
            F.concat(market_of("s_suppkey"), symbol_of("s_suppkey")).alias("instrument"),
        )

    @cached_property
    def instruments(self) -> DataFrame:
        newest = self.raw("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
            F.to_date(F.max("l_shipdate")).alias("snapshot_date")
        )
        nations = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("industry"))
        return self.suppliers.join(nations, "s_nationkey").join(newest, "s_suppkey", "left").select(
            "symbol", "name", "market", "industry", F.lit(None).cast("date").alias("list_date"),
            F.lit(None).cast("date").alias("delist_date"), F.lit("active").alias("status"), "snapshot_date",
        )

    @cached_property
    def quotes(self) -> DataFrame:
        """(symbol, name, date, close, volume_shares, turnover_twd)."""
        names = self.suppliers.select("symbol", "name")
        return self.bars.join(names, "symbol").select(
            "symbol", "name", "date", "close", "volume_shares", "turnover_twd"
        )

    @cached_property
    def month_sample(self) -> DataFrame:
        return self.calendar.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("sample_date"))

    @cached_property
    def seen(self) -> DataFrame:
        return sample_history(self.quotes, self.month_sample)

    @cached_property
    def delistings(self) -> DataFrame:
        """Suppliers with a low balance left on 15 June of a year that depends on their nation."""
        return self.suppliers.where(F.col("s_acctbal") < 2000).select(
            "symbol", "name", F.make_date(F.col("s_nationkey") % 4 + 1997, F.lit(6), F.lit(15)).alias("delist_date")
        )

    @cached_property
    def dividends(self) -> DataFrame:
        """One event per instrument and year, on 15 June."""
        years = self.calendar.agg(F.min(F.year("date")).alias("a"), F.max(F.year("date")).alias("b"))
        first, last = years.select("a").scalar(), years.select("b").scalar()
        return self.suppliers.select(
            "instrument", F.explode(F.sequence(first, last)).alias("year"),
            (F.lit(1.0) + F.col("s_suppkey") % 5 * 0.5).alias("cash"),
            F.when(F.col("s_suppkey") % 4 == 0, 0.1).otherwise(0.0).alias("ratio"),
        ).select("instrument", F.make_date("year", F.lit(6), F.lit(15)).alias("ex_date"), "cash", "ratio")

    @cached_property
    def panel(self) -> DataFrame:
        """Research panel; the factor is stored with six decimals."""
        return build_panel(self.daily, self.dividends).withColumn("factor", F.round("factor", 6))

    @cached_property
    def stored_panel(self) -> DataFrame:
        """The panel as a stored table: research runs on an exported panel. Every query builds its own."""
        return store_intermediate(self.panel, "panel")

    @cached_property
    def index(self) -> DataFrame:
        """Market level per week: mean price per share traded, from 1997 on."""
        level = F.round(F.sum("turnover_twd") / F.sum("volume_shares") * 1000, 4)
        return self.bars.where(F.col("date") >= "1997-01-01").groupBy("date").agg(level.alias("close"))

    @cached_property
    def horizon(self) -> Column:
        """The last bar date, as a scalar."""
        return self.calendar.agg(F.max("date")).scalar()
