"""Universes: declarative specs, liquidity ranking and point-in-time eligibility."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import broadcast_if_bounded
from tidemark.functions.ranks import best_band
from tidemark.operators.calendar import calendar, with_calendar_index


@dataclass(frozen=True)
class UniverseSpec:
    """Which instruments take part: ``all``, ``code_first_n`` or ``pit_liquidity``."""

    kind: str
    n: int | None = None
    lookback_days: int = 60
    min_listed_days: int = 120

    @staticmethod
    def all() -> "UniverseSpec":
        return UniverseSpec("all")

    @staticmethod
    def code_first_n(n: int) -> "UniverseSpec":
        return UniverseSpec("code_first_n", n)

    @staticmethod
    def pit_liquidity(top_n: int, lookback_days: int = 60, min_listed_days: int = 120) -> "UniverseSpec":
        return UniverseSpec("pit_liquidity", top_n, lookback_days, min_listed_days)

    def describe(self) -> str:
        if self.kind == "all":
            return "all (every instrument of the panel)"
        if self.kind == "code_first_n":
            return f"code_first_n(n={self.n}) (first {self.n} by code)"
        if self.kind == "pit_liquidity":
            return (
                f"pit_liquidity(top_n={self.n}, lookback_days={self.lookback_days}, "
                f"min_listed_days={self.min_listed_days})"
            )
        raise ValueError(f"unknown universe kind: {self.kind}")

    def slice(self, panel: DataFrame) -> DataFrame:
        """The panel restricted to a static universe."""
        if self.kind == "all":
            return panel
        if self.kind == "code_first_n":
            return panel.join(broadcast_if_bounded(code_first_n(panel, self.n or 0), self.n or 0), "instrument", "left_semi")
        if self.kind == "pit_liquidity":
            raise NotImplementedError("pit_liquidity is a per-date mask, not a static slice; use mask()")
        raise ValueError(f"unknown universe kind: {self.kind}")

    def mask(self, factors: DataFrame, panel: DataFrame) -> DataFrame:
        """Factor rows of eligible (date, instrument) pairs; other specs leave the factors as they are."""
        if self.kind != "pit_liquidity":
            return factors
        eligible = pit_eligibility(panel, self.n or 0, self.lookback_days, self.min_listed_days)
        return factors.join(eligible.select("date", "instrument"), ["date", "instrument"], "left_semi")


def resolve_universe(spec: UniverseSpec | None = None, top_symbols: int | None = None) -> UniverseSpec:
    """An explicit spec wins over the integer shorthand, which wins over ``all``."""
    if spec is not None:
        return spec
    return UniverseSpec.all() if top_symbols is None else UniverseSpec.code_first_n(top_symbols)


def survivorship_note(spec: UniverseSpec) -> str:
    """The bias remark a report prints next to its universe."""
    if spec.kind == "pit_liquidity":
        return "point-in-time: eligibility uses data of the day only and includes later delisted instruments"
    return "static: instruments that left before the sample ends may be missing, which flatters long samples"


def code_first_n(panel: DataFrame, n: int) -> DataFrame:
    """First ``n`` instruments in code order (OTC sorts before TSE)."""
    return panel.select("instrument").distinct().orderBy("instrument").limit(n)


def pit_eligibility(panel: DataFrame, top_n: int, lookback_days: int = 60,
                    min_listed_days: int = 120) -> DataFrame:
    """Eligible (date, di, instrument, liquidity_rank) rows, each judged on data up to its own date.

    Liquidity is the mean of close × volume over the tradable days among the last
    ``lookback_days`` calendar days, and a name keeps its place in the ranking
    while any such day remains, even if it does not trade today. So each row is
    carried forward to the name's next row, at most ``lookback_days`` days; this
    fills exactly the cells of a dense matrix that hold a mean, without a cross join.
    """
    cal = calendar(panel)
    last_di = cal.agg(F.max("di")).scalar()
    tradable = (F.col("close") > 0) & (F.col("volume") > 0)
    rows = with_calendar_index(panel.select("date", "instrument", "close", "volume"), cal).select(
        "instrument", "di",
        F.coalesce(tradable, F.lit(False)).alias("tradable"),
        F.when(tradable, F.col("close") * F.col("volume")).alias("amount"),
    )
    by_name = Window.partitionBy("instrument").orderBy("di")
    carried = rows.withColumns({
        "_until": F.least(
            F.coalesce(F.lead("di").over(by_name) - 1, last_di),
            F.col("di") + lookback_days - 1,
            last_di,
        ),
        "_listed": F.sum(F.col("tradable").cast("long")).over(by_name.rowsBetween(Window.unboundedPreceding, 0)),
    })
    cells = carried.select(
        "instrument", "_listed", F.col("di").alias("_own"), "tradable", "amount",
        F.explode(F.sequence("di", "_until")).alias("di"),
    ).withColumns({
        "tradable": F.col("tradable") & (F.col("di") == F.col("_own")),
        "amount": F.when(F.col("di") == F.col("_own"), F.col("amount")),
    })
    recent = by_name.rangeBetween(-(lookback_days - 1), 0)
    means = cells.withColumn("mean_amount", F.avg("amount").over(recent))
    ranked = best_band(means, ["di"], "mean_amount", "instrument", top_n, score=-F.col("mean_amount"))
    eligible = ranked.where(
        (F.col("avg_rank") <= top_n) & (F.col("_listed") >= min_listed_days) & F.col("tradable")
    )
    return eligible.join(F.broadcast(cal), "di").select(
        "date", "di", "instrument", F.col("avg_rank").alias("liquidity_rank")
    )


def universe_sizes(eligible: DataFrame, cal: DataFrame, rebalance_days: int) -> DataFrame:
    """One row: least, median and largest eligible count over the rebalance dates (empty dates count as 0)."""
    grid = cal.where((F.col("di") - 1) % rebalance_days == 0)
    counts = eligible.groupBy("di").agg(F.count(F.lit(1)).alias("n"))
    sizes = grid.join(counts, "di", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return sizes.agg(
        F.min("n").alias("size_min"), F.percentile("n", F.lit(0.5)).cast("long").alias("size_median"),
        F.max("n").alias("size_max"),
    )


# Fixed value: code prefix of exchange-traded funds.
FUND_PREFIX = "00"


def top_liquid(quotes: DataFrame, n: int = 300, exclude_funds: bool = True, min_price: float = 5.0) -> DataFrame:
    """The ``n`` names with the largest mean turnover, ranked from 0.

    quotes: symbol, name, close, volume_shares, turnover_twd, source_date.
    """
    keep = (F.col("close") >= min_price) & (F.col("volume_shares") > 0)
    if exclude_funds:
        keep = keep & ~F.col("symbol").startswith(FUND_PREFIX)
    means = quotes.where(keep).groupBy("symbol", "name").agg(
        F.avg("turnover_twd").alias("avg_turnover_twd"),
        F.countDistinct("source_date").alias("sampled_days"),
    )
    order = [F.col("avg_turnover_twd").desc_nulls_last(), F.col("symbol"), F.col("name")]
    top = means.orderBy(*order).limit(n)
    # At most n rows are left for the unpartitioned window.
    return top.select(
        (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"),
        "symbol", "name", "avg_turnover_twd", "sampled_days",
    )


def market_counts(instruments: DataFrame) -> DataFrame:
    return instruments.groupBy("market").agg(F.count(F.lit(1)).alias("n"))
