"""Rebalanced portfolios: selection with a hold buffer, daily P&L and metrics.

Tables carry ``factor`` and ``span`` in every key: ``span`` separates samples that
are evaluated on their own (full, or in-sample and out-of-sample), each with its
own calendar numbering ``di`` and rebalance grid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import best_band, broadcast_if_bounded
from tidemark.functions.windows import at_calendar_offset, ratio

TRADING_DAYS = 252

KEYS = ["factor", "span"]


@dataclass(frozen=True)
class Rules:
    """Portfolio parameters; costs are one-sided rates except ``tax``, paid on sales only."""

    top_n: int = 5
    rebalance_days: int = 20
    buffer_n: int | None = None
    commission: float = 0.001425
    tax: float = 0.003
    slippage: float = 0.0

    def __post_init__(self) -> None:
        if self.band < self.top_n:
            raise ValueError(f"buffer_n ({self.band}) must not be smaller than top_n ({self.top_n})")

    @property
    def band(self) -> int:
        return self.buffer_n or self.top_n

    @property
    def fee(self) -> float:
        """One-sided rate such that a round trip costs 2·commission + tax + 2·slippage."""
        return self.commission + self.tax / 2.0 + self.slippage


def spans_of(cal: DataFrame, is_ratio: float | None = None) -> DataFrame:
    """Calendar with spans: (span, date, di, n_days). Without a ratio there is one span, ``full``."""
    if is_ratio is None:
        marked = cal.select(F.lit("full").alias("span"), "date", "di")
    else:
        n_days = cal.agg(F.max("di")).scalar()
        split = F.floor(n_days * F.lit(is_ratio))
        first = F.col("di") <= F.col("_split")
        marked = cal.withColumn("_split", split).select(
            F.when(first, "is").otherwise("oos").alias("span"), "date",
            F.when(first, F.col("di")).otherwise(F.col("di") - F.col("_split")).alias("di"),
        )
    return marked.withColumn("n_days", F.max("di").over(Window.partitionBy("span")))


def on_spans(panel: DataFrame, spans: DataFrame) -> DataFrame:
    """Add span and di to panel rows; the calendar is day-bounded, hence the broadcast."""
    return panel.drop("di").join(F.broadcast(spans.select("span", "date", "di")), "date")


def period_of(rebalance_days: int) -> Column:
    """Number of the rebalance period a calendar row belongs to, from 0."""
    return F.floor((F.col("di") - 1) / rebalance_days)


def rebalance_candidates(factors: DataFrame, directions: DataFrame, rules: Rules) -> DataFrame:
    """Rows that can be picked on each rebalance date: (factor, span, k, instrument, pos, avg_rank).

    factors: (factor, span, di, instrument, value); directions: one row per factor.
    Cut map-side to 2·band + 1 rows per date whatever the width of the cross-section.
    """
    grid = factors.where((F.col("di") - 1) % rules.rebalance_days == 0).withColumn(
        "k", period_of(rules.rebalance_days)
    )
    scored = grid.join(F.broadcast(directions.select("factor", "direction")), "factor")
    score = F.when(F.col("direction") == "bottom", F.col("value")).otherwise(-F.col("value"))
    return best_band(scored, [*KEYS, "k"], "value", "instrument", rules.band, score=score).select(
        *KEYS, "k", "instrument", "pos", "avg_rank"
    )


def _rebalance_step(rules: Rules):
    """One step of the hold buffer; the state is what the next date needs plus the log so far."""

    def step(state: Column, day: Column) -> Column:
        rows, held = day["rows"], state["held"]
        names = lambda selected: F.transform(selected, lambda r: r["instrument"])
        in_band = F.filter(rows, lambda r: r["avg_rank"] <= rules.band)
        kept = F.filter(in_band, lambda r: F.array_contains(held, r["instrument"]))
        others = F.filter(rows, lambda r: ~F.array_contains(names(kept), r["instrument"]))
        fresh = F.filter(
            F.slice(others, F.lit(1), F.lit(rules.top_n) - F.size(kept)), lambda r: r["avg_rank"] <= rules.band
        )
        later = F.concat(names(kept), names(fresh))
        first = names(F.slice(rows, 1, rules.top_n))
        picks = F.when(state["started"], later).otherwise(first)
        overlap = F.size(F.array_intersect(held, picks))
        turnover = F.when(
            state["started"] & (F.size(rows) > 0), F.lit(1.0) - overlap / F.lit(float(rules.top_n))
        )
        entry = F.struct(day["k"].alias("k"), picks.alias("picks"), turnover.alias("turnover"))
        return F.struct(
            picks.alias("held"), F.lit(True).alias("started"), F.array_append(state["log"], entry).alias("log")
        )

    return step


def select_holdings(candidates: DataFrame, spans: DataFrame, factors: DataFrame, rules: Rules) -> DataFrame:
    """(factor, span, k, picks, turnover): picks of each rebalance date, hold buffer applied.

    A date keeps held names inside the band and fills up with the best others inside
    it. The first date takes the best ``top_n`` regardless of the band; a date without
    any factor value empties the portfolio and records no turnover. The choice on a
    date depends on the date before, so one fold per (factor, span) walks over the
    dates; it sees at most 2·band + 1 rows per date.
    """
    per_date = candidates.groupBy(*KEYS, "k").agg(
        F.array_sort(F.collect_list(F.struct("pos", "instrument", "avg_rank"))).alias("rows")
    )
    row_type = "array<struct<pos:int,instrument:string,avg_rank:double>>"
    per_span = per_date.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("k", "rows"))).alias("by_k"))
    lengths = spans.select("span", "n_days").distinct()
    wanted = factors.select(*KEYS).distinct().join(F.broadcast(lengths), "span").join(per_span, KEYS, "left")
    last_k = F.floor((F.col("n_days") - 1) / rules.rebalance_days)
    days = F.transform(
        F.sequence(F.lit(0).cast("long"), last_k),
        lambda k: F.struct(
            k.alias("k"), F.coalesce(F.try_element_at("by_k", k), F.array().cast(row_type)).alias("rows")
        ),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("held"), F.lit(False).alias("started"),
        F.array().cast("array<struct<k:bigint,picks:array<string>,turnover:double>>").alias("log"),
    )
    folded = wanted.select(*KEYS, F.aggregate(days, start, _rebalance_step(rules), lambda s: s["log"]).alias("log"))
    return folded.select(*KEYS, F.inline("log"))


def average_turnover(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy(*KEYS).agg(F.coalesce(F.avg("turnover"), F.lit(0.0)).alias("avg_turnover"))


def held_bound(n_factors: int, n_days: int, rules: Rules) -> int:
    """Most (factor, rebalance date, name) picks a run can make; two spans may add one date each."""
    return n_factors * (n_days // rules.rebalance_days + 2) * rules.top_n


def signal_rows(panel: DataFrame, holdings: DataFrame, directions: DataFrame, rules: Rules,
                bound: int | None = None) -> DataFrame:
    """Priced rows of every instrument that is ever held, with ``sig`` (1 held, 0 not).

    panel: (span, date, di, instrument, adj, raw, …). Only ever-held instruments can
    earn or cost anything. There are at most top_n per rebalance date and factor
    (``bound``, see :func:`held_bound`), a number set by the calendar and not by the
    panel: while it is small the list is broadcast and the panel is not shuffled.
    Instruments with fewer than three priced rows in a span are left out.
    """
    picked = holdings.select(*KEYS, "k", F.explode("picks").alias("instrument"))
    ever = picked.select(*KEYS, "instrument").distinct()
    prices = panel.select("span", "date", "di", "instrument", "adj", "raw", "adj_open", "raw_open")
    rows = prices.where(F.col("adj").isNotNull()).join(
        broadcast_if_bounded(ever, bound), ["span", "instrument"]
    )
    rows = rows.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "instrument")))
    held = picked.withColumn("sig", F.lit(1))
    joined = rows.where(F.col("_rows") >= 3).withColumn("k", period_of(rules.rebalance_days)).join(
        held, [*KEYS, "k", "instrument"], "left"
    )
    side = F.when(F.col("direction") == "short", -1).otherwise(1)
    return joined.join(F.broadcast(directions.select("factor", side.alias("side"))), "factor").withColumn(
        "sig", F.coalesce("sig", F.lit(0))
    ).drop("_rows", "k")


def signal_pnl(rows: DataFrame, keys: list[str], order: str, price: str, signal: Column, fee: float) -> DataFrame:
    """Add ``position``, ``traded``, ``gross`` and ``net`` daily returns.

    A signal takes effect on the next row; the cost is charged on the row where the
    position changes. The first row, or a row after a zero price, earns nothing.
    """
    series = Window.partitionBy(*keys).orderBy(order)
    with_position = rows.withColumn("position", F.coalesce(F.lag(signal).over(series), F.lit(0)).cast("int"))
    previous = F.lag(price).over(series)
    turnover = F.abs(F.col("position") - F.coalesce(F.lag("position").over(series), F.lit(0)))
    usable = previous.isNotNull() & (previous != 0)
    gross = F.col("position") * (ratio(F.col(price), previous) - 1)
    return with_position.withColumns({
        "traded": turnover,
        "gross": F.when(usable, gross).otherwise(F.lit(0.0)),
        "net": F.when(usable, gross - turnover * F.lit(fee)).otherwise(F.lit(0.0)),
    })


def portfolio_daily(rows: DataFrame, spans: DataFrame, factors: DataFrame, rules: Rules,
                    keys: list[str] = KEYS, price: str = "adj", signal: str = "sig") -> DataFrame:
    """(keys…, di, date, net, gross, trades) for every calendar date; unfilled slots are cash."""
    pnl = signal_pnl(rows, [*keys, "instrument"], "di", price, F.col(signal) * F.col("side"), rules.fee)
    sums = pnl.groupBy(*keys, "di").agg(
        (F.sum("net") / rules.top_n).alias("net"),
        (F.sum("gross") / rules.top_n).alias("gross"),
        F.count_if(F.col("traded") != 0).alias("trades"),
    )
    lengths = spans.select("span", "n_days").distinct()
    every_day = (
        factors.select(*keys).distinct().join(F.broadcast(lengths), "span")
        .select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_days"))).alias("di"))
        .join(F.broadcast(spans.select("span", "di", "date")), ["span", "di"])
    )
    return every_day.join(sums, [*keys, "di"], "left").select(
        *keys, "di", "date",
        F.coalesce("net", F.lit(0.0)).alias("net"), F.coalesce("gross", F.lit(0.0)).alias("gross"),
        F.coalesce("trades", F.lit(0)).alias("trades"),
    )


def combined_daily(daily: DataFrame, keys: list[str] = ["span"]) -> DataFrame:
    """Equal-weight mean of the factor portfolios per date; trades add up."""
    return daily.groupBy(*keys, "di", "date").agg(
        F.avg("net").alias("net"), F.avg("gross").alias("gross"), F.sum("trades").alias("trades")
    )


def with_equity(daily: DataFrame, keys: list[str], value: str = "net", order: str = "date") -> DataFrame:
    """Add ``equity`` (running product of 1 + return), its running ``peak`` and ``drawdown``."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.withColumn("equity", F.product(1 + F.coalesce(F.col(value), F.lit(0.0))).over(so_far))
    curve = curve.withColumn("peak", F.max("equity").over(so_far))
    return curve.withColumn("drawdown", 1 - ratio(F.col("equity"), F.col("peak")))


def _annual(total: Column, n: Column) -> Column:
    return F.when(n > 2, F.pow(1 + total, F.lit(float(TRADING_DAYS)) / n) - 1).otherwise(F.lit(0.0))


def portfolio_metrics(daily: DataFrame, keys: list[str], value: str = "net", order: str = "date",
                      totals: tuple[str, ...] = ()) -> DataFrame:
    """Total and annual return, volatility and Sharpe over all days, drawdown, win share of active days.

    ``totals`` names further columns to add up.
    """
    curve = with_equity(daily, keys, value, order)
    r, std = F.coalesce(F.col(value), F.lit(0.0)), F.col("_std")
    year = F.sqrt(F.lit(float(TRADING_DAYS)))
    stats = curve.groupBy(*keys).agg(
        (F.max_by("equity", order) - 1).alias("total_return"),
        F.count(F.lit(1)).alias("n_days"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"),
        F.max("drawdown").alias("max_drawdown"),
        F.coalesce(F.avg(F.when(r != 0, (r > 0).cast("double"))), F.lit(0.0)).alias("win_rate"),
        *[F.sum(name).alias(name) for name in totals],
    )
    return stats.select(
        *keys, "total_return", _annual(F.col("total_return"), F.col("n_days")).alias("annual_return"),
        F.coalesce(std * year, F.lit(0.0)).alias("volatility"),
        F.coalesce(ratio(F.col("_mean"), std) * year, F.lit(0.0)).alias("sharpe"),
        "max_drawdown", "win_rate", "n_days", *totals,
    )


def signal_metrics(pnl: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """Metrics of one instrument's signal: volatility and Sharpe over active days, peak starts at 1."""
    curve = with_equity(pnl, keys, "net", order)
    loss = 1 - F.col("equity") / F.greatest("peak", F.lit(1.0))
    active = F.when(F.col("net") != 0, F.col("net"))
    std, year = F.coalesce(F.col("_std"), F.lit(0.0)), F.sqrt(F.lit(float(TRADING_DAYS)))
    stats = curve.groupBy(*keys).agg(
        (F.max_by("equity", order) - 1).alias("total_return"), F.count(F.lit(1)).alias("n_days"),
        F.avg(active).alias("_mean"), F.stddev_samp(active).alias("_std"),
        F.max(loss).alias("max_drawdown"), F.count_if(F.col("traded") != 0).alias("trade_count"),
        F.coalesce(F.avg((active > 0).cast("double")), F.lit(0.0)).alias("win_rate"),
    )
    return stats.select(
        *keys, "total_return", _annual(F.col("total_return"), F.col("n_days")).alias("annual_return"),
        (std * year).alias("volatility"),
        F.coalesce(F.when(std > 0, F.col("_mean") / std * year), F.lit(0.0)).alias("sharpe"),
        "max_drawdown", "trade_count", "win_rate",
    )


def yearly_stats(daily: DataFrame, keys: list[str], value: str = "net") -> DataFrame:
    """Return, Sharpe and drawdown inside each calendar year."""
    by_year = daily.withColumn("year", F.year("date"))
    return portfolio_metrics(by_year, [*keys, "year"], value).select(
        *keys, "year", F.col("total_return").alias("year_return"),
        F.col("sharpe").alias("year_sharpe"), F.col("max_drawdown").alias("year_mdd"),
    )


def yearly_excess(portfolio: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Portfolio years next to the benchmark's, with the excess. Years the benchmark lacks keep nulls."""
    b = benchmark.select("year", F.col("year_return").alias("bench_return"), F.col("year_mdd").alias("bench_mdd"))
    return portfolio.join(b, "year", "left").withColumn("excess", F.col("year_return") - F.col("bench_return"))


def equal_weight_benchmark(panel: DataFrame) -> DataFrame:
    """(span, date, di, ret): mean return of all names priced on both calendar rows; no costs."""
    previous = at_calendar_offset(F.col("adj"), -1, "span", "instrument")
    moves = panel.select("span", "date", "di", (ratio(F.col("adj"), previous) - 1).alias("_move"))
    return moves.groupBy("span", "date", "di").agg(F.avg("_move").alias("ret"))


def index_returns(levels: DataFrame) -> DataFrame:
    """Index levels (date, close) → (date, ret); levels at or below zero are dropped, of two on a day the higher counts.

    The one window over all rows runs over a row per calendar date.
    """
    rows = levels.where(F.col("close") > 0).groupBy("date").agg(F.max("close").alias("close"))
    by_date = Window.orderBy("date")
    moved = rows.select("date", (ratio(F.col("close"), F.lag("close").over(by_date)) - 1).alias("ret"))
    return moved.where(F.col("ret").isNotNull())


def resolve_benchmark(spans: DataFrame, index: DataFrame, equal_weight: DataFrame,
                      min_rows: int = 30, min_share: float = 0.5) -> DataFrame:
    """(span, date, di, ret, label): the index where it covers the calendar well enough, else equal weight."""
    aligned = spans.join(index, "date").select("span", "date", "di", "ret")
    covered, days = aligned.agg(F.count(F.lit(1))).scalar(), spans.agg(F.count(F.lit(1))).scalar()
    use_index = (covered >= min_rows) & (covered >= days * F.lit(min_share))
    by_index = aligned.withColumn("label", F.lit("index")).where(use_index)
    by_names = equal_weight.withColumn("label", F.lit("equal_weight")).where(~use_index)
    return by_index.unionByName(by_names)


def index_cache_update(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Merge index levels by date, the fresh ones winning."""
    return cache.join(fresh, "date", "left_anti").unionByName(fresh)


def index_levels(cache: DataFrame, sources: list[tuple[str, DataFrame]], start, end) -> tuple[DataFrame, DataFrame]:
    """(levels to cache, daily returns) of an index between two dates; both have a ``source`` column.

    A cache (date, close, source) that reaches from ``start`` to ``end`` is used as it is.
    Otherwise the first of ``sources``, (label, levels), that has a level above zero is merged over
    it and gives its label to all rows: a total-return index before the price index, say. Without
    any, the cache alone is sliced.
    """
    first, last = (F.lit(x).cast("date") for x in (start, end))
    covered = cache.agg(((F.min("date") <= first) & (F.max("date") >= last)).alias("covered")).first()["covered"]
    merged = cache.select("date", "close", "source")
    for label, levels in [] if covered else sources:
        fresh = levels.where(F.col("close") > 0).select("date", "close")
        if not fresh.isEmpty():
            merged = index_cache_update(merged.select("date", "close"), fresh).withColumn("source", F.lit(label))
            break
    inside = merged.where(F.col("date").between(first, last))
    label = merged.agg(F.max_by("source", "date")).scalar()
    return merged, index_returns(inside.select("date", "close")).withColumn("source", label)


def cost_erosion(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Net and cost-free annual return of the same signals and their difference in points."""
    net = portfolio_metrics(daily, keys, "net").select(*keys, F.col("annual_return").alias("net_annual"))
    gross = portfolio_metrics(daily, keys, "gross").select(*keys, F.col("annual_return").alias("gross_annual"))
    return net.join(gross, keys).withColumn("erosion_pp", (F.col("gross_annual") - F.col("net_annual")) * 100)
