"""Research runs: backtest, out-of-sample check and execution timing on one panel."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.adjust import adjusted_prices
from tidemark.operators.calendar import calendar
from tidemark.operators.evaluation import (
    concentration_flags, drawdown_flags, erosion_flags, out_of_sample_table, require_long_spans, stability_flags,
)
from tidemark.operators.factors import DEFAULT_FACTORS, factor_table
from tidemark.operators.ic import (
    auto_direction, daily_rank_ic, fixed_direction, given_directions, ic_stability, ic_summary, with_forward_return,
)
from tidemark.operators.ledger import explain_trades, holding_runs, ledger_summary
from tidemark.operators.portfolio import (
    KEYS, Rules, average_turnover, combined_daily, cost_erosion, equal_weight_benchmark, held_bound, on_spans,
    portfolio_daily, portfolio_metrics, rebalance_candidates, resolve_benchmark, select_holdings, signal_rows,
    spans_of, yearly_excess, yearly_stats,
)
from tidemark.operators.timing import compare_timing, timing_contributions
from tidemark.operators.universe import UniverseSpec, pit_eligibility, universe_sizes
from tidemark.session import store_intermediate


@dataclass(frozen=True)
class Research:
    """One evaluation. Every property is a DataFrame built from the ones before it; with ``reuse`` a property that
    is stored runs its job when it is first asked for.

    panel: date, instrument, open, high, low, close, volume, factor.
    ``is_ratio`` splits the sample: directions then come from the first span only and
    both spans are run separately. ``direction`` is auto, top, bottom or short, or a mapping
    from each factor to top or bottom.
    ``reuse`` stores the steps that several results read (calendar, factor table, directions,
    holdings, signals, daily returns) in the checkpoint folder; without it everything is one plan.
    """

    panel: DataFrame
    names: tuple[str, ...] = DEFAULT_FACTORS
    rules: Rules = Rules()
    direction: str | Mapping[str, str] = "auto"
    fwd_days: int = 5
    universe: UniverseSpec = UniverseSpec.all()
    is_ratio: float | None = None
    reuse: bool = True

    @cached_property
    def calendar(self) -> DataFrame:
        return self._kept(calendar(self.universe_panel), "calendar")

    @cached_property
    def universe_panel(self) -> DataFrame:
        static = self.universe.kind != "pit_liquidity"
        return self.universe.slice(self.panel) if static else self.panel

    @cached_property
    def spans(self) -> DataFrame:
        spans = spans_of(self.calendar, self.is_ratio)
        return self._kept(spans if self.is_ratio is None else require_long_spans(spans), "spans")

    @cached_property
    def prices(self) -> DataFrame:
        """Adjusted prices per span."""
        return on_spans(adjusted_prices(self.universe_panel), self.spans)

    @cached_property
    def returns(self) -> DataFrame:
        """Prices with the forward return inside the span.

        Shuffled once by instrument: the windows of the return and of all factors use that layout.
        """
        return with_forward_return(self.prices.repartition("instrument"), self.fwd_days, ("instrument", "span"))

    @cached_property
    def factors(self) -> DataFrame:
        """(factor, span, di, date, instrument, value, fwd), masked by the universe.

        Factors look back over the whole sample before it is split, so the first
        out-of-sample dates have values.
        """
        rows = factor_table(self.returns, self.names, keep=("span", "di", "fwd"))
        return self._kept(self.universe.mask(rows, self.universe_panel), "factors")

    def _kept(self, df: DataFrame, label: str) -> DataFrame:
        return store_intermediate(df, label) if self.reuse else df

    @cached_property
    def factor_spans(self) -> DataFrame:
        """(factor, span) pairs without reading the panel."""
        names = F.array(*[F.lit(n) for n in self.names])
        return self.spans.select("span").distinct().withColumn("factor", F.explode(names)).select(*KEYS)

    @cached_property
    def ics(self) -> DataFrame:
        return self._kept(daily_rank_ic(self.factors, keys=("factor", "span")), "ics")

    @cached_property
    def held_bound(self) -> int | None:
        """Most picks (and so trades) of the run, from the stored calendar; unknown for a fully lazy run."""
        return held_bound(len(self.names), self.calendar.count(), self.rules) if self.reuse else None

    @cached_property
    def directions(self) -> DataFrame:
        """One row per factor; with a split only the in-sample ICs decide."""
        if isinstance(self.direction, Mapping):
            return given_directions(self.factor_spans, {n: self.direction.get(n) for n in self.names})
        if self.direction != "auto":
            return fixed_direction(self.factor_spans, self.direction)
        deciding = self.ics if self.is_ratio is None else self.ics.where(F.col("span") == "is")
        return self._kept(auto_direction(deciding, self.factor_spans), "directions")

    @cached_property
    def holdings(self) -> DataFrame:
        candidates = rebalance_candidates(self.factors, self.directions, self.rules)
        holdings = select_holdings(candidates, self.spans, self.factor_spans, self.rules)
        return self._kept(holdings, "holdings")

    @cached_property
    def rows(self) -> DataFrame:
        return self._kept(signal_rows(
            self.prices, self.holdings, self.directions, self.rules, self.held_bound
        ), "signals")

    @cached_property
    def daily(self) -> DataFrame:
        return self._kept(portfolio_daily(self.rows, self.spans, self.factor_spans, self.rules), "daily")

    @cached_property
    def combined(self) -> DataFrame:
        return combined_daily(self.daily)

    @cached_property
    def named_daily(self) -> DataFrame:
        """Factor portfolios and their combination in one table."""
        columns = [*KEYS, "di", "date", "net", "gross", "trades"]
        return self.daily.select(*columns).unionByName(
            self.combined.withColumn("factor", F.lit("combined")).select(*columns)
        )

    @cached_property
    def equal_weight(self) -> DataFrame:
        return equal_weight_benchmark(self.prices)

    def benchmark(self, index: DataFrame | None = None) -> DataFrame:
        """The index (date, ret) where it covers the sample, else equal weight."""
        if index is None:
            return self.equal_weight.withColumn("label", F.lit("equal_weight"))
        return resolve_benchmark(self.spans, index, self.equal_weight)

    # -- result tables ------------------------------------------------------

    def metrics(self) -> DataFrame:
        """Metrics, position changes and turnover per portfolio, the combination included.

        The combination has the direction its factors have in common, else ``mixed``.
        """
        turnover = average_turnover(self.holdings)
        mean_turnover = turnover.groupBy("span").agg(F.avg("avg_turnover").alias("avg_turnover")).withColumn(
            "factor", F.lit("combined")
        )
        directions = self.directions.select("factor", "direction")
        common = directions.agg(
            F.when(F.min("direction") == F.max("direction"), F.min("direction")).otherwise("mixed").alias("direction")
        ).select(F.lit("combined").alias("factor"), "direction")
        return (
            portfolio_metrics(self.named_daily, KEYS, totals=("trades",)).withColumnRenamed("trades", "trade_count")
            .join(turnover.unionByName(mean_turnover), KEYS, "left")
            .join(directions.unionByName(common), "factor", "left")
        )

    def erosion(self) -> DataFrame:
        return cost_erosion(self.named_daily, KEYS)

    def stability(self) -> DataFrame:
        return ic_stability(self.ics.drop("span"), self.calendar)

    @cached_property
    def trades(self) -> DataFrame:
        """Holding runs with long returns; a short portfolio has no ledger."""
        if self.direction == "short":
            raise ValueError("a trade ledger shows long portfolios only")
        return self._kept(holding_runs(self.rows, self.rules.fee, KEYS), "trades")

    def ledger(self) -> DataFrame:
        return explain_trades(self.trades, self.factors, self.directions, self.rules, KEYS, self.held_bound)

    def timing(self) -> DataFrame:
        if self.direction == "short":
            raise ValueError("execution timing compares long portfolios only")
        return compare_timing(self.rows, self.holdings, self.factor_spans, self.spans, self.rules)

    def years(self, index: DataFrame | None = None) -> DataFrame:
        return yearly_excess(yearly_stats(self.named_daily, ["factor"]), yearly_stats(self.benchmark(index), [], "ret"))

    def interpretation(self, index: DataFrame | None = None) -> DataFrame:
        """(subject, flag, value) rows."""
        combined = self.named_daily.where(F.col("factor") == "combined")
        excess = self.years(index).where(F.col("factor") == "combined")
        return (
            stability_flags(self.stability())
            .unionByName(erosion_flags(cost_erosion(combined, ["factor"])))
            .unionByName(concentration_flags(excess))
            .unionByName(drawdown_flags(
                portfolio_metrics(combined, ["factor"]), portfolio_metrics(self.benchmark(index), [], "ret")
            ))
        )

    def out_of_sample(self, index: DataFrame | None = None) -> DataFrame:
        oos_ics = self.ics.where(F.col("span") == "oos")
        return out_of_sample_table(self.daily, self.combined, self.benchmark(index), oos_ics, self.directions)

    def sizes(self) -> DataFrame | None:
        """Eligible names on the rebalance dates, for a point-in-time universe."""
        if self.universe.kind != "pit_liquidity":
            return None
        spec = self.universe
        eligible = pit_eligibility(self.panel, spec.n or 0, spec.lookback_days, spec.min_listed_days)
        return universe_sizes(eligible, self.calendar, self.rules.rebalance_days)

    def factor_report(self) -> DataFrame:
        return ic_summary(self.ics, ("factor", "span"))

    def ledger_report(self) -> DataFrame:
        return ledger_summary(self.trades)

    def contributions(self) -> DataFrame:
        return timing_contributions(self.timing())
