"""Execution timing: the same signals filled at close(t), open(t+1) and close(t+1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ledger import holding_runs, ledger_summary
from tidemark.operators.portfolio import KEYS, Rules, portfolio_daily, portfolio_metrics

VARIANTS = ("close_t", "open_t1", "close_t1")
VARIANT_KEYS = [*KEYS, "variant"]


def _fillable(column: str):
    """A price an order can be filled at: present, finite and positive."""
    price = F.col(column)
    return price.isNotNull() & ~F.isnan(price) & (price != float("inf")) & (price > 0)


def open_overrides(rows: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Add ``exec_sig``, ``exec_adj``, ``exec_raw``: signals and prices of filling at the next open.

    The entry row is priced at the next row's open. The exit signal is extended by one
    row and the row after it is priced at its own open; without a usable open, or for an
    exit on the last row, the trade stays as it is. An exit price wins over an entry
    price on the same row.
    """
    series = Window.partitionBy(*keys, "instrument").orderBy("di")
    ok = _fillable("adj_open") & _fillable("raw_open")
    before = F.coalesce(F.lag("sig").over(series), F.lit(0))
    marked = rows.withColumns({
        "_enters": (F.col("sig") == 1) & (before != 1),
        "_leaves": (F.col("sig") != 1) & (before == 1),
        "_ok": ok,
    })
    next_ok = F.coalesce(F.lead("_ok").over(series), F.lit(False))
    marked = marked.withColumns({
        "_entry_at_open": F.col("_enters") & next_ok,
        "_extended": F.col("_leaves") & next_ok,
        "_next_adj": F.lead("adj_open").over(series),
        "_next_raw": F.lead("raw_open").over(series),
    })
    exit_here = F.coalesce(F.lag("_extended").over(series), F.lit(False))
    priced = marked.withColumn("_exit_at_open", exit_here)

    def price(own_open: str, next_open: str, close: str):
        return F.when(F.col("_exit_at_open"), F.col(own_open)).when(
            F.col("_entry_at_open"), F.col(next_open)
        ).otherwise(F.col(close))

    return priced.withColumns({
        "exec_sig": F.when(F.col("_extended"), F.lit(1)).otherwise(F.col("sig")),
        "exec_adj": price("adj_open", "_next_adj", "adj"),
        "exec_raw": price("raw_open", "_next_raw", "raw"),
    }).drop("_enters", "_leaves", "_ok", "_entry_at_open", "_extended", "_next_adj", "_next_raw", "_exit_at_open")


def timing_rows(rows: DataFrame, holdings: DataFrame, rules: Rules) -> DataFrame:
    """The signal rows of all three variants: (…, variant, exec_sig, exec_adj, exec_raw).

    The delayed variant takes yesterday's signal on the calendar axis, so a row belongs
    to the period of the calendar row before it.
    """
    picked = holdings.select(*KEYS, F.col("k").alias("_k"), F.explode("picks").alias("instrument"))
    late = rows.withColumn("_k", F.floor((F.col("di") - 2) / rules.rebalance_days)).join(
        picked.withColumn("_late", F.lit(1)), [*KEYS, "_k", "instrument"], "left"
    )
    opened = open_overrides(late)
    variants = F.array(
        F.struct(F.lit("close_t").alias("variant"), F.col("sig").alias("exec_sig"),
                 F.col("adj").alias("exec_adj"), F.col("raw").alias("exec_raw")),
        F.struct(F.lit("open_t1").alias("variant"), F.col("_open_sig").alias("exec_sig"),
                 F.col("_open_adj").alias("exec_adj"), F.col("_open_raw").alias("exec_raw")),
        F.struct(F.lit("close_t1").alias("variant"), F.coalesce("_late", F.lit(0)).alias("exec_sig"),
                 F.col("adj").alias("exec_adj"), F.col("raw").alias("exec_raw")),
    )
    renamed = opened.withColumnsRenamed({
        "exec_sig": "_open_sig", "exec_adj": "_open_adj", "exec_raw": "_open_raw"
    })
    return renamed.select(*KEYS, "instrument", "date", "di", "side", F.inline(variants))


def compare_timing(rows: DataFrame, holdings: DataFrame, factor_spans: DataFrame, spans: DataFrame,
                   rules: Rules) -> DataFrame:
    """(factor, span, variant): net metrics, position changes and closed-trade statistics.

    ``rows`` are the signal rows of all held instruments; the variants are extra rows of
    that small table, not reruns of the backtest.
    """
    variants = timing_rows(rows, holdings, rules)
    wanted = factor_spans.select(*KEYS).distinct().withColumn(
        "variant", F.explode(F.array(*[F.lit(v) for v in VARIANTS]))
    )
    daily = portfolio_daily(variants, spans, wanted, rules, VARIANT_KEYS, price="exec_adj", signal="exec_sig")
    metrics = portfolio_metrics(daily, VARIANT_KEYS, totals=("trades",))
    runs = holding_runs(variants, rules.fee, VARIANT_KEYS, price="exec_adj", shown="exec_raw", signal="exec_sig")
    closed = ledger_summary(runs, VARIANT_KEYS).select(*VARIANT_KEYS, "mean_net", "win_share", "mean_holding")
    return metrics.join(closed, VARIANT_KEYS, "left").select(
        *VARIANT_KEYS, "annual_return", "sharpe", "max_drawdown", "trades", "mean_net", "win_share", "mean_holding"
    )


def timing_contributions(comparison: DataFrame) -> DataFrame:
    """Per factor: points per year earned overnight and intraday, and the share the last variant keeps."""
    def annual(variant: str):
        return F.max(F.when(F.col("variant") == variant, F.col("annual_return")))

    wide = comparison.groupBy(*KEYS).agg(*[annual(v).alias(v) for v in VARIANTS])
    return wide.select(
        *KEYS,
        ((F.col("close_t") - F.col("open_t1")) * 100).alias("overnight_pp"),
        ((F.col("open_t1") - F.col("close_t1")) * 100).alias("intraday_pp"),
        F.when(F.col("close_t") > 0, F.col("close_t1") / F.col("close_t")).alias("kept_share"),
    )
