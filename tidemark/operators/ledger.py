"""Trade ledger: one row per holding run, with the prices, ranks and returns of the trade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import broadcast_if_bounded
from tidemark.functions.windows import ratio
from tidemark.operators.portfolio import KEYS, Rules

# Column order of a ledger.
LEDGER_COLUMNS = [
    "instrument", "status", "entry_date", "entry_price", "exit_date", "exit_price", "holding_days",
    "factor_value_at_entry", "rank_at_entry", "universe_size_at_entry", "gross_return", "net_return",
    "exit_reason", "exit_rank",
]


def holding_runs(rows: DataFrame, fee: float, keys: list[str], price: str = "adj", shown: str = "raw",
                 signal: str = "sig") -> DataFrame:
    """Runs of signal 1 on each instrument's own rows → trades without ranks.

    A run is entered at the price of its first row and left at the price of the first
    row after it; a run that reaches the last row is open and marked there. A signal on
    the last row alone makes no trade. Entry cost is charged with the first return, exit
    cost after the exit.
    """
    series = Window.partitionBy(*keys, "instrument").orderBy("di")
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.lag(signal).over(series), F.lit(0))
    marked = rows.withColumns({
        "_starts": ((F.col(signal) == 1) & (before != 1)).cast("int"),
        "_leaves": (F.col(signal) != 1) & (before == 1),
        "_at": F.row_number().over(series),
        "_next": F.lead(price).over(series),
    }).withColumn("_run", F.sum("_starts").over(so_far))
    part = marked.where((F.col(signal) == 1) | F.col("_leaves"))
    entry_only = F.when(F.col("_starts") == 1, F.col(price))
    trades = part.groupBy(*keys, "instrument", "_run").agg(
        F.min("di").alias("entry_di"), F.min("date").alias("entry_date"), F.max("date").alias("_mark_date"),
        F.max("di").alias("_mark_di"),
        F.max(entry_only).alias("_c0"), F.max(F.when(F.col("_starts") == 1, F.col("_next"))).alias("_c1"),
        F.max_by(price, "_at").alias("_c2"),
        F.max(F.when(F.col("_starts") == 1, F.col(shown))).alias("entry_price"),
        F.max_by(shown, "_at").alias("exit_price"),
        (F.max("_at") - F.min("_at")).alias("holding_days"),
        F.max("_leaves").alias("_closed"),
    ).where(F.col("_c1").isNotNull())
    first = ratio(F.col("_c1"), F.col("_c0")) - F.lit(fee)
    after = ratio(F.col("_c2"), F.col("_c1"))
    exit_cost = F.when(F.col("_closed"), F.lit(1.0 - fee)).otherwise(F.lit(1.0))
    return trades.select(
        *keys, "instrument",
        F.when(F.col("_closed"), "closed").otherwise("open").alias("status"),
        "entry_di", "entry_date", "entry_price",
        F.when(F.col("_closed"), F.col("_mark_di")).alias("exit_di"),
        F.when(F.col("_closed"), F.col("_mark_date")).alias("exit_date"),
        "exit_price", "holding_days",
        (ratio(F.col("_c2"), F.col("_c0")) - 1).alias("gross_return"),
        (first * after * exit_cost - 1).alias("net_return"),
    )


def section_ranks(factors: DataFrame, points: DataFrame, directions: DataFrame,
                  bound: int | None = None) -> DataFrame:
    """Rank of single names in their cross-sections: (factor, span, di, instrument, value, rank, size).

    points: distinct (factor, span, di, instrument), a few per date and at most ``bound``
    in all. Each factor row of such a date is compared with that date's points and
    counted map-side; while the points are broadcast, the cross-sections are neither
    shuffled nor sorted.
    """
    at = [*KEYS, "di"]
    scored = factors.where(F.col("value").isNotNull()).join(
        F.broadcast(directions.select("factor", "direction")), "factor"
    ).select(
        *at, "instrument", "value",
        F.when(F.col("direction") == "bottom", F.col("value")).otherwise(-F.col("value")).alias("_score"),
    )
    own = scored.join(broadcast_if_bounded(points, bound), [*at, "instrument"], "left_semi")
    known = points.join(broadcast_if_bounded(own, bound), [*at, "instrument"], "left").select(
        *at, "instrument", "value", F.col("_score").alias("_own")
    )
    compared = scored.select(*at, "_score").join(broadcast_if_bounded(known, bound), at)
    return compared.groupBy(*at, "instrument", "value").agg(
        (F.count_if(F.col("_score") < F.col("_own")) + (F.count_if(F.col("_score") == F.col("_own")) + 1) / 2.0)
        .alias("_rank"),
        F.count(F.lit(1)).alias("size"),
    ).select(
        *at, "instrument", "value", F.when(F.col("value").isNotNull(), F.col("_rank")).alias("rank"), "size"
    )


def trade_ledger(rows: DataFrame, factors: DataFrame, directions: DataFrame, rules: Rules,
                 keys: list[str] = KEYS, price: str = "adj", shown: str = "raw", signal: str = "sig",
                 bound: int | None = None) -> DataFrame:
    """Trades of the signal rows with ranks and exit reasons."""
    trades = holding_runs(rows, rules.fee, keys, price, shown, signal)
    return explain_trades(trades, factors, directions, rules, keys, bound)


def explain_trades(trades: DataFrame, factors: DataFrame, directions: DataFrame, rules: Rules,
                   keys: list[str] = KEYS, bound: int | None = None) -> DataFrame:
    """Add entry value, rank and universe size, and the reason for the exit.

    factors: (factor, span, di, instrument, value) on all dates. A trade asks for two
    ranks, on its entry and on its exit date. ``bound``: most trades there can be.
    """
    visits_bound = None if bound is None else 2 * bound
    details = [c for c in trades.columns if c not in (*keys, "instrument")]
    visits = F.array_compact(F.array(
        F.struct(F.lit(True).alias("entry"), F.col("entry_di").alias("di")),
        F.when(F.col("exit_di").isNotNull(), F.struct(F.lit(False).alias("entry"), F.col("exit_di").alias("di"))),
    ))
    points = trades.select(*keys, "instrument", F.struct(*details).alias("_trade"), F.inline(visits))
    ranks = section_ranks(factors, points.select(*KEYS, "di", "instrument").distinct(), directions, visits_bound)
    ranked = points.join(broadcast_if_bounded(ranks, visits_bound), [*KEYS, "di", "instrument"], "left")
    entry = F.col("entry")
    joined = ranked.groupBy(*keys, "instrument", "_trade").agg(
        F.max(F.when(entry, F.col("value"))).alias("factor_value_at_entry"),
        F.max(F.when(entry, F.col("rank"))).alias("rank_at_entry"),
        F.coalesce(F.max(F.when(entry, F.col("size"))), F.lit(0)).alias("universe_size_at_entry"),
        F.max(F.when(~entry, F.col("rank"))).alias("exit_rank"),
    ).select(*keys, "instrument", "_trade.*", "factor_value_at_entry", "rank_at_entry",
             "universe_size_at_entry", "exit_rank")
    reason = (
        F.when(F.col("status") == "open", F.lit(""))
        .when(F.col("exit_rank").isNull(), F.lit("missing"))
        .when(F.col("exit_rank") > rules.band, F.lit("fell_out"))
        .otherwise(F.lit("rebalanced"))
    )
    return joined.withColumn("exit_reason", reason).select(*keys, *LEDGER_COLUMNS)


def ledger_summary(ledger: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per portfolio: trades, closed, open, mean net return, win share and mean holding time of closed trades."""
    closed = F.col("status") == "closed"
    return ledger.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(closed).alias("n_closed"),
        F.count_if(~closed).alias("n_open"),
        F.avg(F.when(closed, F.col("net_return"))).alias("mean_net"),
        F.avg(F.when(closed, (F.col("net_return") > 0).cast("double"))).alias("win_share"),
        F.avg(F.when(closed, F.col("holding_days").cast("double"))).alias("mean_holding"),
    )


def write_ledger(ledger: DataFrame, path: str) -> None:
    """One table for all factors, partitioned by factor."""
    ledger.write.mode("overwrite").partitionBy("factor").parquet(path)
