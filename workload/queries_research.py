"""Factors, rank ICs, portfolios, ledgers, timing and the model."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import average_rank, average_ranks
from tidemark.operators import factors, ic, model, portfolio, state
from tidemark.operators.features import add_label, ml_features
from tidemark.operators.timing import open_overrides, timing_contributions
from tidemark.operators.universe import UniverseSpec
from tidemark.plans.research import Research
from tidemark.session import intermediate_folder, store_intermediate
from tidemark.sources.versions import VersionedTable
from workload.oracle_research import SPLIT, metrics
from workload.queries_bars import W, _full, d
from workload.queries_universe import PIT
from workload.registry import query
from workload.tables import Tables

RULES = portfolio.Rules(top_n=5, rebalance_days=4, buffer_n=10)
IC_COLUMNS = "factor, date, n, round(rank_ic, 6) + 0.0 AS rank_ic"


def research(t: Tables, **options) -> Research:
    return Research(t.stored_panel, rules=RULES, **options)


def index_of(t: Tables) -> DataFrame:
    return portfolio.index_returns(t.index)


# -- factors and IC --------------------------------------------------------------

@query("volume_change_5d", f"""
SELECT date, instrument, {d('value')} FROM v_fac WHERE factor = 'volume_change_5d'""")
def volume_change_5d(t: Tables) -> DataFrame:
    return factors.factor_table(t.stored_panel, ("volume_change_5d",)).drop("factor")


K = "PARTITION BY instrument ORDER BY date"
LIBRARY = {
    "daily_return": "r",
    "momentum_5d": f"close / lag(close, 5) OVER ({K}) - 1",
    "momentum_10d": f"close / lag(close, 10) OVER ({K}) - 1",
    "momentum_20d": f"close / lag(close, 20) OVER ({K}) - 1",
    "ma_deviation_20d": f"close / ({_full('avg', 'close', 20, 'instrument')}) - 1",
    "volatility_20d": _full("stddev_samp", "r", 20, "instrument"),
    "realized_vol_10d": _full("stddev_samp", "r", 10, "instrument"),
    "risk_adjusted_momentum_20d":
        f"(close / lag(close, 20) OVER ({K}) - 1) / nullif({_full('stddev_samp', 'r', 20, 'instrument')}, 0)",
    "downside_deviation_20d": f"sqrt({_full('avg', 'neg2', 20, 'instrument')})",
    "obv_10d_change": f"CASE WHEN lag(close, 10) OVER ({K}) IS NOT NULL THEN sum(coalesce(sign(r), 0) * volume) OVER ({K} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END",
    "volume_change_5d": f"volume / nullif(lag(volume, 5) OVER ({K}), 0) - 1",
    "upper_shadow_ratio": "(high - greatest(open, close)) / nullif(high - low, 0)",
    "down_volume_share": f"{_full('sum', 'dv', 20, 'instrument')} / nullif({_full('sum', 'volume', 20, 'instrument')}, 0)",
    "gap_down_frequency": _full("avg", "gap", 20, "instrument"),
}


@query("factor_library", f"""
SELECT date, instrument, {', '.join(d(sql, name) for name, sql in LIBRARY.items())}
FROM (SELECT *, pow(least(r, 0), 2) AS neg2, CASE WHEN r < 0 THEN volume ELSE 0 END AS dv,
        CASE WHEN open < lag(low) OVER ({K}) THEN 1.0 WHEN lag(low) OVER ({K}) IS NOT NULL THEN 0.0 END AS gap
      FROM (SELECT *, close / lag(close) OVER ({K}) - 1 AS r FROM v_panel))""")
def factor_library(t: Tables) -> DataFrame:
    return factors.factor_table(t.stored_panel, tuple(LIBRARY), wide=True)


@query("factor_summary", f"""
SELECT factor, count(*) AS n_rows, count(DISTINCT instrument) AS n_instruments, min(date) AS "start", max(date) AS "end",
       {d('avg(value)', 'mean')}, {d('stddev_samp(value)', 'std')}, {d('min(value)', 'min')}, {d('max(value)', 'max')},
       {d('avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)', 'na_ratio')} FROM v_fac GROUP BY factor""")
def factor_summary(t: Tables) -> DataFrame:
    return factors.factor_summary(factors.factor_table(t.stored_panel))


@query("factor_state", f"""
SELECT factor, count(*) AS n_rows, min(date) AS "start", max(date) AS "end", {d('avg(value)', 'mean')}, {d('stddev_samp(value)', 'std')},
       {d('min(value)', 'min')}, {d('max(value)', 'max')}, {d('avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)', 'na_ratio')} FROM v_fac GROUP BY factor""")
def factor_state(t: Tables) -> DataFrame:
    """The summary from daily state that came in three deliveries, the days of one of them twice."""
    rows = store_intermediate(factors.factor_table(t.stored_panel).withColumn("delivery", F.year("date") % 3), "factor-days")
    table = VersionedTable(t.spark, f"{intermediate_folder(t.spark)}/state-{uuid.uuid4().hex}", state.KEY, buckets=4)
    state.add_days(table, rows.where("delivery = 0").withColumn("value", F.col("value") * 2))  # replaced by the next one
    for delivery in range(3):
        state.add_days(table, rows.where(F.col("delivery") == delivery))
    return state.summary_of_state(table.read(), ())


@query("forward_return", f"SELECT date, instrument, {d('fwd')} FROM fv_px LEFT JOIN fv_fwd USING (span, date, instrument)")
def forward_return(t: Tables) -> DataFrame:
    return research(t).returns.select("date", "instrument", "fwd")


@query("cross_rank", f"""
SELECT factor, date, instrument,
  CASE WHEN value IS NOT NULL THEN round(rank() OVER (PARTITION BY factor, date ORDER BY value)
    + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0, 6) + 0.0 END AS rank_up,
  CASE WHEN value IS NOT NULL THEN round(rank() OVER (PARTITION BY factor, date ORDER BY value DESC NULLS LAST)
    + (count(*) OVER (PARTITION BY factor, date, value) - 1) / 2.0, 6) + 0.0 END AS rank_down
FROM v_fac""")
def cross_rank(t: Tables) -> DataFrame:
    return average_ranks(factors.factor_table(t.stored_panel), ["factor", "date"], "value", "rank_up", "rank_down").drop("value")


HARD = """SELECT 'f' AS factor, date, instrument,
  CASE WHEN l % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l % 13 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l % 17 = 0 THEN CAST('-Infinity' AS DOUBLE)
       WHEN l % 19 = 0 THEN NULL WHEN l % 3 = 0 THEN 0.0 ELSE 100 + l / 10000000.0 END AS value,
  9007199254740992 + l % 1000 AS whole, CAST(volume AS DOUBLE) AS fwd
FROM (SELECT *, CAST(volume / 1000 AS BIGINT) + CAST(right(instrument, 3) AS BIGINT) AS l FROM v_panel)"""
CLEAN = f"(SELECT *, CASE WHEN value = CAST('NaN' AS DOUBLE) THEN NULL ELSE value END AS v FROM ({HARD}))"


@query("cross_rank_hard", f"""
SELECT date, instrument,
  CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY date ORDER BY v NULLS LAST) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 END AS rank_value,
  rank() OVER (PARTITION BY date ORDER BY whole DESC) + (count(*) OVER (PARTITION BY date, whole) - 1) / 2.0 AS rank_whole
FROM {CLEAN}""")
def cross_rank_hard(t: Tables) -> DataFrame:
    """Ranks with missing and infinite values, a third of the rows tied, values close together and longs above 2^53."""
    t.stored_panel.createOrReplaceTempView("v_panel")
    rows = t.spark.sql(HARD)
    up = average_rank(rows, ["date"], "value", "rank_value")
    return average_rank(up, ["date"], "whole", "rank_whole", descending=True).select("date", "instrument", "rank_value", "rank_whole")


@query("rank_ic_hard", f"""
SELECT date, count(*) AS n, round(covar_pop(rv, rf) / sqrt(var_pop(rv) * var_pop(rf)), 6) + 0.0 AS rank_ic
FROM (SELECT date, rank() OVER (PARTITION BY date ORDER BY v) + (count(*) OVER (PARTITION BY date, v) - 1) / 2.0 AS rv,
             rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS rf
      FROM {CLEAN} WHERE v IS NOT NULL AND fwd IS NOT NULL) GROUP BY date HAVING count(*) >= 5 AND var_pop(rv) > 0 AND var_pop(rf) > 0""")
def rank_ic_hard(t: Tables) -> DataFrame:
    t.stored_panel.createOrReplaceTempView("v_panel")
    return ic.daily_rank_ic(t.spark.sql(HARD)).drop("factor")


@query("rank_ic_daily", f"SELECT {IC_COLUMNS} FROM fv_ic")
def rank_ic_daily(t: Tables) -> DataFrame:
    return research(t).ics.drop("span")


SUMMARY = """SELECT factor, m AS ic_mean, m / s AS icir, p AS ic_pos_ratio, m / (s / sqrt(n)) AS t_stat, n AS n_days
FROM (SELECT factor, avg(rank_ic) AS m, stddev_samp(rank_ic) AS s, avg(CASE WHEN rank_ic > 0 THEN 1.0 ELSE 0.0 END) AS p,
        count(*) AS n FROM {0} GROUP BY factor) WHERE n >= 10 AND s > 0"""


@query("ic_summary", f"""
SELECT factor, {d('ic_mean')}, {d('icir')}, {d('ic_pos_ratio')}, {d('t_stat')}, n_days FROM ({SUMMARY.format('fv_ic')})""")
def ic_summary(t: Tables) -> DataFrame:
    return ic.ic_summary(research(t).ics)


STABILITY = f"""SELECT factor, is_ic, CASE WHEN n >= 10 AND s > 0 THEN m END AS oos_ic, CASE WHEN n >= 10 AND s > 0 THEN m / (s / sqrt(n)) END AS oos_t
FROM (SELECT factor, avg(rank_ic) FILTER (WHERE di <= {SPLIT}) AS is_ic, avg(rank_ic) FILTER (WHERE di > {SPLIT}) AS m,
   stddev_samp(rank_ic) FILTER (WHERE di > {SPLIT}) AS s, count(*) FILTER (WHERE di > {SPLIT}) AS n
 FROM fv_ic JOIN v_cal USING (date) GROUP BY factor)"""


@query("ic_stability", f"SELECT factor, {d('is_ic')}, {d('oos_ic')}, {d('oos_t')} FROM ({STABILITY})")
def ic_stability(t: Tables) -> DataFrame:
    return research(t).stability()


@query("auto_direction", f"SELECT factor, direction, {d('ic_mean')} FROM fv_dir")
def auto_direction(t: Tables) -> DataFrame:
    return research(t).directions


# -- selection -------------------------------------------------------------------

@query("rebalance_signals", """
SELECT factor, (di - 1) // 4 AS k, instrument, round(avg_rank, 6) + 0.0 AS avg_rank FROM fv_rank
WHERE (di - 1) % 4 = 0 AND avg_rank <= 5""")
def rebalance_signals(t: Tables) -> DataFrame:
    """Plain top-n without a buffer."""
    run = research(t)
    candidates = portfolio.rebalance_candidates(
        run.factors, run.directions, portfolio.Rules(top_n=5, rebalance_days=4)
    )
    return candidates.where(F.col("avg_rank") <= 5).select("factor", "k", "instrument", "avg_rank")


@query("rebalance_buffer", f"""
SELECT factor, k, array_to_string(list_sort(picks), ',') AS picks, {d('turnover')} FROM fv_hold""")
def rebalance_buffer(t: Tables) -> DataFrame:
    holdings = research(t).holdings
    return holdings.select("factor", "k", F.array_join(F.array_sort("picks"), ",").alias("picks"), "turnover")


# -- P&L -------------------------------------------------------------------------

SIGNAL = f"""
WITH s AS (SELECT symbol, date, close, CASE WHEN close > open THEN 1 WHEN close < open AND volume_shares < 20000 THEN -1 ELSE 0 END AS sig FROM v_dirty WHERE close IS NOT NULL),
a AS (SELECT *, coalesce(lag(sig) {W}, 0) AS pos, lag(close) {W} AS prev FROM s),
b AS (SELECT *, abs(pos - coalesce(lag(pos) {W}, 0)) AS traded FROM a),
pnl AS (SELECT symbol, date, pos AS position, traded, CASE WHEN prev > 0 THEN pos * (close / prev - 1) ELSE 0 END AS gross,
   CASE WHEN prev > 0 THEN pos * (close / prev - 1) - traded * 0.001425 ELSE 0 END AS net FROM b)"""


def _signal_pnl(t: Tables) -> DataFrame:
    rows = t.dirty.where(F.col("close").isNotNull()).withColumn(
        "sig", F.when(F.col("close") > F.col("open"), 1)
        .when((F.col("close") < F.col("open")) & (F.col("volume_shares") < 20000), -1).otherwise(0),
    )
    return portfolio.signal_pnl(rows, ["symbol"], "date", "close", F.col("sig"), 0.001425)


@query("signal_pnl", SIGNAL + f" SELECT symbol, date, position, traded, {d('gross')}, {d('net')} FROM pnl")
def signal_pnl(t: Tables) -> DataFrame:
    return _signal_pnl(t).select("symbol", "date", "position", "traded", "gross", "net")


@query("signal_metrics", SIGNAL + f""",
eq AS (SELECT *, product(1 + net) OVER (PARTITION BY symbol ORDER BY date) AS e FROM pnl),
pk AS (SELECT *, greatest(max(e) OVER (PARTITION BY symbol ORDER BY date), 1.0) AS p FROM eq),
m AS (SELECT symbol, arg_max(e, date) - 1 AS total, count(*) AS n, avg(net) FILTER (WHERE net <> 0) AS mean,
   coalesce(stddev_samp(net) FILTER (WHERE net <> 0), 0.0) AS sd, max(1 - e / p) AS mdd, count(*) FILTER (WHERE traded <> 0) AS trades,
   coalesce(avg(CASE WHEN net > 0 THEN 1.0 WHEN net < 0 THEN 0.0 END), 0.0) AS win FROM pk GROUP BY symbol)
SELECT symbol, {d('total', 'total_return')}, {d('CASE WHEN n > 2 THEN pow(1 + total, 252.0 / n) - 1 ELSE 0.0 END', 'annual_return')},
   {d('sd * sqrt(252.0)', 'volatility')}, {d('CASE WHEN sd > 0 THEN mean / sd * sqrt(252.0) ELSE 0.0 END', 'sharpe')},
   {d('mdd', 'max_drawdown')}, trades AS trade_count, {d('win', 'win_rate')} FROM m""")
def signal_metrics(t: Tables) -> DataFrame:
    return portfolio.signal_metrics(_signal_pnl(t), ["symbol"])


@query("portfolio_daily", f"""
SELECT factor, date, {d('net')}, {d('gross')}, trades FROM fv_daily WHERE variant = 'close_t'""")
def portfolio_daily(t: Tables) -> DataFrame:
    return research(t).daily.select("factor", "date", "net", "gross", "trades")


CURVE = """SELECT factor, date, eq, 1 - eq / max(eq) OVER (PARTITION BY factor ORDER BY date) AS dd FROM (
  SELECT factor, date, product(1 + net) OVER (PARTITION BY factor ORDER BY date) AS eq FROM fv_all)"""


@query("equity_curve", f"SELECT factor, date, {d('eq', 'equity')} FROM ({CURVE})")
def equity_curve(t: Tables) -> DataFrame:
    return portfolio.with_equity(research(t).named_daily, ["factor"]).select("factor", "date", "equity")


@query("drawdown", f"SELECT factor, date, {d('dd', 'drawdown')} FROM ({CURVE})")
def drawdown(t: Tables) -> DataFrame:
    return portfolio.with_equity(research(t).named_daily, ["factor"]).select("factor", "date", "drawdown")


METRICS = ", ".join(d(c) for c in ("total_return", "annual_return", "volatility", "sharpe", "max_drawdown", "win_rate"))


def _metrics_sql(p: str) -> str:
    return f"""
SELECT m.factor, coalesce(x.direction, (SELECT CASE WHEN count(DISTINCT direction) = 1 THEN min(direction) ELSE 'mixed' END FROM {p}v_dir)) AS direction,
       {METRICS}, n_days, t.trade_count,
       round(coalesce(h.t, (SELECT avg(t) FROM (SELECT avg(turnover) AS t FROM {p}v_hold GROUP BY factor))), 6) + 0.0 AS avg_turnover
FROM ({metrics(p + 'v_all', 'factor')}) m
JOIN (SELECT factor, CAST(sum(trades) AS BIGINT) AS trade_count FROM {p}v_all GROUP BY 1) t USING (factor)
LEFT JOIN {p}v_dir x USING (factor) LEFT JOIN (SELECT factor, avg(turnover) AS t FROM {p}v_hold GROUP BY 1) h USING (factor)"""


@query("portfolio_metrics", _metrics_sql("f"))
def portfolio_metrics(t: Tables) -> DataFrame:
    return research(t).metrics().drop("span")


@query("portfolio_metrics_short", _metrics_sql("s"))
def portfolio_metrics_short(t: Tables) -> DataFrame:
    """Short positions in the highest values; costs reduce the return on this side as well."""
    return research(t, direction="short").metrics().drop("span")


@query("portfolio_pit", PIT + f""",
s AS (SELECT f.factor, f.di, f.instrument, CASE WHEN x.direction = 'bottom' THEN f.value ELSE -f.value END AS score
  FROM fv_fx f JOIN pit p ON p.date = f.date AND p.instrument = f.instrument
  JOIN (SELECT 'ma_deviation_20d' AS factor, 'bottom' AS direction UNION ALL SELECT 'volume_change_5d', 'bottom') x USING (factor)
  WHERE f.value IS NOT NULL AND (f.di - 1) % 4 = 0),
r AS (SELECT *, rank() OVER (PARTITION BY factor, di ORDER BY score) + (count(*) OVER (PARTITION BY factor, di, score) - 1) / 2.0 AS avg_rank FROM s)
SELECT factor, (di - 1) // 4 AS k, instrument, {d('avg_rank')} FROM r WHERE avg_rank <= 10""")
def portfolio_pit(t: Tables) -> DataFrame:
    """Selection candidates inside the point-in-time universe."""
    run = research(t, direction="bottom", universe=UniverseSpec.pit_liquidity(30, 12, 20))
    candidates = portfolio.rebalance_candidates(run.factors, run.directions, RULES)
    return candidates.where(F.col("avg_rank") <= 10).select("factor", "k", "instrument", "avg_rank")


def pit_research(t: Tables) -> Research:
    return research(t, direction="bottom", universe=UniverseSpec.pit_liquidity(30, 12, 20))


@query("portfolio_pit_metrics", _metrics_sql("u"))
def portfolio_pit_metrics(t: Tables) -> DataFrame:
    """The whole backtest inside the point-in-time universe."""
    return pit_research(t).metrics().drop("span")


@query("equal_weight_benchmark", f"SELECT date, {d('ret')} FROM fv_ew")
def equal_weight_benchmark(t: Tables) -> DataFrame:
    return research(t).equal_weight.select("date", "ret")


@query("index_cache", f"""
WITH merged AS (SELECT date, close FROM v_index WHERE close > 0
  UNION ALL SELECT date, 1.0 FROM (SELECT DISTINCT date FROM v_bars) WHERE date < DATE '1997-01-01' AND date >= DATE '1996-06-01'),
inside AS (SELECT * FROM merged WHERE date BETWEEN DATE '1996-11-01' AND DATE '1998-03-31')
SELECT date, {d('close / lag_ - 1', 'ret')}, 'price' AS source FROM (SELECT *, lag(close) OVER (ORDER BY date) AS lag_ FROM inside) WHERE lag_ IS NOT NULL""")
def index_cache(t: Tables) -> DataFrame:
    """A cache that ends too early, a preferred source without levels, and a fallback."""
    cache = t.bars.where("date < DATE '1997-01-01' AND date >= DATE '1996-06-01'").select("date").distinct().select(
        "date", F.lit(1.0).alias("close"), F.lit("old").alias("source"))
    sources = [("total_return", t.index.select("date", F.lit(0.0).alias("close"))), ("price", t.index)]
    return portfolio.index_levels(cache, sources, "1996-11-01", "1998-03-31")[1]


@query("factor_folder", f"""
SELECT factor, count(*) AS n_rows, {d('avg(value)', 'mean')}, CAST(NULL AS VARCHAR) AS reason FROM v_fac GROUP BY factor
UNION ALL SELECT 'keyless', NULL, NULL, 'keyless: needs a date and an instrument column'
UNION ALL SELECT 'twice', NULL, NULL, 'two rows for a date and instrument'""")
def factor_folder(t: Tables) -> DataFrame:
    """Factor outputs written to a folder, two of them unusable, and read back."""
    folder = f"{intermediate_folder(t.spark)}/factors-{uuid.uuid4().hex}"
    rows = factors.factor_table(t.stored_panel)
    for name in factors.DEFAULT_FACTORS:
        rows.where(F.col("factor") == name).select("instrument", F.col("date").alias("datetime"), F.col("value").alias(name)).write.parquet(f"{folder}/{name}")
    one = t.panel.select("date", "instrument", "close")
    one.union(one).write.parquet(f"{folder}/twice")
    one.select("date", "close").write.parquet(f"{folder}/keyless")
    loaded, rejected = factors.load_factor_folder(t.spark, folder)
    found = loaded.groupBy("factor").agg(F.count("*").alias("n_rows"), F.avg("value").alias("mean"))
    return found.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejected.select("factor", F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("double").alias("mean"), "reason"))


@query("benchmark_align", f"SELECT date, {d('ret')}, 'index' AS label FROM fv_bench")
def benchmark_align(t: Tables) -> DataFrame:
    return research(t).benchmark(index_of(t)).select("date", "ret", "label")


YEARS = f"""
SELECT p.factor, CAST(p.year AS INTEGER) AS year, p.total_return AS year_return, p.sharpe AS year_sharpe, p.max_drawdown AS year_mdd,
       b.total_return AS bench_return, b.max_drawdown AS bench_mdd, p.total_return - b.total_return AS excess
FROM ({metrics('(SELECT *, year(date) AS year FROM fv_all)', 'factor, year')}) p
LEFT JOIN ({metrics('(SELECT *, year(date) AS year FROM fv_bench)', 'year', 'ret')}) b ON b.year = p.year"""


@query("yearly_stats", f"""
SELECT factor, year, {d('year_return')}, {d('year_sharpe')}, {d('year_mdd')}, {d('bench_return')}, {d('bench_mdd')}, {d('excess')}
FROM ({YEARS})""")
def yearly_stats(t: Tables) -> DataFrame:
    return research(t).years(index_of(t))


@query("combined_portfolio", f"SELECT date, {d('net')}, {d('gross')}, CAST(trades AS BIGINT) AS trades FROM fv_all WHERE factor = 'combined'")
def combined_portfolio(t: Tables) -> DataFrame:
    return research(t).combined.select("date", "net", "gross", "trades")


EROSION = f"""SELECT a.factor, a.annual_return AS net_annual, b.annual_return AS gross_annual, (b.annual_return - a.annual_return) * 100 AS erosion_pp
FROM ({metrics('fv_all', 'factor')}) a JOIN ({metrics('fv_all', 'factor', 'gross')}) b USING (factor)"""


@query("cost_erosion", f"SELECT factor, {d('net_annual')}, {d('gross_annual')}, {d('erosion_pp')} FROM ({EROSION})")
def cost_erosion(t: Tables) -> DataFrame:
    return research(t).erosion().drop("span")


@query("interpretation_flags", f"""
SELECT factor AS subject, CASE WHEN oos_ic IS NULL THEN 'short_sample' WHEN is_ic IS NOT NULL AND (is_ic >= 0) <> (oos_ic >= 0) THEN 'sign_flip'
  WHEN abs(oos_t) < 2 THEN 'insignificant' ELSE 'confirmed' END AS flag, {d('oos_t', 'value')} FROM ({STABILITY})
UNION ALL
SELECT factor, CASE WHEN erosion_pp > 3 THEN 'erosion_high' WHEN erosion_pp > 0 THEN 'erosion_low' ELSE 'no_erosion' END, {d('erosion_pp', 'value')}
FROM ({EROSION}) WHERE factor = 'combined'
UNION ALL
SELECT * FROM (SELECT 'combined', 'best_year_' || year, {d('excess', 'value')} FROM ({YEARS}) WHERE factor = 'combined' AND excess IS NOT NULL
  ORDER BY excess DESC, year LIMIT 1)
UNION ALL
SELECT 'combined', CASE WHEN p.max_drawdown > b.max_drawdown THEN 'deeper_than_benchmark' ELSE 'within_benchmark' END, {d('p.max_drawdown', 'value')}
FROM ({metrics('fv_all', 'factor')}) p, ({metrics('fv_bench', '', 'ret')}) b WHERE p.factor = 'combined'""")
def interpretation_flags(t: Tables) -> DataFrame:
    return research(t).interpretation(index_of(t))


# -- trades, timing, out of sample -------------------------------------------------

LEDGER = f"""factor, instrument, status, entry_date, {d('entry_price')}, exit_date, {d('exit_price')}, CAST(holding_days AS INTEGER) AS holding_days,
  {d('factor_value_at_entry')}, {d('rank_at_entry')}, universe_size_at_entry, {d('gross_return')}, {d('net_return')}, exit_reason, {d('exit_rank')}"""


@query("trade_ledger", f"SELECT {LEDGER} FROM fv_ledger WHERE variant = 'close_t'")
def trade_ledger(t: Tables) -> DataFrame:
    return research(t).ledger().drop("span")


@query("portfolio_pit_ledger", f"SELECT {LEDGER} FROM uv_ledger WHERE variant = 'close_t'")
def portfolio_pit_ledger(t: Tables) -> DataFrame:
    return pit_research(t).ledger().drop("span")


def _ledger_stats(keys: str, source: str) -> str:
    return f"""SELECT {keys}, count(*) AS n_trades, count(*) FILTER (WHERE status = 'closed') AS n_closed,
  count(*) FILTER (WHERE status = 'open') AS n_open, avg(net_return) FILTER (WHERE status = 'closed') AS mean_net,
  avg(CASE WHEN net_return > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE status = 'closed') AS win_share,
  avg(holding_days) FILTER (WHERE status = 'closed') AS mean_holding FROM {source} GROUP BY {keys}"""


@query("ledger_summary", f"""
SELECT factor, n_trades, n_closed, n_open, {d('mean_net')}, {d('win_share')}, {d('mean_holding')}
FROM ({_ledger_stats('factor', "(SELECT * FROM fv_ledger WHERE variant = 'close_t')")})""")
def ledger_totals(t: Tables) -> DataFrame:
    return research(t).ledger_report().drop("span")


@query("exec_overrides", f"""
SELECT factor, date, instrument, sig AS exec_sig, {d('adj', 'exec_adj')}, {d('raw', 'exec_raw')} FROM fv_vars WHERE variant = 'open_t1'""")
def exec_overrides(t: Tables) -> DataFrame:
    return open_overrides(research(t).rows).select("factor", "date", "instrument", "exec_sig", "exec_adj", "exec_raw")


TIMING = f"""SELECT m.factor, m.variant, annual_return, sharpe, max_drawdown, t.trades, l.mean_net, l.win_share, l.mean_holding
FROM ({metrics('fv_daily', 'factor, variant')}) m
JOIN (SELECT factor, variant, CAST(sum(trades) AS BIGINT) AS trades FROM fv_daily GROUP BY 1, 2) t ON t.factor = m.factor AND t.variant = m.variant
LEFT JOIN ({_ledger_stats('factor, variant', 'fv_ledger')}) l ON l.factor = m.factor AND l.variant = m.variant"""


@query("exec_timing", f"""
SELECT factor, variant, {d('annual_return')}, {d('sharpe')}, {d('max_drawdown')}, trades, {d('mean_net')}, {d('win_share')}, {d('mean_holding')}
FROM ({TIMING})""")
def exec_timing(t: Tables) -> DataFrame:
    return research(t).timing().drop("span")


@query("timing_contributions", f"""
SELECT factor, {d('(a - b) * 100', 'overnight_pp')}, {d('(b - c) * 100', 'intraday_pp')}, {d('CASE WHEN a > 0 THEN c / a END', 'kept_share')}
FROM (SELECT factor, max(annual_return) FILTER (WHERE variant = 'close_t') AS a, max(annual_return) FILTER (WHERE variant = 'open_t1') AS b,
   max(annual_return) FILTER (WHERE variant = 'close_t1') AS c FROM ({TIMING}) GROUP BY factor)""")
def contributions(t: Tables) -> DataFrame:
    return timing_contributions(research(t).timing()).drop("span")


@query("oos_evaluation", f"""
WITH n AS ({metrics('ov_all', 'factor, span')}), g AS ({metrics('ov_all', 'factor, span', 'gross')}),
b AS ({metrics("(SELECT * FROM ov_bench WHERE span = 'oos')", '', 'ret')}),
c AS (SELECT factor, avg(rank_ic) AS m, stddev_samp(rank_ic) AS s, count(*) AS cnt FROM ov_ic WHERE span = 'oos' GROUP BY factor)
SELECT o.factor, coalesce(x.direction, 'mixed') AS direction, {d('o.annual_return', 'oos_annual')}, {d('o.sharpe', 'oos_sharpe')},
  {d('o.max_drawdown', 'oos_mdd')}, {d('og.annual_return', 'oos_gross_annual')}, {d('i.annual_return', 'is_annual')},
  {d('b.annual_return', 'bench_annual')}, {d('o.annual_return - b.annual_return', 'oos_excess')},
  {d('CASE WHEN cnt > 10 AND s > 0 THEN m END', 'oos_ic')}, {d('CASE WHEN cnt > 10 AND s > 0 THEN m / (s / sqrt(cnt)) END', 'oos_ic_t')}
FROM n o JOIN g og ON og.factor = o.factor AND og.span = 'oos' JOIN n i ON i.factor = o.factor AND i.span = 'is', b
LEFT JOIN ov_dir x ON x.factor = o.factor LEFT JOIN c ON c.factor = o.factor WHERE o.span = 'oos'""")
def oos_evaluation(t: Tables) -> DataFrame:
    return research(t, is_ratio=0.7).out_of_sample(index_of(t))


@query("oos_ledger", f"SELECT {LEDGER} FROM ov_ledger WHERE variant = 'close_t' AND span = 'oos'")
def oos_ledger(t: Tables) -> DataFrame:
    return research(t, is_ratio=0.7).ledger().where(F.col("span") == "oos").drop("span")


# -- model -----------------------------------------------------------------------

@query("model_time_split", """
SELECT part, count(*) AS n, min(date) AS "start", max(date) AS "end" FROM (
  SELECT date, CASE WHEN di <= floor((SELECT count(DISTINCT date) FROM v_bars) * 0.8) THEN 'train' ELSE 'test' END AS part
  FROM v_bars JOIN (SELECT date, row_number() OVER (ORDER BY date) AS di FROM (SELECT DISTINCT date FROM v_bars)) USING (date)) GROUP BY part""")
def model_time_split(t: Tables) -> DataFrame:
    train, test = model.split_by_time(t.bars)
    parts = train.select("date", F.lit("train").alias("part")).unionByName(test.select("date", F.lit("test").alias("part")))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("end"))


@query("model_linear_ic", f"""
SELECT date, n, {d('covar_pop(rv, rf) / sqrt(var_pop(rv) * var_pop(rf))', 'rank_ic')} FROM (
  SELECT date, count(*) OVER (PARTITION BY date) AS n,
         rank() OVER (PARTITION BY date ORDER BY value) + (count(*) OVER (PARTITION BY date, value) - 1) / 2.0 AS rv,
         rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS rf
  FROM (SELECT date, CAST(volume_shares AS DOUBLE) + 1000 * trade_count AS value, lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS fwd FROM v_bars)
  WHERE fwd IS NOT NULL)
GROUP BY date, n HAVING n >= 2 AND var_pop(rv) > 0 AND var_pop(rf) > 0""")
def model_linear_ic(t: Tables) -> DataFrame:
    """The judgement of a model, on a fixed linear score in place of trees."""
    scored = add_label(t.bars).select("symbol", "date", (F.col("volume_shares").cast("double") + 1000 * F.col("trade_count")).alias("score"),
                                      F.col("label_ret_1f").alias("label"))
    return model.model_rank_ic(scored).drop("factor")


@query("model_rank_ic")
def model_rank_ic(t: Tables) -> DataFrame:
    """Trees fitted on the first 80 % of the dates, scored on the rest."""
    table = store_intermediate(ml_features(t.bars, t.institutional, t.margin), "features")  # dates, split, fit and scores read it
    train, test = model.split_by_time(table)
    return model.model_rank_ic(model.score(model.fit(train, max_iter=5), test)).drop("factor")
