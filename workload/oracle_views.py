"""The views of ``tables.py`` as DuckDB common table expressions.

``oracle(body)`` prepends the expressions a query needs, in dependency order.
"""

from __future__ import annotations

import re

SYMBOL = "CASE WHEN length(CAST({0} AS VARCHAR)) < 4 THEN lpad(CAST({0} AS VARCHAR), 4, '0') ELSE CAST({0} AS VARCHAR) END"
MARKET = "CASE WHEN {0} % 3 = 0 THEN 'OTC' ELSE 'TSE' END"

VIEWS: dict[str, str] = {}

VIEWS["v_trades"] = """
SELECT *, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
       CAST(round((1 + l_discount - l_tax) * 100) AS BIGINT) AS tick,
       ((date_diff('day', CAST(date_trunc('week', l_shipdate) AS DATE), CAST(l_shipdate AS DATE)) * 1099511627776
         + l_orderkey) * 8 + l_linenumber) * 32 + CAST(round((1 + l_discount - l_tax) * 100) AS BIGINT) - 90 AS seq,
       l_quantity * 1000 AS shares
FROM lineitem"""

VIEWS["v_bars"] = f"""
SELECT {SYMBOL.format('l_suppkey')} AS symbol, {MARKET.format('l_suppkey')} AS market,
       {MARKET.format('l_suppkey')} || {SYMBOL.format('l_suppkey')} AS instrument, date,
       CAST(arg_min(tick, seq) AS DOUBLE) AS open, CAST(max(tick) AS DOUBLE) AS high,
       CAST(min(tick) AS DOUBLE) AS low, CAST(arg_max(tick, seq) AS DOUBLE) AS close,
       CAST(sum(shares) AS BIGINT) AS volume_shares, round(sum(l_extendedprice), 2) AS turnover_twd,
       count(*) AS trade_count, 'twse' AS source
FROM v_trades GROUP BY l_suppkey, date"""

VIEWS["v_cal"] = "SELECT date, row_number() OVER (ORDER BY date) AS di FROM (SELECT DISTINCT date FROM v_trades)"


def _flow(condition: str, name: str) -> str:
    return f"sum(CASE WHEN {condition} THEN shares ELSE 0 END) AS {name}"


VIEWS["v_inst"] = f"""
SELECT {SYMBOL.format('l_suppkey')} AS symbol, date,
       {_flow("l_returnflag = 'R'", 'foreign_buy')}, {_flow("l_returnflag = 'A'", 'foreign_sell')},
       {_flow("l_returnflag = 'N' AND l_linestatus = 'O'", 'investment_trust_buy')},
       {_flow("l_returnflag = 'N' AND l_linestatus = 'F'", 'investment_trust_sell')},
       {_flow("l_linenumber % 2 = 0", 'dealer_buy')}, {_flow("l_linenumber % 2 = 1", 'dealer_sell')}
FROM v_trades GROUP BY l_suppkey, date"""

VIEWS["v_inst2"] = """
SELECT symbol, date, foreign_buy, foreign_sell * 1.02 AS foreign_sell, investment_trust_buy, investment_trust_sell,
       dealer_buy, CASE WHEN dealer_sell >= 20000 THEN dealer_sell END AS dealer_sell
FROM v_inst"""

VIEWS["v_margin"] = f"""
SELECT {SYMBOL.format('l_suppkey')} AS symbol, date,
       {_flow("l_linenumber <= 4", 'margin_balance')}, {_flow("l_linenumber = 1", 'margin_buy')},
       {_flow("l_linenumber = 2", 'margin_sell')}, {_flow("l_linenumber > 4", 'short_balance')},
       {_flow("l_linenumber = 5", 'short_sell')}, {_flow("l_linenumber = 6", 'short_cover')}
FROM v_trades GROUP BY l_suppkey, date"""

VIEWS["v_second"] = """
SELECT symbol, market, instrument, date, open, high, low,
       CASE WHEN close = high THEN close * 1.01 ELSE close END AS close,
       CASE WHEN open = low THEN volume_shares + 1000 ELSE volume_shares END AS volume_shares,
       turnover_twd, trade_count, source
FROM v_bars WHERE trade_count >= 2"""

VIEWS["v_dirty"] = """
SELECT symbol, market, instrument, date,
       CASE WHEN trade_count = 1 AND close > 105 THEN NULL ELSE open END AS open,
       CASE WHEN trade_count >= 3 AND open = high THEN low - 1 ELSE high END AS high, low,
       CASE WHEN trade_count = 1 AND close < 95 THEN 0.0 WHEN trade_count = 1 AND close = 100 THEN NULL
            ELSE close END AS close,
       volume_shares, turnover_twd, trade_count, source
FROM v_bars"""

VIEWS["v_ticks"] = """
SELECT CAST(user_id AS VARCHAR) AS symbol, ts AS timestamp, value AS price, 1 AS size_shares, event_id FROM events"""

VIEWS["v_suppliers"] = f"""
SELECT s_suppkey, {SYMBOL.format('s_suppkey')} AS symbol, s_name AS name, {MARKET.format('s_suppkey')} AS market,
       s_nationkey, s_acctbal, {MARKET.format('s_suppkey')} || {SYMBOL.format('s_suppkey')} AS instrument
FROM supplier"""

VIEWS["v_instruments"] = """
SELECT s.symbol, s.name, s.market, n.n_name AS industry, CAST(NULL AS DATE) AS list_date,
       CAST(NULL AS DATE) AS delist_date, 'active' AS status, l.snapshot_date
FROM v_suppliers s JOIN nation n ON n.n_nationkey = s.s_nationkey
LEFT JOIN (SELECT l_suppkey, CAST(max(l_shipdate) AS DATE) AS snapshot_date FROM lineitem GROUP BY 1) l
  ON l.l_suppkey = s.s_suppkey"""

VIEWS["v_quotes"] = """
SELECT b.symbol, s.name, b.date, b.close, b.volume_shares, b.turnover_twd FROM v_bars b JOIN v_suppliers s USING (symbol)"""

VIEWS["v_month_sample"] = """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS sample_date FROM v_cal GROUP BY 1"""

VIEWS["v_seen"] = """
SELECT DISTINCT q.symbol, q.name, q.date AS seen_date FROM v_quotes q JOIN v_month_sample m ON m.sample_date = q.date"""

VIEWS["v_delist"] = """
SELECT symbol, name, make_date(1997 + s_nationkey % 4, 6, 15) AS delist_date FROM v_suppliers WHERE s_acctbal < 2000"""

VIEWS["v_divs"] = """
SELECT s.instrument, make_date(y.year, 6, 15) AS ex_date, 1.0 + (s.s_suppkey % 5) * 0.5 AS cash,
       CASE WHEN s.s_suppkey % 4 = 0 THEN 0.1 ELSE 0.0 END AS ratio
FROM v_suppliers s,
     (SELECT unnest(range(min(year(date)), max(year(date)) + 1)) AS year FROM v_cal) y"""

VIEWS["v_events"] = """
SELECT instrument, ex_date, least(greatest((1 - cash / prev) / (1 + ratio), 0.05), 1.0) AS f
FROM (SELECT d.instrument, d.ex_date, CAST(d.cash AS DOUBLE) AS cash, CAST(d.ratio AS DOUBLE) AS ratio,
             arg_max(b.close, b.date) AS prev
      FROM v_divs d JOIN v_bars b ON b.instrument = d.instrument AND b.date < d.ex_date AND b.close > 0
      GROUP BY ALL)
WHERE prev > cash / 10"""

VIEWS["v_factor"] = """
SELECT b.instrument, b.date, coalesce(product(e.f), 1.0) AS factor
FROM v_bars b LEFT JOIN v_events e ON e.instrument = b.instrument AND e.ex_date > b.date GROUP BY 1, 2"""

VIEWS["v_panel"] = """
SELECT b.date, b.instrument, b.open, b.close, b.high, b.low, CAST(b.volume_shares AS DOUBLE) AS volume,
       round(f.factor, 6) AS factor
FROM v_bars b JOIN v_factor f USING (instrument, date)"""

VIEWS["v_index"] = """
SELECT date, round(sum(turnover_twd) / sum(volume_shares) * 1000, 4) AS close
FROM v_bars WHERE date >= DATE '1997-01-01' GROUP BY date"""

VIEWS["v_horizon"] = "SELECT max(date) AS d FROM v_cal"

_NAME = re.compile(r"\b[a-z0-9]*v_[a-z0-9_]+\b")


def _needed(sql: str, found: list[str], inside: tuple[str, ...] = ()) -> list[str]:
    for name in _NAME.findall(sql):
        if name in VIEWS and name not in found and name not in inside:
            _needed(VIEWS[name], found, (*inside, name))
            found.append(name)
    return found


def oracle(body: str) -> str:
    """The query with the views it uses."""
    names = _needed(body, [])
    if not names:
        return body.strip()
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = f"SELECT * FROM (\n{body}\n)"
    return f"WITH RECURSIVE {views}\n{body}"
