"""Research views: factors, rank ICs, selection with hold buffer, P&L and ledger, in SQL.

``chain(p, spans)`` adds one family of views with prefix ``p``; a family has its own
spans (full sample, or in-sample and out-of-sample) and therefore its own grid.
"""

from __future__ import annotations

from workload.oracle_views import VIEWS

# Parameters shared with the Spark side.
TOP, EVERY, BAND, AHEAD = 5, 4, 10, 5
FEE = 0.001425 + 0.003 / 2

VIEWS["v_prices"] = """
SELECT p.*, CASE WHEN close > 0 AND close * factor > 0 THEN close * factor END AS adj,
       CASE WHEN close > 0 AND close * factor > 0 THEN close END AS raw,
       open * factor AS adj_open, open AS raw_open, c.di AS cdi
FROM v_panel p JOIN v_cal c USING (date)"""

VIEWS["v_fac"] = """
SELECT 'ma_deviation_20d' AS factor, date, instrument, close / (CASE WHEN count(close) OVER k = 20 THEN avg(close) OVER k END) - 1 AS value
FROM v_panel WINDOW k AS (PARTITION BY instrument ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
UNION ALL
SELECT 'volume_change_5d', date, instrument, volume / nullif(lag(volume, 5) OVER (PARTITION BY instrument ORDER BY date), 0) - 1
FROM v_panel"""


def chain(p: str, spans: str, deciding: str = "TRUE", fixed: str | None = None, fee: float = FEE,
          universe: str | None = None) -> None:
    v = VIEWS
    v[f"{p}v_spans"] = spans
    v[f"{p}v_px"] = f"SELECT x.*, s.span, s.di FROM v_prices x JOIN {p}v_spans s USING (date)"
    v[f"{p}v_fwd"] = f"""
SELECT a.span, a.date, a.di, a.instrument, b.adj / a.adj - 1 AS fwd
FROM {p}v_px a JOIN {p}v_px b ON b.instrument = a.instrument AND b.span = a.span AND b.di = a.di + {AHEAD}
WHERE a.adj IS NOT NULL AND b.adj IS NOT NULL"""
    v[f"{p}v_fx"] = f"SELECT f.factor, s.span, s.di, f.date, f.instrument, f.value FROM v_fac f JOIN {p}v_spans s USING (date)"
    if universe is not None:
        v[f"{p}v_fx"] += f" JOIN {universe} u ON u.date = f.date AND u.instrument = f.instrument"
    v[f"{p}v_pairs"] = f"""
SELECT f.factor, f.span, f.date,
       rank() OVER (PARTITION BY f.factor, f.span, f.date ORDER BY f.value) + (count(*) OVER (PARTITION BY f.factor, f.span, f.date, f.value) - 1) / 2.0 AS rv,
       rank() OVER (PARTITION BY f.factor, f.span, f.date ORDER BY r.fwd) + (count(*) OVER (PARTITION BY f.factor, f.span, f.date, r.fwd) - 1) / 2.0 AS rf
FROM {p}v_fx f JOIN {p}v_fwd r USING (span, date, instrument) WHERE f.value IS NOT NULL"""
    v[f"{p}v_ic"] = f"""
SELECT factor, span, date, count(*) AS n, covar_pop(rv, rf) / sqrt(var_pop(rv) * var_pop(rf)) AS rank_ic
FROM {p}v_pairs GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND var_pop(rv) > 0 AND var_pop(rf) > 0"""
    v[f"{p}v_names"] = f"""
SELECT n.factor, s.span, s.n_days FROM (SELECT unnest(['ma_deviation_20d', 'volume_change_5d']) AS factor) n,
  (SELECT span, max(di) AS n_days FROM {p}v_spans GROUP BY span) s"""
    v[f"{p}v_dir"] = f"""
SELECT n.factor, CASE WHEN i.m >= 0 THEN 'top' ELSE 'bottom' END AS direction, i.m AS ic_mean
FROM (SELECT DISTINCT factor FROM {p}v_names) n
LEFT JOIN (SELECT factor, avg(rank_ic) AS m FROM {p}v_ic WHERE {deciding} GROUP BY 1) i USING (factor)"""
    if fixed is not None:
        v[f"{p}v_dir"] = f"SELECT DISTINCT factor, '{fixed}' AS direction FROM {p}v_names"
    side = -1 if fixed == "short" else 1
    v[f"{p}v_score"] = f"""
SELECT f.*, CASE d.direction WHEN 'bottom' THEN f.value ELSE -f.value END AS score
FROM {p}v_fx f JOIN {p}v_dir d USING (factor) WHERE f.value IS NOT NULL"""
    v[f"{p}v_rank"] = f"""
SELECT *, rank() OVER (PARTITION BY factor, span, di ORDER BY score) + (count(*) OVER (PARTITION BY factor, span, di, score) - 1) / 2.0 AS avg_rank,
       row_number() OVER (PARTITION BY factor, span, di ORDER BY score, instrument) AS pos,
       count(*) OVER (PARTITION BY factor, span, di) AS size
FROM {p}v_score"""
    v[f"{p}v_days"] = f"""
SELECT g.factor, g.span, g.k, coalesce(c.rows, []) AS rows FROM
  (SELECT factor, span, unnest(range(0, (n_days - 1) // {EVERY} + 1)) AS k FROM {p}v_names) g
LEFT JOIN (SELECT factor, span, (di - 1) // {EVERY} AS k,
       list({{'i': instrument, 'r': avg_rank}} ORDER BY pos) AS rows
  FROM {p}v_rank WHERE (di - 1) % {EVERY} = 0 AND (avg_rank <= {BAND} OR pos <= {TOP}) GROUP BY 1, 2, 3) c USING (factor, span, k)"""
    held = "list_filter(d.rows, lambda x: x.r <= {0} AND list_contains(h.picks, x.i))".format(BAND)
    names = f"list_transform({held}, lambda x: x.i)"
    others = f"list_filter(d.rows, lambda x: NOT (x.r <= {BAND} AND list_contains(h.picks, x.i)))"
    fresh = f"list_filter(list_slice({others}, 1, {TOP} - len({held})), lambda x: x.r <= {BAND})"
    picks = f"list_concat({names}, list_transform({fresh}, lambda x: x.i))"
    v[f"{p}v_hold"] = f"""
SELECT factor, span, k, list_transform(list_slice(rows, 1, {TOP}), lambda x: x.i) AS picks, CAST(NULL AS DOUBLE) AS turnover
FROM {p}v_days WHERE k = 0
UNION ALL
SELECT d.factor, d.span, d.k, {picks} AS picks,
       CASE WHEN len(d.rows) > 0 THEN 1.0 - len(list_intersect(h.picks, {picks})) / {TOP}.0 END AS turnover
FROM {p}v_hold h JOIN {p}v_days d ON d.factor = h.factor AND d.span = h.span AND d.k = h.k + 1"""
    v[f"{p}v_picked"] = f"SELECT factor, span, k, unnest(picks) AS instrument FROM {p}v_hold"
    v[f"{p}v_sig"] = f"""
SELECT e.factor, x.span, x.date, x.di, x.instrument, x.adj, x.raw, x.adj_open, x.raw_open,
       CASE WHEN h.instrument IS NULL THEN 0 ELSE 1 END AS sig,
       CASE WHEN l.instrument IS NULL THEN 0 ELSE 1 END AS late
FROM (SELECT *, count(*) OVER (PARTITION BY span, instrument) AS cnt FROM {p}v_px WHERE adj IS NOT NULL) x
JOIN (SELECT DISTINCT factor, span, instrument FROM {p}v_picked) e USING (span, instrument)
LEFT JOIN {p}v_picked h ON h.factor = e.factor AND h.span = x.span AND h.instrument = x.instrument AND h.k = (x.di - 1) // {EVERY}
LEFT JOIN {p}v_picked l ON l.factor = e.factor AND l.span = x.span AND l.instrument = x.instrument AND l.k = CAST(floor((x.di - 2) / {EVERY}.0) AS BIGINT)
WHERE x.cnt >= 3"""
    v[f"{p}v_vars"] = f"""
SELECT factor, span, date, di, instrument, 'close_t' AS variant, sig, adj, raw FROM {p}v_sig
UNION ALL
SELECT factor, span, date, di, instrument, 'close_t1', late, adj, raw FROM {p}v_sig
UNION ALL
SELECT factor, span, date, di, instrument, 'open_t1', CASE WHEN leaves AND next_open THEN 1 ELSE sig END,
       CASE WHEN coalesce(lag(leaves AND next_open) OVER k, false) THEN adj_open WHEN enters AND next_open THEN lead(adj_open) OVER k ELSE adj END,
       CASE WHEN coalesce(lag(leaves AND next_open) OVER k, false) THEN raw_open WHEN enters AND next_open THEN lead(raw_open) OVER k ELSE raw END
FROM (SELECT *, sig = 1 AND coalesce(lag(sig) OVER j, 0) <> 1 AS enters, sig <> 1 AND coalesce(lag(sig) OVER j, 0) = 1 AS leaves,
        coalesce(lead(adj_open > 0 AND raw_open > 0) OVER j, false) AS next_open
      FROM {p}v_sig WINDOW j AS (PARTITION BY factor, span, instrument ORDER BY di))
WINDOW k AS (PARTITION BY factor, span, instrument ORDER BY di)"""
    v[f"{p}v_pnl"] = f"""
SELECT *, pos * (adj / prev - 1) AS gross, CASE WHEN prev IS NULL THEN 0 ELSE pos * (adj / prev - 1) - abs(pos - ppos) * {fee} END AS net,
       abs(pos - ppos) AS traded FROM (
  SELECT *, coalesce(lag(pos) OVER k, 0) AS ppos, lag(adj) OVER k AS prev FROM (
    SELECT *, coalesce(lag(sig) OVER j, 0) * {side} AS pos FROM {p}v_vars WINDOW j AS (PARTITION BY factor, span, variant, instrument ORDER BY di))
  WINDOW k AS (PARTITION BY factor, span, variant, instrument ORDER BY di))"""
    v[f"{p}v_daily"] = f"""
SELECT n.factor, n.span, w.variant, s.di, s.date, coalesce(q.net, 0.0) AS net, coalesce(q.gross, 0.0) AS gross, coalesce(q.trades, 0) AS trades
FROM {p}v_names n JOIN {p}v_spans s USING (span), (SELECT unnest(['close_t', 'open_t1', 'close_t1']) AS variant) w
LEFT JOIN (SELECT factor, span, variant, di, sum(net) / {TOP} AS net, sum(coalesce(gross, 0)) / {TOP} AS gross,
             count(*) FILTER (WHERE traded <> 0) AS trades FROM {p}v_pnl GROUP BY 1, 2, 3, 4) q
  ON q.factor = n.factor AND q.span = n.span AND q.variant = w.variant AND q.di = s.di"""
    v[f"{p}v_all"] = f"""
SELECT factor, span, di, date, net, gross, trades FROM {p}v_daily WHERE variant = 'close_t'
UNION ALL
SELECT 'combined', span, di, date, avg(net), avg(gross), sum(trades) FROM {p}v_daily WHERE variant = 'close_t' GROUP BY 2, 3, 4"""
    v[f"{p}v_ew"] = f"""
SELECT a.span, a.date, a.di, avg(a.adj / b.adj - 1) AS ret FROM {p}v_px a
LEFT JOIN {p}v_px b ON b.instrument = a.instrument AND b.span = a.span AND b.di = a.di - 1 GROUP BY 1, 2, 3"""
    v[f"{p}v_bench"] = f"""
SELECT s.span, s.date, s.di, i.ret FROM {p}v_spans s
JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS ret FROM v_index WHERE close > 0) i USING (date) WHERE i.ret IS NOT NULL"""
    v[f"{p}v_runs"] = f"""
SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY factor, span, variant, instrument ORDER BY di) AS run FROM (
  SELECT *, sig = 1 AND coalesce(lag(sig) OVER k, 0) <> 1 AS starts, sig <> 1 AND coalesce(lag(sig) OVER k, 0) = 1 AS leaves,
         row_number() OVER k AS rn, lead(adj) OVER k AS nxt
  FROM {p}v_vars WINDOW k AS (PARTITION BY factor, span, variant, instrument ORDER BY di))"""
    v[f"{p}v_trades"] = f"""
SELECT factor, span, variant, instrument, bool_or(leaves) AS closed, min(di) AS entry_di, min(date) AS entry_date,
       max(di) AS mark_di, max(date) AS mark_date, arg_min(adj, rn) AS c0, arg_min(nxt, rn) AS c1, arg_max(adj, rn) AS c2,
       arg_min(raw, rn) AS entry_price, arg_max(raw, rn) AS exit_price, max(rn) - min(rn) AS holding_days
FROM {p}v_runs WHERE sig = 1 OR leaves GROUP BY factor, span, variant, instrument, run
HAVING max(CASE WHEN starts THEN nxt END) IS NOT NULL"""
    v[f"{p}v_ledger"] = f"""
SELECT t.factor, t.span, t.variant, t.instrument, CASE WHEN closed THEN 'closed' ELSE 'open' END AS status, entry_date, entry_price,
       CASE WHEN closed THEN mark_date END AS exit_date, exit_price, holding_days, a.value AS factor_value_at_entry,
       a.avg_rank AS rank_at_entry, coalesce(z.size, 0) AS universe_size_at_entry, c2 / c0 - 1 AS gross_return,
       (c1 / c0 - {fee}) * (c2 / c1) * CASE WHEN closed THEN 1 - {fee} ELSE 1 END - 1 AS net_return,
       CASE WHEN NOT closed THEN '' WHEN b.avg_rank IS NULL THEN 'missing' WHEN b.avg_rank > {BAND} THEN 'fell_out' ELSE 'rebalanced' END AS exit_reason,
       CASE WHEN closed THEN b.avg_rank END AS exit_rank
FROM {p}v_trades t
LEFT JOIN {p}v_rank a ON a.factor = t.factor AND a.span = t.span AND a.instrument = t.instrument AND a.di = t.entry_di
LEFT JOIN {p}v_rank b ON b.factor = t.factor AND b.span = t.span AND b.instrument = t.instrument AND b.di = t.mark_di
LEFT JOIN (SELECT DISTINCT factor, span, di, size FROM {p}v_rank) z ON z.factor = t.factor AND z.span = t.span AND z.di = t.entry_di"""


def metrics(source: str, keys: str, value: str = "net", order: str = "date") -> str:
    """Portfolio metrics of a daily table; ``keys`` is a comma list and may be empty."""
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {lead}total AS total_return, CASE WHEN n > 2 THEN pow(1 + total, 252.0 / n) - 1 ELSE 0.0 END AS annual_return,
       coalesce(sd * sqrt(252.0), 0.0) AS volatility, coalesce(mean / nullif(sd, 0) * sqrt(252.0), 0.0) AS sharpe,
       mdd AS max_drawdown, win AS win_rate, n AS n_days FROM (
  SELECT {lead}arg_max(eq, {order}) - 1 AS total, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, max(1 - eq / pk) AS mdd,
         coalesce(avg(CASE WHEN x > 0 THEN 1.0 WHEN x < 0 THEN 0.0 END), 0.0) AS win FROM (
    SELECT *, max(eq) OVER ({part} ORDER BY {order}) AS pk FROM (
      SELECT *, coalesce({value}, 0.0) AS x, product(1 + coalesce({value}, 0.0)) OVER ({part} ORDER BY {order}) AS eq FROM {source}))
  {group})"""


FULL_SPANS = "SELECT 'full' AS span, date, di, (SELECT max(di) FROM v_cal) AS n_days FROM v_cal"
SPLIT = "CAST(floor((SELECT max(di) FROM v_cal) * 0.7) AS BIGINT)"
SPLIT_SPANS = f"""
SELECT span, date, di, max(di) OVER (PARTITION BY span) AS n_days FROM (
  SELECT CASE WHEN di <= {SPLIT} THEN 'is' ELSE 'oos' END AS span, date, CASE WHEN di <= {SPLIT} THEN di ELSE di - {SPLIT} END AS di FROM v_cal)"""

chain("f", FULL_SPANS)
chain("o", SPLIT_SPANS, deciding="span = 'is'")
chain("s", FULL_SPANS, fixed="short")
chain("u", FULL_SPANS, fixed="bottom", universe="v_pit")
