import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import column, day, near
from tidemark.plans.research import Research
from tidemark.operators import factors as factor_ops
from tidemark.operators import ic, portfolio
from tidemark.operators.adjust import adjusted_prices
from tidemark.operators.calendar import calendar
from tidemark.operators.ledger import ledger_summary, trade_ledger
from tidemark.operators.portfolio import Rules
from tidemark.operators.timing import compare_timing, open_overrides, timing_rows

FREE = {"commission": 0.0, "tax": 0.0}


def pnl(spark, signals, closes, fee=0.0):
    df = spark.createDataFrame([("x", day(i), float(c), s) for i, (s, c) in enumerate(zip(signals, closes))],
                               "symbol string, date date, close double, sig int")
    return portfolio.signal_pnl(df, ["symbol"], "date", "close", F.col("sig"), fee)


def test_signal_takes_effect_next_row(spark):
    got = pnl(spark, [1, 0, 0, 0, 0], [100, 140, 130, 120, 110])
    assert column(got, "position") == [0, 1, 0, 0, 0]
    assert near(column(portfolio.with_equity(got, ["symbol"]), "equity"), [1.0] + [1.4] * 4)


def test_cost_is_charged_on_change(spark):
    got = column(pnl(spark, [1, 1, 1], [100, 101, 101], fee=.001), "net")
    assert near(got, [0.0, .01 - .001, 0.0])


def test_short_and_drawdown(spark):
    short = portfolio.signal_metrics(pnl(spark, [-1] * 5, [100, 95, 90, 85, 80]), ["symbol"]).first()
    assert abs(short.total_return - .2352941176) < 1e-9
    deep = portfolio.signal_metrics(pnl(spark, [1] * 5, [100, 120, 60, 60, 120]), ["symbol"]).first()
    assert abs(deep.max_drawdown - .5) < 1e-12 and deep.trade_count == 1


def test_zero_previous_price_earns_nothing(spark):
    assert column(pnl(spark, [1, 1, 1], [100, 0, 50], fee=.01), "net") == [0.0, -1.01, 0.0]


def _research_inputs(spark, values, closes, opens=None, rules=Rules(top_n=1, rebalance_days=1, **FREE), direction="top"):
    """values/closes: instrument → list over days (None = missing)."""
    n = max(len(v) for v in closes.values())
    panel = spark.createDataFrame(
        [(day(i), name, float((opens or closes)[name][i]), float(series[i]), 1.0, 1.0) for name, series in closes.items()
         for i in range(n) if series[i] is not None],
        "date date, instrument string, open double, close double, volume double, factor double")
    spans = portfolio.spans_of(calendar(panel))
    prices = portfolio.on_spans(adjusted_prices(panel), spans)
    table = spark.createDataFrame(
        [("f", "full", i + 1, name, None if v is None else float(v)) for name, series in values.items() for i, v in enumerate(series)],
        "factor string, span string, di long, instrument string, value double")
    directions = spark.createDataFrame([("f", direction)], "factor string, direction string")
    holdings = portfolio.select_holdings(
        portfolio.rebalance_candidates(table, directions, rules), spans, table, rules)
    return spans, prices, table, directions, holdings, portfolio.signal_rows(prices, holdings, directions, rules)


def picks(holdings):
    return ["".join(sorted(r.picks)) for r in holdings.orderBy("k").collect()]


FIVE = {"A": [1, 5, 5, 1], "B": [2, 1, 1, 2], "C": [5, 3, 1.5, 5], "D": [4, 4, 4, 4], "E": [3, 2, 2, 3]}


def test_hold_buffer_keeps_names_inside_the_band(spark):
    closes = {k: [10.0] * 4 for k in FIVE}
    plain = _research_inputs(spark, FIVE, closes)[4]
    assert picks(plain) == ["C", "A", "A", "C"]
    buffered = _research_inputs(spark, FIVE, closes, rules=Rules(1, 1, 3, **FREE))[4]
    # C is third on the second day and stays; fourth on the third, so the best name replaces it;
    # that one is last on the fourth.
    assert picks(buffered) == ["C", "C", "A", "C"]


def brute_force_holdings(values, rules, ascending):
    """The selection rule in pandas, date by date."""
    frame = pd.DataFrame(values).T.sort_index().T
    held, out = None, []
    for at in range(0, len(frame), rules.rebalance_days):
        row = frame.iloc[at].dropna()
        if row.empty:
            held = set()
            out.append((set(), None))
            continue
        rank = row.rank(ascending=ascending).sort_values(kind="stable")
        if held is None:
            now, turnover = set(rank.index[:rules.top_n]), None
        else:
            keep = {s for s in held if s in rank.index and rank[s] <= rules.band}
            free = [s for s in rank.index if s not in keep][: rules.top_n - len(keep)]
            now = keep | {s for s in free if rank[s] <= rules.band}
            turnover = 1 - len(held & now) / rules.top_n
        out.append((now, turnover))
        held = now
    return out


@pytest.mark.parametrize("seed,direction", [(1, "top"), (2, "bottom"), (3, "top"), (4, "bottom")])
def test_holdings_equal_brute_force(spark, seed, direction):
    rng = random.Random(seed)
    days, names = 24, [f"N{i:02d}" for i in range(14)]
    values = {n: [None if rng.random() < .15 or d in (6, 7) else float(rng.choice(range(6 if seed % 2 else 40))) for d in range(days)]
              for n in names}
    rules = Rules(3, 2, 5, **FREE)
    holdings = _research_inputs(spark, values, {n: [10.0] * days for n in names}, rules=rules, direction=direction)[4]
    got = [(set(r.picks), r.turnover) for r in holdings.orderBy("k").collect()]
    want = brute_force_holdings(values, rules, ascending=direction == "bottom")
    assert len(got) == len(want)
    for (a, at), (b, bt) in zip(got, want):
        assert a == b and (at is None) == (bt is None) and (at is None or abs(at - bt) < 1e-12)


SWAP = {"A": [2, 2, 2, 1, 1, 1], "B": [1, 1, 1, 2, 2, 2]}
SWAP_CLOSES = {"A": [100.0, 101, 102, 103, 104, 105], "B": [50.0, 50, 50, 50, 51, 52]}


def test_ledger_of_a_swap(spark):
    rules = Rules(1, 1, commission=.001, tax=.002)
    spans, prices, table, directions, holdings, rows = _research_inputs(spark, SWAP, SWAP_CLOSES, rules=rules)
    trades = {r.instrument: r for r in trade_ledger(rows, table, directions, rules).collect()}
    a, b = trades["A"], trades["B"]
    assert (a.status, a.entry_price, a.exit_price, a.holding_days, a.exit_reason) == ("closed", 100.0, 103.0, 3, "fell_out")
    assert (b.status, b.exit_date, b.holding_days, b.rank_at_entry, b.universe_size_at_entry) == ("open", None, 2, 1.0, 2)
    fee = .002
    assert abs(a.net_return - ((1.01 - fee) * (103 / 101) * (1 - fee) - 1)) < 1e-12
    daily = portfolio.portfolio_daily(rows, spans, table, rules)
    # Entries and exits count once each, an open trade only its entry.
    assert daily.agg(F.sum("trades")).first()[0] == 2 * 1 + 1
    total = portfolio.portfolio_metrics(daily, ["factor"]).first().total_return
    chained = (1 + a.net_return) / (1 - fee) * (51 / 50 - fee - fee) / (51 / 50 - fee) * (1 + b.net_return) - 1
    assert abs(total - chained) < 1e-9
    assert ledger_summary(trade_ledger(rows, table, directions, rules)).first().n_open == 1


def test_ledger_edges(spark):
    values = {"A": [2, 2, None, 1, 1], "B": [1, 1, 2, 1.5, 3]}
    closes = {"A": [10.0, 11, 12, 13, 14], "B": [20.0] * 5}
    rules = Rules(1, 1, **FREE)
    _, _, table, directions, _, rows = _research_inputs(spark, values, closes, rules=rules)
    trades = trade_ledger(rows, table, directions, rules).collect()
    assert [(r.instrument, r.exit_reason) for r in trades if r.instrument == "A"] == [("A", "missing")]
    late = {"A": [2, 2, 2, 2, 1], "B": [1, 1, 1, 1, 2]}
    _, _, table, directions, _, rows = _research_inputs(spark, late, closes, rules=rules)
    assert [r.instrument for r in trade_ledger(rows, table, directions, rules).collect()] == ["A"]  # last-row signal


def test_ledger_uses_adjusted_returns(spark):
    panel = spark.createDataFrame(
        [(day(i), "A", 1.0, float(c), 1.0, float(f)) for i, (c, f) in enumerate(zip([100.0, 100, 97, 98, 99, 100], [.97, .97, 1, 1, 1, 1]))],
        "date date, instrument string, open double, close double, volume double, factor double")
    spans = portfolio.spans_of(calendar(panel))
    prices = portfolio.on_spans(adjusted_prices(panel), spans)
    fwd = ic.with_forward_return(prices, 1).orderBy("date").limit(4).collect()
    assert near([r.fwd for r in fwd], [0.0, 0.0, 98 / 97 - 1, 99 / 98 - 1])


def test_open_overrides(spark):
    signals, opens = [1, 1, 1, 0, 0, 1, 1, 0], [float(10 + i) for i in range(8)]
    rows = spark.createDataFrame(
        [("f", "full", "A", day(i), i + 1, s, 100.0, 100.0, o, o) for i, (s, o) in enumerate(zip(signals, opens))],
        "factor string, span string, instrument string, date date, di long, sig int, adj double, raw double, adj_open double, raw_open double")
    got = open_overrides(rows).orderBy("di").collect()
    assert [r.exec_sig for r in got] == [1, 1, 1, 1, 0, 1, 1, 0]
    assert [r.exec_adj for r in got] == [11.0, 100, 100, 100, 14.0, 16.0, 100, 100]


def test_overnight_gain_needs_the_close(spark):
    # All movement happens between the close and the next open.
    closes = {"A": [100.0, 120, 120, 120, 120, 120], "B": [50.0] * 6}
    opens = {"A": [100.0, 120, 120, 120, 120, 120], "B": [50.0] * 6}
    values = {"A": [2, 2, 2, 1, 1, 1], "B": [1, 1, 1, 2, 2, 2]}
    rules = Rules(1, 1, **FREE)
    spans, _, table, directions, holdings, rows = _research_inputs(spark, values, closes, opens, rules)
    got = {r.variant: r.annual_return for r in compare_timing(rows, holdings, table, spans, rules).collect()}
    assert got["close_t"] > 0 and abs(got["open_t1"]) < 1e-9 and abs(got["close_t1"]) < 1e-9
    late = timing_rows(rows, holdings, rules).where("variant = 'close_t1' AND instrument = 'A'")
    assert column(late, "exec_sig", "di") == [0, 1, 1, 1, 0, 0]


@pytest.mark.filterwarnings("ignore")
def test_rank_ic_equals_pandas(spark):
    rng = random.Random(5)
    rows = [("f", day(d), f"i{k}", rng.choice([None, float("nan"), 0.0, 1.0, rng.random()]), rng.choice([0.0, rng.random(), None]))
            for d in range(12) for k in range(3 + d)]
    df = spark.createDataFrame(rows, "factor string, date date, instrument string, value double, fwd double")
    got = {r.date: (r.n, r.rank_ic) for r in ic.daily_rank_ic(df).collect()}
    frame = pd.DataFrame(rows, columns=["factor", "date", "instrument", "value", "fwd"]).dropna()
    want = {}
    for date, g in frame.groupby("date"):
        value = g["value"].rank().corr(g["fwd"].rank())
        if len(g) >= 5 and not pd.isna(value):
            want[date] = (len(g), value)
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-9 for d in want)


def test_parameters_are_checked(spark):
    with pytest.raises(ValueError):
        Rules(top_n=5, buffer_n=3)
    with pytest.raises(ValueError):
        ic.fixed_direction(spark.createDataFrame([("f",)], "factor string"), "sideways")


def test_directions_by_factor(spark):
    names = spark.createDataFrame([("f",), ("g",)], "factor string")
    got = {r.factor: r.direction for r in ic.given_directions(names, {"f": "top", "g": "bottom"}).collect()}
    assert got == {"f": "top", "g": "bottom"}
    with pytest.raises(ValueError):
        ic.given_directions(names, {"f": "top", "g": None})


def test_a_short_run_has_no_ledger(spark):
    panel = spark.createDataFrame([(day(0), "A", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)],
                                  "date date, instrument string, open double, high double, low double, close double, volume double, factor double")
    with pytest.raises(ValueError):
        Research(panel, direction="short").ledger()


def test_benchmark_falls_back_to_equal_weight(spark):
    days = spark.createDataFrame([(day(i), i + 1) for i in range(40)], "date date, di long")
    spans = portfolio.spans_of(days)
    ew = spans.select("span", "date", "di").withColumn("ret", F.lit(.01))
    short = spark.createDataFrame([(day(i), 100.0 + i) for i in range(20)], "date date, close double")
    long = spark.createDataFrame([(day(i), 100.0 + i) for i in range(40)], "date date, close double")
    label = lambda levels: {r.label for r in portfolio.resolve_benchmark(spans, portfolio.index_returns(levels), ew).collect()}
    assert label(short) == {"equal_weight"} and label(long) == {"index"}


def test_factor_registry(spark, make_bars):
    panel = spark.createDataFrame([(day(i), "A", 1.0, 2.0, 0.5, float(i + 1), 10.0, 1.0) for i in range(3)],
                                  "date date, instrument string, open double, high double, low double, close double, volume double, factor double")

    def last_close(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"date": frame["date"], "instrument": frame["instrument"], "value": frame["close"] * 2})

    factor_ops.register_factor("twice", lambda p: F.col("close") * 2)
    factor_ops.register_factor("twice_by_group", lambda p: p.groupBy("instrument").applyInPandas(
        last_close, "date date, instrument string, value double"))
    got = factor_ops.factor_table(panel, ("twice", "twice_by_group", "momentum_5d"))
    values = {(r.factor, r.date): r.value for r in got.collect()}
    assert values[("twice", day(2))] == values[("twice_by_group", day(2))] == 6.0 and values[("momentum_5d", day(2))] is None
    with pytest.raises(KeyError):
        factor_ops.factor_table(panel, ("unknown",))
    doubled = got.where("factor = 'twice'").unionByName(got.where("factor = 'twice'")).unionByName(got.where("factor = 'momentum_5d'"))
    assert {r.factor for r in factor_ops.reject_ambiguous(doubled).collect()} == {"momentum_5d"}
    with pytest.raises(KeyError):
        factor_ops.select_factors(got, ("absent",))
    external = spark.createDataFrame([("A", day(0), 3.0)], "instrument string, datetime date, mine double")
    assert factor_ops.normalize_factor_output(external, "mine").first().value == 3.0
