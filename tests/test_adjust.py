from tests.conftest import column, day, near

from tidemark.operators import adjust


def _bars(spark, closes, instrument="TSE1101"):
    return spark.createDataFrame([(instrument, day(i), c) for i, c in enumerate(closes)],
                                 "instrument string, date date, close double")


def _events(spark, ratios):
    return spark.createDataFrame([("TSE1101", day(i), r) for i, r in ratios.items()], "instrument string, date date, ratio double")


def test_split_adjustment(spark):
    got = adjust.back_adjusted_close(_bars(spark, [200.0, 190.0, 100.0, 95.0]), _events(spark, {2: .5}))
    assert column(got, "back_adjusted") == [100.0, 95.0, 100.0, 95.0]
    got = adjust.back_adjusted_close(_bars(spark, [90.0, 92.0, 88.0, 60.0, 61.0]), _events(spark, {3: .68}))
    assert column(got, "back_adjusted") == [61.2, 62.56, 59.84, 60.0, 61.0]


def test_forward_adjustment(spark):
    paid = spark.createDataFrame([("TSE1101", day(1), 1.0), ("TSE1101", day(2), .5)], "instrument string, date date, cash double")
    assert column(adjust.forward_adjusted_close(_bars(spark, [100.0, 98.0, 99.0]), paid), "forward_adjusted") == [100.0, 97.0, 97.5]


def _dividends(spark, *rows):
    return spark.createDataFrame([("TSE1101", *r) for r in rows], "instrument string, ex_date date, cash double, ratio double")


def test_dividend_factor(spark):
    bars = _bars(spark, [100.0] * 5 + [98.0] * 5)
    assert near(column(adjust.with_dividend_factor(bars, _dividends(spark, (day(5), 2.0, 0.0))), "factor"), [.98] * 5 + [1.0] * 5)
    assert near(column(adjust.with_dividend_factor(bars, _dividends(spark, (day(5), 0.0, .1))), "factor"), [1 / 1.1] * 5 + [1.0] * 5)


def test_dividend_edges(spark):
    bars = _bars(spark, [0.0, 100.0, 0.0, 98.0])
    # The previous valid close skips the zero row; an event before any valid close, or one that
    # would take more than ten times the price, is ignored.
    events = _dividends(spark, (day(3), 2.0, 0.0), (day(1), 2.0, 0.0), (day(2), 2000.0, 0.0))
    assert near(column(adjust.with_dividend_factor(bars, events), "factor"), [.98] * 3 + [1.0])
    clipped = adjust.with_dividend_factor(bars, _dividends(spark, (day(3), 99.0, 0.0)))
    assert near(column(clipped, "factor"), [.05] * 3 + [1.0])
    beyond = adjust.with_dividend_factor(bars, _dividends(spark, (day(9), 9.8, 0.0)))
    assert near(column(beyond, "factor"), [.9] * 4)


def test_filled_factor(spark):
    bars = _bars(spark, [1.0] * 5)
    known = spark.createDataFrame([("TSE1101", day(1), .3), ("TSE1101", day(3), .5)], "instrument string, date date, factor double")
    assert column(adjust.with_filled_factor(bars, known), "factor") == [.3, .3, .3, .5, .5]
    assert column(adjust.with_filled_factor(bars, known.limit(0)), "factor") == [1.0] * 5


def test_vendor_dividend_rows(spark):
    rows = spark.createDataFrame([
        ("TSE1", "1.5", "0.5", "", "0", "2024-06-15", ""), ("TSE2", "", None, "1", "0", "", "2024-07-01"),
        ("TSE3", "0", "0", "0", "0", "2024-06-15", ""), ("TSE4", "1", "0", "0", "0", "", ""), ("TSE5", "1", "0", "0", "0", "soon", ""),
    ], "instrument string, CashEarningsDistribution string, CashStatutorySurplus string, StockEarningsDistribution string, "
       "StockStatutorySurplus string, CashExDividendTradingDate string, StockExDividendTradingDate string")
    got = {r.instrument: (r.ex_date.isoformat(), r.cash, r.ratio) for r in adjust.dividend_events(rows).collect()}
    assert got == {"TSE1": ("2024-06-15", 2.0, 0.0), "TSE2": ("2024-07-01", 0.0, .1)}


def test_panel(make_bars):
    panel = adjust.build_panel(make_bars({"2330": [10.0, 11.0], "1101": [5.0, 0.0]}), max_symbols=1)
    assert panel.columns == ["date", "instrument", "open", "close", "high", "low", "volume", "factor"]
    assert {r.instrument for r in panel.collect()} == {"TSE1101"}
    prices = adjust.adjusted_prices(panel).orderBy("date").collect()
    assert (prices[0].adj, prices[0].raw, prices[1].adj, prices[1].raw) == (5.0, 5.0, None, None)
