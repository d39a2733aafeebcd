import pandas as pd
import pytest
from tests.conftest import column, day, near

from tidemark.functions.windows import wilder_mean
from tidemark.operators import features

CLOSES = [100.0, 101.0, 103.0, 103.0, 102.0, 106.0]


def test_returns_sma_volume_ratio(make_bars):
    bars = make_bars({"2330": CLOSES}, {"2330": [1_000_000, 1_200_000, 900_000, 1_000_000, 1_000_000, 2_000_000]})
    assert near(column(features.add_returns(bars), "return_1d"), [None, .01, 103 / 101 - 1, 0, 102 / 103 - 1, 106 / 102 - 1])
    assert near(column(features.add_sma(bars, window=3), "sma_3"), [None, None, 304 / 3, 307 / 3, 308 / 3, 311 / 3])
    assert near(column(features.add_volume_ratio(bars, window=5), "volume_ratio_5")[4:], [1.0 / 1.02, 2 / (6.1 / 5)])


def test_symbols_do_not_mix(make_bars):
    bars = make_bars({"A": [1.0, 2.0], "B": [10.0, 5.0]})
    got = {(r.symbol, r.date): r.return_1d for r in features.add_returns(bars).collect()}
    assert got[("B", day(0))] is None and got[("B", day(1))] == -0.5


def _wilder(values, n):
    return values.ewm(alpha=1 / n, adjust=False).mean()


def test_rsi_matches_recursive_mean(make_bars):
    closes = [100 + ((i * 7919) % 13 - 6) * 0.7 for i in range(60)]
    got = column(features.add_rsi(make_bars({"X": closes}), n=14), "rsi_14")
    diff = pd.Series(closes).diff()
    up, down = _wilder(diff.clip(lower=0)[1:], 14), _wilder((-diff).clip(lower=0)[1:], 14)
    assert got[0] == 50.0
    assert near(got[1:], list(100 - 100 / (1 + up / down)), 1e-8)


def test_rsi_flat_and_rising(make_bars):
    assert column(features.add_rsi(make_bars({"X": [5.0] * 4})), "rsi_14") == [50.0] * 4
    assert column(features.add_rsi(make_bars({"X": [1.0, 2.0, 3.0]})), "rsi_14") == [50.0, 100.0, 100.0]


def test_wilder_mean_carries_over_blocks(spark):
    values = [float((i * 37) % 11) for i in range(400)]
    df = spark.createDataFrame([("a", i, None if i == 0 else v) for i, v in enumerate(values)], "symbol string, date int, x double")
    got = column(wilder_mean(df, {"m": "x"}, 2, block_rows=64), "m")
    assert near(got[1:], list(_wilder(pd.Series(values[1:]), 2)), 1e-9)


def test_flows_and_ratio(spark, make_bars):
    inst = spark.createDataFrame(
        [("2330", day(0), 150_000.0, 100_000.0, 2_000.0, 1_000.0, 1_500.0, 1_000.0)],
        "symbol string, date date, foreign_buy double, foreign_sell double, investment_trust_buy double, "
        "investment_trust_sell double, dealer_buy double, dealer_sell double")
    row = features.attach_institutional(make_bars({"2330": [10.0, 11.0]}), inst).orderBy("date").collect()
    assert (row[0].foreign_net_lots, row[0].tii_net_lots, row[0].foreign_net_ratio) == (50.0, 51.5, 0.05)
    assert row[1].foreign_net_lots is None


def test_margin_change(spark):
    margin = spark.createDataFrame(
        [("2330", day(i), b, 0.0) for i, b in enumerate([20_000.0, 30_000.0, 30_000.0])],
        "symbol string, date date, margin_balance double, short_balance double")
    got = features.margin_changes(margin).orderBy("date").collect()
    assert [r.margin_change_pct for r in got] == [None, 0.5, 0.0]
    assert [r.short_change_pct for r in got] == [None, None, None]


def test_feature_table_without_flows(make_bars):
    table = features.ml_features(make_bars({"2330": CLOSES}))
    assert table.columns == features.FEATURE_ORDER
    last = table.orderBy("date").collect()[-1]
    assert last.label_ret_1f is None and last.foreign_net_lots is None and last.margin_short_ratio is None


@pytest.mark.parametrize("cut", [3, 5])
def test_features_do_not_look_ahead(make_bars, cut):
    whole = features.price_features(make_bars({"X": CLOSES})).drop("label_ret_1f").orderBy("date").collect()[:cut]
    part = features.price_features(make_bars({"X": CLOSES[:cut]})).drop("label_ret_1f").orderBy("date").collect()
    assert whole == part


def test_rsi_after_unknown_closes(make_bars):
    rows = features.add_rsi(make_bars({"X": [10.0, None, 11.0, 10.5, 12.0], "Y": [10.0, 10.5, None, 11.0, 12.0, 11.0]})).collect()
    got = {(r.symbol, str(r.date)[-2:]): r.rsi_14 for r in rows}
    assert [round(got["X", d], 4) for d in ("01", "02", "03", "04", "05")] == [50.0, 50.0, 50.0, 0.0, 18.75]
    # the moves +0.5, +1.0, -1.0 follow each other; rows without a move show 50
    up = ((0.5 * 13 + 1.0) / 14) * 13 / 14
    assert [round(got["Y", d], 6) for d in ("01", "02", "03", "04", "05")] == [50.0, 100.0, 50.0, 50.0, 100.0]
    assert abs(got["Y", "06"] - 100 * up / (up + 1.0 / 14)) < 1e-9
