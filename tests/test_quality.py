import pytest
from pyspark.sql import functions as F

from tests.conftest import BAR_TYPES, day
from tidemark import schemas
from tidemark.operators import changes, quality, reconcile


def checks(df):
    return sorted((r.check, r.date) for r in df.collect())


def test_issue_kinds(make_bars):
    closes = [100.0] * 25
    closes[5], closes[10] = 0.0, 130.0
    volumes = [1000] * 25
    volumes[22] = 100_000
    dates = [day(i if i < 15 else i + 20) for i in range(25)]
    got = checks(quality.quality_report(make_bars({"X": closes}, {"X": volumes}, dates={"X": dates})))
    assert [c for c, _ in got].count("ohlc_nonpositive") == 4
    assert ("date_gap", day(35)) in got and ("price_jump", day(10)) in got and ("volume_spike", day(42)) in got


def test_rounding_noise_is_tolerated(spark):
    rows = [("X", "TSE", day(0), 100.0, 99.95, 99.0, 100.0, 1, 1.0, 1, "twse"), ("X", "TSE", day(1), 100.0, 99.0, 98.0, 100.0, 1, 1.0, 1, "twse")]
    got = quality.inconsistent_ohlc(spark.createDataFrame(rows, BAR_TYPES)).collect()
    assert [r.date for r in got] == [day(1)]


def test_short_history_volume(make_bars):
    got = quality.volume_spikes(make_bars({"X": [1.0] * 3}, {"X": [1, 1, 100]})).collect()
    assert len(got) == 1  # a window as long as the history: only its last row is judged
    assert quality.quality_summary(quality.date_gaps(make_bars({"X": [1.0]}))).first().passed


def test_clean(make_bars):
    assert quality.clean_bars(make_bars({"X": [1.0, 0.0, None, 2.0]})).count() == 2


@pytest.mark.parametrize("field,value,rule", [
    ("open", -1.0, "open"), ("turnover_twd", float("nan"), "turnover_twd"), ("close", float("inf"), "close"),
    ("high", 5.0, "high"), ("low", 50.0, "low"), ("symbol", "a", "symbol"), ("market", "OTC", "market"),
    ("source", "other", "source"), ("trade_count", 1.5, "trade_count"), ("volume_shares", -1.0, "volume_shares"),
])
def test_contract(make_bars, field, value, rule):
    good = make_bars({"2330": [10.0]}, source="manual")
    accepted, rejected = quality.split_by_contract(good)
    assert accepted.count() == 1 and rejected.count() == 0
    _, rejected = quality.split_by_contract(good.withColumn(field, F.lit(value)))
    assert rule in rejected.first().errors


def test_contract_unknown_field(make_bars):
    good = make_bars({"2330": [10.0]}, source="manual").withColumn("extra", F.lit(1))
    assert quality.contract_errors(good, schemas.columns_of("daily")).first().errors == ["unknown:extra"]


def test_compare_sources(make_bars):
    a, b = make_bars({"X": [100.0, 100.0, 0.0, None]}), make_bars({"X": [100.4, 101.0, 0.01, 5.0]})
    found = reconcile.compare_sources(a, b, ("close",)).collect()
    assert sorted((r.date, round(r.error, 6)) for r in found) == [(day(1), 1.0), (day(2), .01)]
    summary = reconcile.compare_summary(a, b, ("close",)).first()
    assert (summary.checked, summary.mismatches, summary.passed) == (4, 2, False)
    assert not reconcile.compare_summary(a, b.limit(0)).first().passed  # nothing checked is no pass


def _panel(df, **columns):
    out = df.select("date", F.concat("market", "symbol").alias("instrument"), "close",
                    F.col("volume_shares").cast("double").alias("volume"), F.lit(1.0).alias("factor"))
    return out.withColumns(columns)


def test_panel_scorecard(make_bars):
    bars = make_bars({"1": [10.0, 11.0, 0.0, 12.0]})
    store = bars.withColumn("instrument", F.concat("market", "symbol"))
    good = {r.check: r.status for r in reconcile.verify_panel(_panel(bars), store).collect()}
    assert len(good) == 14 and good.pop("no_zero_close") == "warn" and set(good.values()) == {"pass"}
    verdict = reconcile.scorecard_conclusion(reconcile.verify_panel(_panel(bars), store)).first()
    assert (verdict.fails, verdict.warnings, verdict.conclusion) == (0, 1, "passed with warnings")
    bad = _panel(bars, factor=F.when(F.col("date") == day(1), 60.0).otherwise(.5), close=F.col("close") + 1)
    got = {r.check: r.status for r in reconcile.verify_panel(bad.unionByName(bad.limit(1)), store).collect()}
    assert got["close_equal"] == got["unique_instrument_date"] == got["factor_range"] == "fail"


def test_registry(spark):
    assert schemas.empty(spark, "hourly").dtypes[2] == ("date", "timestamp_ntz")
    with pytest.raises(KeyError):
        schemas.schema_of("weekly")
    with pytest.raises(ValueError):
        schemas.require_columns(spark.createDataFrame([("a",)], "symbol string"), "daily")


def test_changes(spark):
    state = spark.createDataFrame([("A", day(0), 1.0), ("B", day(0), 2.0)], "symbol string, date date, close double")
    log = spark.createDataFrame([
        ("A", day(0), 1, "insert", 9.0), ("A", day(0), 2, "delete", None), ("A", day(0), 3, "replace", 8.0), ("A", day(0), 4, "insert", 7.0),
        ("B", day(0), 5, "replace", 6.0), ("C", day(0), 6, "delete", None), ("C", day(0), 7, "replace", 5.0), ("D", day(0), 8, "insert", 4.0),
        ("D", day(0), 9, "delete", None),
    ], "symbol string, date date, seq long, op string, close double")
    status = {r.seq: r.status for r in changes.change_status(state, log).collect()}
    assert status == {1: 409, 2: 204, 3: 404, 4: 201, 5: 200, 6: 404, 7: 404, 8: 201, 9: 204}
    after = {(r.symbol, r.close) for r in changes.apply_changes(state, log).collect()}
    assert after == {("A", 7.0), ("B", 6.0)}


def test_page(make_bars):
    bars = make_bars({"A": [1.0, 2.0], "B": [3.0, 4.0]})
    rows = changes.page(bars, limit=2, offset=1).collect()
    assert [(r.symbol, r.date, r.total) for r in rows] == [("B", day(1), 4), ("A", day(0), 4)]
    assert changes.page(bars, symbol="A", start=day(1), end=day(1)).first().total == 1
    assert changes.find(bars, "B", day(0)).first().close == 3.0
    with pytest.raises(ValueError):
        changes.page(bars, limit=0)
    with pytest.raises(ValueError):
        changes.page(bars, start=day(1), end=day(0))
