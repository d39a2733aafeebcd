import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.values import multiplier_of, roc_compact_date, roc_slash_date, to_lots, to_shares
from tidemark.sources import exchange, lists, vendor


def raw(spark, *rows, **columns):
    df = spark.createDataFrame([(json.dumps(r, ensure_ascii=False),) for r in rows], "payload string")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()}) if columns else df


def test_units(spark):
    df = spark.createDataFrame([("1,234",), ("2.5",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(to_shares(F.col("v"), "lots")).collect()] == [1_234_000, 2500, 0, 0]
    assert [r[0] for r in df.select(to_shares(F.col("v"), "股")).collect()] == [1234, 2, 0, 0]
    assert [r[0] for r in df.select(to_lots(F.col("v"))).collect()][:1] == [1.234]
    with pytest.raises(ValueError):
        multiplier_of("barrels")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        spark.createDataFrame([("x",)], "v string").select(to_shares(F.col("v"), "lots")).collect()


def test_roc_dates(spark):
    row = spark.createDataFrame([("1150924", "112/08/28", "115-924")], "a string, b string, c string").select(
        roc_compact_date(F.col("a")), roc_slash_date(F.col("b")), roc_compact_date(F.col("c"))).first()
    assert row[0] == dt.date(2026, 9, 24) and row[1] == dt.date(2023, 8, 28) and row[2] is None


def test_price_rows(spark):
    rows = raw(
        spark,
        {"stock_id": "2330", "date": "2024-01-02", "open": 590, "max": 593, "min": 589, "close": 593, "Trading_Volume": 26059, "Trading_money": 1.5e10, "Trading_tickets": 21000},
        {"stock_id": "2330", "date": "2024-01-03", "open": 0, "max": 1, "min": 1, "close": 5, "Trading_Volume": "1,000"},
        {"stock_id": "2330", "date": "2024-01-04", "open": 0, "max": 0, "min": 0, "close": 0, "Trading_Volume": 0},
        {"date": "2024-01-05", "open_price": "7", "high": None, "max_price": 9, "low": "n/a", "close_price": "8", "volume": 3},
        symbol="9999",
    )
    got = vendor.normalize_price_rows(rows, volume_unit="lots").orderBy("date").collect()
    assert [(r.symbol, r.open, r.close, r.volume_shares) for r in got] == [
        ("2330", 590.0, 593.0, 26_059_000), ("2330", 5.0, 5.0, 1_000_000), ("9999", 7.0, 8.0, 3000)]
    assert got[0].trade_count == 21000 and got[2].high is None and got[2].low is None  # the first alias counts, even when null
    assert {r.field for r in vendor.field_names(rows).collect()} >= {"stock_id", "volume"}


def test_instruments(spark):
    rows = raw(spark, {"stock_id": "1", "stock_name": "a", "type": "twse", "date": "2024-01-01", "industry_category": "x"},
               {"stock_id": "2", "type": "emerging", "date": "None"}, {"stock_id": "3", "type": "odd", "delist_date": "2020-02-03", "status": "gone"})
    got = {r.symbol: (r.market, r.status, r.list_date, r.delist_date, r.snapshot_date) for r in vendor.normalize_instruments(rows).collect()}
    assert got == {"1": ("TSE", "active", None, None, dt.date(2024, 1, 1)), "2": ("EMG", "active", None, None, None),
                   "3": ("odd", "gone", None, dt.date(2020, 2, 3), None)}


def test_flows_and_margin(spark):
    flow = vendor.normalize_institutional(raw(spark, {"stock_id": "1", "date": "2024-01-01", "Dealer_self_buy": 2, "Dealer_Hedging_buy": 3, "Dealer_sell": "x"})).first()
    assert (flow.dealer_buy, flow.dealer_sell, flow.foreign_buy) == (5.0, 0.0, 0.0)
    margin = vendor.normalize_margin(raw(spark, {"stock_id": "1", "date": "2024-01-01", "MarginPurchaseTodayBalance": 7, "ShortSaleBuy": 2})).first()
    assert (margin.margin_balance, margin.short_cover, margin.short_balance) == (7000.0, 2000.0, 0.0)


def test_month_tables(spark):
    ok = {"stat": "OK", "fields": ["日期", "成交股數", "成交金額", "開盤價", "最高價", "最低價", "收盤價", "漲跌價差", "成交筆數"],
          "data": [["112/01/03", "324,123", "72,392", "598.00", "600.00", "590.00", "598.00", "+1", "18,234"]]}
    short = {"stat": "OK", "fields": ["日期", "成交股數"], "data": [["112/02/02", "10"]]}
    usual = {"stat": "OK", "data": [["112/03/02", "5", "6", "1", "--", "1", "1", "0", "2"]]}
    got = exchange.normalize_month_tables(raw(spark, ok, short, usual, {"stat": "Not Found"}, symbol="2330")).orderBy("date").collect()
    assert [(r.date.isoformat(), r.close, r.volume_shares, r.trade_count) for r in got] == [
        ("2023-01-03", 598.0, 324_123, 18_234), ("2023-02-02", None, 10, None), ("2023-03-02", 1.0, 5, 2)]
    assert got[2].high is None


SNAPSHOT = {"Date": "1150924", "Code": "2330", "Name": "x", "TradeVolume": "1,000", "TradeValue": "5", "OpeningPrice": "--",
            "HighestPrice": "3", "LowestPrice": "1", "ClosingPrice": "2", "Change": "0", "Transaction": "4"}


def test_snapshot(spark):
    row = exchange.normalize_snapshot(raw(spark, SNAPSHOT)).first()
    assert (row.date, row.volume_shares, row.open, row.close) == (dt.date(2026, 9, 24), 1000, None, 2.0)


@pytest.mark.parametrize("change", [
    {"Date": "2026-09-24"}, {"Date": "1150230"}, {"ClosingPrice": "x"}, {"TradeVolume": "1.5"}, {"Code": None},
])
def test_snapshot_rejects(spark, change):
    broken = {k: v for k, v in {**SNAPSHOT, **change}.items() if v is not None}
    with pytest.raises(ValueError):
        exchange.normalize_snapshot(raw(spark, {**SNAPSHOT, "Code": "1101"}, broken))


def test_snapshot_rejects_duplicates_and_empty(spark):
    with pytest.raises(ValueError, match="duplicates"):
        exchange.normalize_snapshot(raw(spark, SNAPSHOT, SNAPSHOT))
    with pytest.raises(ValueError, match="non-empty"):
        exchange.normalize_snapshot(spark.createDataFrame([], "payload string"))


def test_market_report(spark):
    fields = ["證券代號", "證券名稱", "成交股數", "成交金額", "收盤價"]
    data = [["2330 ", "a", "1,000", "5,000", "100"], ["00878", "fund", "1", "1", "1"], ["1101", "b", "--", "---", "---"]]
    df = spark.createDataFrame([
        ("2024-01-02", 1, json.dumps({"stat": "bad"})),
        ("2024-01-02", 2, json.dumps({"stat": "OK", "tables": [{"fields": ["x"], "data": [["1"]]}, {"fields": fields, "data": data}]})),
        ("2024-01-03", 1, json.dumps({"stat": "OK", "fields": fields, "data": data[:1]})),
        ("2024-01-03", 2, json.dumps({"stat": "OK", "fields": fields, "data": data})),
    ], "iso_date string, priority int, payload string")
    got = sorted((r.source_date, r.symbol, r.close, r.volume_shares) for r in exchange.parse_market_reports(df).collect())
    assert got == [("2024-01-02", "1101", None, 0), ("2024-01-02", "2330", 100.0, 1000), ("2024-01-03", "2330", 100.0, 1000)]


def test_hourly_and_daily_history(spark):
    nan = float("nan")
    df = spark.createDataFrame([
        ("2330", "TSE", dt.datetime(2024, 1, 2, 9), 1.0, 2.0, 0.5, 1.5, 2.5), ("2330", "TSE", dt.datetime(2024, 1, 2, 10), 1.0, 2.0, 0.5, nan, 1.0),
        ("2330", "TSE", dt.datetime(2024, 1, 2, 11), 0.0, 2.0, 0.5, 1.0, 1.0), ("2330", "TSE", dt.datetime(2024, 1, 2, 12), 1.0, 2.0, 0.5, 1.0, nan),
    ], "symbol string, market string, ts timestamp_ntz, Open double, High double, Low double, Close double, Volume double")
    hourly = vendor.normalize_hourly_history(df).orderBy("date").collect()
    assert [(r.date.hour, r.volume_shares) for r in hourly] == [(9, 2), (12, 0)]
    assert vendor.normalize_daily_history(df).count() == 3
    tickers = spark.createDataFrame([("2330", "TSE"), ("6488", "otc"), ("1.HK", "TSE")], "s string, m string")
    assert [r[0] for r in tickers.select(vendor.vendor_ticker(F.col("s"), F.col("m"))).collect()] == ["2330.TW", "6488.TWO", "1.HK"]


def test_delisted_text_in_big5(spark, tmp_path):
    text = '終止上市公司\n"終止上市日期","公司名稱","上市編號"\n"民國115年09月01日","三商壽","2867"\n"90年1月2日","甲公司","1234"\n"說明"\n'
    (tmp_path / "list.csv").write_bytes(text.encode("big5"))
    got = lists.read_delisted_text(spark, str(tmp_path / "list.csv")).orderBy("symbol").collect()
    assert [(r.symbol, r.name, r.delist_date) for r in got] == [("1234", "甲公司", dt.date(2001, 1, 2)), ("2867", "三商壽", dt.date(2026, 9, 1))]


def test_list_files(spark, tmp_path):
    (tmp_path / "u.txt").write_text("2330\n\n# note\n 1101 \n")
    assert {r.symbol for r in lists.read_symbol_list(spark, str(tmp_path / "u.txt")).collect()} == {"2330", "1101"}
    (tmp_path / "d.csv").write_text("symbol,name,delist_date,source\n1,a,2020-01-01,x\n2,b,,y\n3,c,2010-01-01,x\n")
    rows = lists.read_delisted_csv(spark, str(tmp_path / "d.csv"), "2015-01-01")
    assert {r.symbol for r in rows.collect()} == {"1", "2"}
    lists.write_manifest(rows, str(tmp_path / "out"))
    assert lists.read_delisted_csv(spark, str(tmp_path / "out")).count() == 2
