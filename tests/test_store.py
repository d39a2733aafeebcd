import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.sources.store import PanelStore, latest_rows, scan


@pytest.fixture
def store(spark, tmp_path):
    return PanelStore(spark, str(tmp_path / "data"))


def closes(df):
    return sorted((r.symbol, r.date, r.close) for r in df.collect())


def test_empty_table_is_typed(store):
    assert store.read("daily").dtypes[3] == ("open", "double") and store.read("daily").count() == 0


def test_upsert_is_idempotent_and_incoming_wins(store, make_bars):
    store.write("daily", make_bars({"A": [1.0, 2.0], "B": [3.0]}))
    store.write("daily", make_bars({"A": [9.0]}))
    once = closes(store.read("daily"))
    store.write("daily", make_bars({"A": [9.0]}))
    assert closes(store.read("daily")) == once == [("A", day(0), 9.0), ("A", day(1), 2.0), ("B", day(0), 3.0)]


def test_only_incoming_years_are_rewritten(store, make_bars):
    years = [dt.date(2023, 12, 29), dt.date(2024, 1, 2)]
    store.write("daily", make_bars({"A": [1.0, 2.0]}, dates={"A": years}))
    folder = f"{store.root}/normalized/daily/year=2023"
    before = sorted(os.listdir(folder))
    store.write("daily", make_bars({"A": [5.0]}, dates={"A": years[1:]}))
    assert sorted(os.listdir(folder)) == before
    assert closes(store.read("daily")) == [("A", years[0], 1.0), ("A", years[1], 5.0)]


def test_first_write_is_deduplicated_by_order(store, make_bars):
    bars = make_bars({"A": [1.0]}).unionByName(make_bars({"A": [2.0]}))
    store.write("daily", bars, order=F.col("close"))
    assert closes(store.read("daily")) == [("A", day(0), 2.0)]


def test_read_prunes_and_filters(store, make_bars):
    years = [dt.date(2022, 5, 1), dt.date(2023, 5, 1), dt.date(2024, 5, 1)]
    store.write("daily", make_bars({"A": [1.0, 2.0, 3.0], "B": [4.0, 5.0, 6.0]}, dates={"A": years, "B": years}))
    got = store.read("daily", ["A"], "2023-01-01", "2023-12-31")
    assert closes(got) == [("A", years[1], 2.0)]
    scan_node = next(n for n in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in n)
    metadata = got._jdf.queryExecution().explainString(
        got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "year" in scan_node and "PartitionFilters: [isnotnull(year" in metadata
    assert "EqualTo(symbol,A)" in metadata and "GreaterThanOrEqual(date,2023-01-01)" in metadata
    assert closes(store.read("daily", got.select("symbol"))) == [("A", y, float(i + 1)) for i, y in enumerate(years)]


def test_missing_date_is_rejected(store, spark):
    with pytest.raises(ValueError):
        store.write("daily", spark.createDataFrame([("A",)], "symbol string"))


def test_reference_table(store, spark):
    schema = "symbol string, name string, market string, industry string, list_date date, delist_date date, status string, snapshot_date date"
    first = spark.createDataFrame([("1", "a", "TSE", "", None, None, "active", None), ("2", "b", "OTC", "", None, None, "active", None)], schema)
    store.write_reference("instrument", first, ["symbol"])
    store.write_reference("instrument", first.where("symbol = '1'").withColumn("name", F.lit("new")), ["symbol"])
    store.write_reference("instrument", first.limit(0), ["symbol"])
    assert sorted((r.symbol, r.name) for r in store.read("instrument").collect()) == [("1", "new"), ("2", "b")]
    leftovers = [n for n in os.listdir(f"{store.root}/normalized") if "staged" in n or "retired" in n]
    assert leftovers == []


def test_raw_and_features(store, make_bars):
    assert store.read_raw("p", "daily") is None and store.read_feature("f") is None
    store.write_raw("p", "daily", make_bars({"A": [1.0]}))
    store.write_raw("p", "daily", make_bars({"A": [2.0, 3.0]}))
    assert closes(store.read_raw("p", "daily")) == [("A", day(0), 2.0), ("A", day(1), 3.0)]
    store.write_feature("f", make_bars({"A": [1.0]}))
    store.write_feature("f", make_bars({"A": [7.0]}))
    assert closes(store.read_feature("f")) == [("A", day(0), 7.0)]


def test_views_and_sql(store, make_bars):
    store.write("daily", make_bars({"A": [1.0, 2.0], "B": [3.0]}))
    store.register_views()
    assert store.table_exists("daily") and store.table_exists("margin") and not store.table_exists("nothing")
    got = store.query("SELECT symbol, max(close) AS c FROM daily WHERE close > :low GROUP BY symbol", {"low": 1.5})
    assert sorted((r.symbol, r.c) for r in got.collect()) == [("A", 2.0), ("B", 3.0)]
    assert store.query("SELECT * FROM margin").count() == 0
    count = store.query_parquet(f"{store.root}/normalized/daily", "SELECT count(*) AS n FROM <TABLE> WHERE year = 2024")
    assert count.first().n == 3


def test_import_is_all_or_nothing(store, make_bars):
    good = make_bars({"2330": [10.0], "1101": [5.0]}, source="manual")
    assert store.import_snapshot(good) == 2
    bad = make_bars({"2330": [11.0], "bad symbol": [1.0]}, source="manual")
    with pytest.raises(ValueError):
        store.import_snapshot(bad)
    assert closes(store.read("daily")) == [("1101", day(0), 5.0), ("2330", day(0), 10.0)]


def test_latest_rows_cuts_before_the_shuffle(make_bars):
    bars = make_bars({"A": [1.0] * 3})
    plan = latest_rows([bars, bars], ["symbol", "date"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    assert scan(bars, start=day(1), end=day(1)).count() == 1


def test_failed_swap_keeps_the_old_table(store, spark, monkeypatch):
    store.write_feature("f", spark.range(3))

    class Files:
        """A file system whose second rename, the one that publishes, says no."""

        def __init__(self, real):
            self.real, self.renames = real, 0

        def __getattr__(self, name):
            return getattr(self.real, name)

        def rename(self, a, b):
            self.renames += 1
            return False if self.renames == 2 else self.real.rename(a, b)

    real = store._files
    files = Files(real(store._path("features", "f")))
    monkeypatch.setattr(store, "_files", lambda path: files)
    with pytest.raises(OSError):
        store.write_feature("f", spark.range(5))
    monkeypatch.undo()
    assert store.read_feature("f").count() == 3
    store.write_feature("f", spark.range(5))
    assert store.read_feature("f").count() == 5
