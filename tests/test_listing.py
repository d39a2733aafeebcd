import datetime as dt

import pytest

from tests.conftest import day
from tidemark.operators import listing


def seen(spark, *rows):
    return spark.createDataFrame([(s, n, dt.date.fromisoformat(d)) for s, n, d in rows], "symbol string, name string, seen_date date")


def spells(df):
    return [(r.symbol, r.name, r.first_seen.isoformat(), r.last_seen.isoformat(), r.n_days)
            for r in df.orderBy("symbol", "first_seen").collect()]


def test_gap_of_ninety_days_is_one_spell(spark):
    near = seen(spark, ("1", "a", "2024-01-01"), ("1", "a", "2024-03-31"))  # 90 days
    far = seen(spark, ("1", "a", "2024-01-01"), ("1", "a", "2024-04-01"))  # 91 days
    assert len(spells(listing.listing_intervals(near))) == 1
    assert len(spells(listing.listing_intervals(far))) == 2


def test_renamed_and_reused(spark):
    log = seen(spark, ("1", "old", "2024-01-01"), ("1", "new", "2024-02-01"), ("2", "x", "2020-01-01"), ("2", "y", "2024-01-01"))
    assert spells(listing.listing_intervals(log)) == [
        ("1", "new", "2024-01-01", "2024-02-01", 2), ("2", "x", "2020-01-01", "2020-01-01", 1), ("2", "y", "2024-01-01", "2024-01-01", 1)]


def test_suspension_is_merged_and_delisting_splits(spark):
    log = seen(spark, ("3018", "s", "2022-11-01"), ("3018", "s", "2023-07-01"), ("2", "x", "2024-01-01"), ("2", "y", "2024-02-01"))
    gone = spark.createDataFrame([("2", "x", dt.date(2024, 1, 20))], "symbol string, name string, delist_date date")
    got = spells(listing.listing_intervals(log, delistings=gone))
    assert [(s, n) for s, n, *_ in got] == [("2", "x"), ("2", "y"), ("3018", "s")]


def test_delisting_on_the_sample_day_counts(spark):
    log = seen(spark, ("2", "x", "2024-01-20"))
    gone = spark.createDataFrame([("2", "x", dt.date(2024, 1, 20)), ("2", "x", dt.date(2024, 2, 1))], "symbol string, name string, delist_date date")
    assert listing.latest_event_asof(log, gone).first().event_date == dt.date(2024, 1, 20)


def test_candidates_and_merge(spark):
    intervals = spark.createDataFrame(
        [("1", "a", day(0), day(9), 2), ("2", "b", day(0), day(10), 2), ("3", "c", day(0), day(9), 2)],
        "symbol string, name string, first_seen date, last_seen date, n_days long")
    active = spark.createDataFrame([("3",)], "symbol string")
    found = listing.delisted_candidates(intervals, day(100), active)  # cut-off is day 10
    assert [r.symbol for r in found.collect()] == ["1"]
    official = spark.createDataFrame([("1", "official", day(5)), ("3", "moved", day(5))], "symbol string, name string, delist_date date")
    merged = listing.merge_delisted(official, intervals, active).collect()
    assert [(r.symbol, r.name, r.source) for r in merged] == [("1", "official", "twse_terminated"), ("2", "b", "mi_index_sampling")]
    assert listing.merge_delisted(None, intervals).count() == 3


def test_active(spark):
    table = spark.createDataFrame([("1", day(0)), ("1", day(95)), ("2", day(60))], "symbol string, snapshot_date date")
    assert [r.symbol for r in listing.active_symbols(table, day(100)).collect()] == ["1"]
    assert listing.active_symbols(table.drop("snapshot_date"), day(100)).count() == 2


def test_plans(spark):
    span = spark.createDataFrame([("1", dt.date(2022, 11, 15), dt.date(2024, 2, 10))], "symbol string, start date, end date")
    years = [(r.year, r.seg_start.isoformat(), r.seg_end.isoformat()) for r in listing.year_segments(span).orderBy("year").collect()]
    assert years == [(2022, "2022-11-15", "2022-12-31"), (2023, "2023-01-01", "2023-12-31"), (2024, "2024-01-01", "2024-02-10")]
    months = listing.month_plan(span).orderBy("month").collect()
    assert len(months) == 16 and months[0].probe_start == dt.date(2022, 11, 15) and months[-1].probe_end == dt.date(2024, 2, 10)
    have = spark.createDataFrame([("daily", "1", 2023)], "table string, symbol string, year int")
    plan = {(r.table, r.year) for r in listing.backfill_plan(span, ["daily", "margin"], have).collect()}
    assert plan == {("daily", 2022), ("daily", 2024), ("margin", 2022), ("margin", 2023), ("margin", 2024)}


def test_month_without_data_fails(spark):
    span = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 2, 28))], "start date, end date")
    days = spark.createDataFrame([(dt.date(2024, 1, 3),), (dt.date(2024, 2, 13),)], "date date")  # 13 Feb is not among the first 12
    sample = listing.monthly_sample_dates(days, listing.month_plan(span))
    assert [r.sample_date for r in sample.orderBy("month").collect()] == [dt.date(2024, 1, 3), None]
    with pytest.raises(Exception, match="no data in month 2024-02-01"):
        listing.require_every_month(sample).collect()
