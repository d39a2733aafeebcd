import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.operators import universe
from tidemark.operators.universe import UniverseSpec


def test_point_in_time_membership(spark):
    rows = [(day(i), "A", 10.0, 1e6) for i in range(220)]
    rows += [(day(i), "B", 10.0, 5e5) for i in range(130)]
    rows += [(day(i), "C", 10.0, 4e5) for i in range(80, 220)]
    panel = spark.createDataFrame(rows, "date date, instrument string, close double, volume double")
    eligible = universe.pit_eligibility(panel, top_n=2, lookback_days=60, min_listed_days=120)
    members = {}
    for r in eligible.collect():
        members.setdefault(r.instrument, []).append(r.di - 1)
    assert sorted(members["A"]) == list(range(119, 220))
    assert sorted(members["B"]) == list(range(119, 130))
    assert sorted(members["C"]) == list(range(199, 220))


def test_membership_does_not_look_ahead(spark):
    rows = [(day(i), n, 10.0, v) for i in range(40) for n, v in (("A", 5e5 + i), ("B", 6e5 - 9000 * i), ("C", 1e5))]
    panel = spark.createDataFrame(rows, "date date, instrument string, close double, volume double")
    whole = universe.pit_eligibility(panel, 1, 5, 3).where(F.col("di") <= 25)
    part = universe.pit_eligibility(panel.where(F.col("date") <= day(24)), 1, 5, 3)
    assert sorted(whole.collect()) == sorted(part.collect())


def test_specs(spark):
    panel = spark.createDataFrame([("TSE2",), ("OTC9",), ("TSE1",)], "instrument string")
    assert {r.instrument for r in UniverseSpec.code_first_n(2).slice(panel).collect()} == {"OTC9", "TSE1"}
    assert UniverseSpec.all().slice(panel).count() == 3
    assert "code_first_n(n=2)" in UniverseSpec.code_first_n(2).describe()
    assert universe.resolve_universe(None, 7) == UniverseSpec.code_first_n(7)
    assert universe.resolve_universe(UniverseSpec.all(), 7) == UniverseSpec.all()
    with pytest.raises(NotImplementedError):
        UniverseSpec.pit_liquidity(5).slice(panel)
    with pytest.raises(ValueError):
        UniverseSpec("odd").describe()


def test_top_liquid(spark):
    quotes = spark.createDataFrame([
        ("2330", "a", 100.0, 10, 50.0, "d1"), ("2330", "a", 100.0, 10, 70.0, "d2"), ("1101", "b", 40.0, 5, 55.0, "d1"),
        ("0050", "fund", 100.0, 10, 999.0, "d1"), ("9999", "cheap", 4.0, 10, 999.0, "d1"), ("8888", "idle", 50.0, 0, 999.0, "d1"),
        ("7777", "none", 50.0, 3, None, "d1"),
    ], "symbol string, name string, close double, volume_shares long, turnover_twd double, source_date string")
    got = [(r.rank, r.symbol, r.sampled_days) for r in universe.top_liquid(quotes, n=3).orderBy("rank").collect()]
    assert got == [(0, "2330", 2), (1, "1101", 1), (2, "7777", 1)]
