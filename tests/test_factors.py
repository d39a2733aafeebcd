"""The folded factor table against a pivot of the unfolded one."""

import random

from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.operators import factors

PANEL = "date date, instrument string, open double, close double, high double, low double, volume double, factor double"


def panel(spark):
    r = random.Random(5)
    rows = []
    for k in range(4):
        for i in range(30):
            price = None if r.random() < 0.05 else float(r.randrange(90, 110))
            rows.append((day(i), f"TSE{k}", price, price, price, price and price - 1, float(r.randrange(3)), 1.0))
    return spark.createDataFrame(rows + [(None, "TSE9", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (day(0), None, 2.0, float("nan"), 2.0, 2.0, 1.0, 1.0)], PANEL)


def test_wide_equals_a_pivot_without_unfolding(spark):
    names = tuple(n for n in factors.factor_names() if not n.startswith("twice"))
    table = panel(spark)
    wide = factors.factor_table(table, names, wide=True)
    want = factors.factor_table(table, names).groupBy("date", "instrument").pivot("factor", list(names)).agg(F.first("value"))
    assert wide.columns == want.columns
    assert sorted(map(str, wide.collect())) == sorted(map(str, want.collect()))
    plan = wide._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_wide_takes_factors_that_are_tables(spark, monkeypatch):
    monkeypatch.setitem(factors._REGISTRY, "table_of_its_own", lambda p: p.where("close > 100").select("date", "instrument", (F.col("close") * 2).alias("value")))
    got = factors.factor_table(panel(spark), ("table_of_its_own", "daily_return"), keep=("close",), wide=True)
    assert got.columns == ["date", "instrument", "close", "table_of_its_own", "daily_return"]
    for x in got.where("close is not null and instrument is not null").collect():
        assert x.table_of_its_own == (x.close * 2 if x.close > 100 else None)
