import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.coverage import coverage, covered_days, covered_years, merged_coverage, missing_days
from tidemark.operators.state import add_days, summary_of_state
from tidemark.sources.versions import VersionedTable


def test_bitmaps_tell_missing_days(spark):
    r = random.Random(2)
    cal = [dt.date(1899, 12, 1) + dt.timedelta(days=i * 5) for i in range(9000)]  # over several bitmaps of 32,768 days
    has = {s: sorted(r.sample(range(len(cal)), n)) for s, n in (("a", 4000), ("b", 3), ("c", 1), ("d", 8990))}
    rows = [(s, cal[i]) for s, places in has.items() for i in places] + [("a", None), ("a", cal[has["a"][0]])]
    r.shuffle(rows)
    parts = [coverage(spark.createDataFrame(rows[k::3], "symbol string, date date"), ["symbol"]) for k in range(3)]
    covered = merged_coverage(parts, ["symbol"])
    got = {(x.symbol, x.date) for x in missing_days(covered, ["symbol"], spark.createDataFrame([(d,) for d in cal], "date date")).collect()}
    assert got == {(s, cal[i]) for s, p in has.items() for i in set(range(p[0], p[-1])) - set(p)}
    assert {(x.symbol, x.n_days) for x in covered_days(covered, ["symbol"]).collect()} == {(s, len(p)) for s, p in has.items()}
    assert {(x.symbol, x.year) for x in covered_years(covered, ["symbol"]).collect()} == {(s, cal[i].year) for s, p in has.items() for i in p}


def test_state_of_deliveries_equals_one_pass(spark, tmp_path):
    r = np.random.default_rng(1)
    days = pd.date_range("2024-01-01", periods=40).date
    rows = [("f" if r.random() < 0.9 else "g", d, f"i{k}", None if r.random() < 0.1 else float("nan") if r.random() < 0.05 else 1e6 + float(r.normal()))
            for d in days for k in range(60)]
    df = spark.createDataFrame(rows, "factor string, date date, instrument string, value double")
    state = VersionedTable(spark, str(tmp_path / "s"), ["factor", "date"], buckets=2)
    add_days(state, df.where(F.col("date") < days[20]).withColumn("value", F.col("value") + 5))
    add_days(state, df.where(F.col("date") < days[20]))  # the same days again, corrected
    add_days(state, df.where(F.col("date") >= days[20]), token="rest")
    add_days(state, df.where(F.col("date") >= days[20]), token="rest")
    assert state.latest() == 3
    frame = pd.DataFrame(rows, columns=["factor", "date", "i", "v"])
    got = {x.factor: x for x in summary_of_state(state.read(), (0.1, 0.5)).collect()}
    assert got.keys() == {"f", "g"}
    for f, g in frame.groupby("factor"):
        x, v = got[f], g["v"].astype(float).dropna()
        assert (x.n_rows, x.start, x.end) == (len(g), g["date"].min(), g["date"].max()) and (x.min, x.max) == (v.min(), v.max())
        assert abs(x["mean"] - v.mean()) < 1e-6 and abs(x["std"] - v.std()) < 1e-6 and abs(x.na_ratio - (1 - len(v) / len(g))) < 1e-12
        for q, value in ((0.1, x.q10), (0.5, x.q50)):
            assert abs((v <= value).mean() - q) < 0.03
