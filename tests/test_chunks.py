"""Histories that no task holds whole: scans and as-of joins over parts of one hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.chunks import Scan, asof_join, cut_in_parts, long_equity, long_rsi, scan


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small tables are one part
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, n=3000):
    r = np.random.default_rng(3)
    frame = pd.DataFrame({
        "k": np.where(r.random(n) < 0.6, "HOT", [f"s{i % 37}" for i in range(n)]), "t": r.permutation(n).astype("int64"),
        "x": np.where(r.random(n) < 0.1, np.nan, r.random(n) * 2), "f": np.where(r.random(n) < 0.05, np.nan, 0.5 + r.random(n) / 2)})
    frame.loc[frame.index[:5], "k"] = None
    data = [tuple(None if pd.isna(v) else v for v in row) for row in frame.astype(object).itertuples(index=False)]
    return spark.createDataFrame(data, "k string, t long, x double, f double").repartition(6), frame


def close(a, b):
    return (a is None and pd.isna(b)) or (a is not None and not pd.isna(b) and abs(a - b) < 1e-9 * max(1, abs(b)))


def test_scans_equal_pandas(spark, many_parts):
    df, frame = rows(spark)
    parts = cut_in_parts(df, ["k"], ["t"])
    sizes = [r["count"] for r in parts.where("k = 'HOT'").groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
    kinds = ("sum", "count", "max", "min", "product", "last", "previous")
    got = scan(parts, ["k"], ["t"], {**{c: Scan(c, "x") for c in kinds}, "linear": Scan("linear", "x", "f"), "decayed": Scan("linear", "x", 0.9)})
    got = {r.t: r for r in got.collect()}
    assert len(got) == len(frame)
    for _, g in frame.groupby("k", dropna=False):
        g = g.sort_values("t")
        x = g["x"]
        want = {"sum": x.expanding().sum(), "count": x.expanding().count(), "max": x.expanding().max(), "min": x.expanding().min(),
                "product": x.cumprod().ffill(), "last": x.ffill(), "previous": x.shift()}
        want["sum"] = x.cumsum().ffill()
        y, z, linear, decayed = 0.0, 0.0, [], []
        for a, f in zip(x, g["f"]):
            y = y if pd.isna(a) or pd.isna(f) else f * y + a
            z = z if pd.isna(a) else 0.9 * z + a
            linear.append(y)
            decayed.append(z)
        want["linear"], want["decayed"] = pd.Series(linear, g.index), pd.Series(decayed, g.index)
        for c, series in want.items():
            for t, v in zip(g["t"], series):
                assert close(got[t][c], v), (c, t, got[t][c], v)


def test_rsi_and_equity_equal_the_short_forms(spark, many_parts):
    from tidemark.operators.features import add_rsi
    from tidemark.operators.portfolio import with_equity

    df, _ = rows(spark, 1200)
    df = df.where("k is not null")
    short = {(r.symbol, r.date): r.rsi_14 for r in add_rsi(df.select(F.col("k").alias("symbol"), F.col("t").alias("date"), F.col("x").alias("close"))).collect()}
    long = {(r.k, r.t): r.rsi_14 for r in long_rsi(df, ["k"], ["t"], "x").collect()}
    assert short.keys() == long.keys() and all(abs(short[i] - long[i]) < 1e-8 for i in short)
    df = df.withColumn("r", (F.col("x") - 1) / 100)
    short = {r.t: (r.equity, r.peak, r.drawdown) for r in with_equity(df, ["k"], "r", "t").collect()}
    long = {r.t: (r.equity, r.peak, r.drawdown) for r in long_equity(df, ["k"], ["t"], "r").collect()}
    assert short.keys() == long.keys() and all(np.allclose(short[i], long[i], atol=1e-9) for i in short)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, 7])
def test_asof_equals_pandas(spark, many_parts, direction, strict, tolerance):
    r = np.random.default_rng(5)
    key = lambda n: np.where(r.random(n) < 0.5, "HOT", [f"s{i % 9}" for i in range(n)])
    left = pd.DataFrame({"k": key(900), "t": np.sort(r.integers(0, 4000, 900)), "id": range(900)})
    right = pd.DataFrame({"k": key(300), "t": np.sort(r.integers(0, 4000, 300)), "bid": range(300)})
    one = right.groupby(["k", "t"], as_index=False)["bid"].max().sort_values("t")
    want = pd.merge_asof(left, one, on="t", by="k", direction=direction, allow_exact_matches=not strict, tolerance=tolerance).set_index("id")["bid"]
    a = spark.createDataFrame(left).unionByName(spark.createDataFrame([(None, 5, 900), ("HOT", None, 901)], "k string, t long, id long")).repartition(5)
    b = spark.createDataFrame(right).unionByName(spark.createDataFrame([(None, 5, 1), ("HOT", None, 2)], "k string, t long, bid long"))
    out = asof_join(a, b, ["k"], "t", ["bid"], direction, None if tolerance is None else F.lit(tolerance), strict)
    assert out.columns == ["k", "t", "id", "bid"]
    got = {r.id: r.bid for r in out.collect()}
    assert len(got) == 902 and got[900] is None and got[901] is None
    assert all(close(got[i], v) for i, v in want.items())


def test_asof_without_events(spark):
    a = spark.createDataFrame([("a", 1)], "k string, t long")
    b = spark.createDataFrame([], "k string, t long, bid long")
    assert [tuple(r) for r in asof_join(a, b, ["k"], "t", ["bid"]).collect()] == [("a", 1, None)]
    assert asof_join(a.limit(0), b, ["k"], "t", ["bid"]).collect() == []
