import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.carry import last_known_before
from tidemark.functions.ranks import average_rank, average_ranks, best_band, best_rows


def _rows(seed, n, ties):
    rng = random.Random(seed)
    scale = [1e-9, 1e-3, 1.0, 1e6]
    return [(rng.choice("ab"), f"i{k:04d}",
             rng.choice([None, -1.0, 0.0, 2.5]) if rng.random() < ties else rng.uniform(-1, 1) * rng.choice(scale))
            for k in range(n)]


@pytest.mark.parametrize("ties", [0.0, 0.4, 1.0])
@pytest.mark.parametrize("descending", [False, True])
def test_average_rank_equals_pandas(spark, descending, ties):
    rows = _rows(1, 800, ties)
    df = spark.createDataFrame(rows, "g string, i string, v double")
    got = {r.i: r.rk for r in average_rank(df, ["g"], "v", "rk", descending).collect()}
    frame = pd.DataFrame(rows, columns=["g", "i", "v"])
    want = frame.assign(rk=frame.groupby("g")["v"].rank(ascending=not descending)).set_index("i")["rk"]
    assert len(got) == 800
    assert all((got[i] is None) == pd.isna(r) and (pd.isna(r) or got[i] == r) for i, r in want.items())


@pytest.mark.parametrize("ties", [0.0, 0.5, 0.98])
def test_band_is_exact(spark, ties):
    rows = _rows(7, 400, ties)
    df = spark.createDataFrame(rows, "g string, i string, v double")
    got = {(r.i, r.avg_rank) for r in best_band(df, ["g"], "v", "i", 10).where("avg_rank <= 10").collect()}
    frame = pd.DataFrame(rows, columns=["g", "i", "v"])
    frame["rk"] = frame.groupby("g")["v"].rank()
    assert got == {(r.i, r.rk) for r in frame[frame["rk"] <= 10].itertuples()}


def test_large_limit_is_cut_in_salted_parts(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    kept = best_rows(df, ["g"], [F.col("v")], 1500)
    assert [r.v for r in kept.orderBy("pos").collect()] == list(range(1500))


def test_large_limit_with_a_descending_order(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    kept = best_rows(df, ["g"], [F.col("v").desc_nulls_last()], 1001)
    assert [r.v for r in kept.orderBy("pos").collect()] == list(range(4999, 3998, -1))


def test_rank_of_missing_infinite_and_long_values(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(None, v) for v in (5.0, nan, -3.0, 1.0, 2.0, inf, -inf, None, 1.0)], "g string, v double")
    got = sorted((str((r.v, r.rk)) for r in average_rank(df, ["g"], "v", "rk").collect()))
    assert got == sorted(str(x) for x in [(5.0, 6.0), (nan, None), (-3.0, 2.0), (1.0, 3.5), (2.0, 5.0), (inf, 7.0), (-inf, 1.0), (None, None), (1.0, 3.5)])
    longs = spark.createDataFrame([("g", 2 ** 53 + k) for k in (0, 1, 2)], "g string, v long")
    assert sorted((r.v - 2 ** 53, r.rk) for r in average_rank(longs, ["g"], "v", "rk").collect()) == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_both_ranks_and_a_value_that_many_parts_share(spark):
    """A third of all rows tie in one group: they are dealt out to several tasks and still have one rank."""
    df = spark.range(60_000, numPartitions=6).select(
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), F.col("id").alias("i"),
        F.when(F.col("id") % 3 == 0, F.lit(7).cast("decimal(20,2)")).otherwise((F.col("id") % 50).cast("decimal(20,2)")).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a table as small as this is one part
    try:
        out = average_ranks(df, ["g"], "v", "up", "down")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.columns == ["g", "i", "v", "up", "down"]
    frame = out.toPandas()
    frame["v"] = frame["v"].astype(float)
    by = frame.groupby("g")["v"]
    assert (frame["up"] == by.rank()).all() and (frame["down"] == by.rank(ascending=False)).all() and len(frame) == 60_000
    stored = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])
    assert stored.where("v = 7 AND g = 'a'").select("_part").distinct().count() > 1


def test_a_missing_or_empty_group(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "g string, v double")
    assert sorted((r.g, r.up, r.down) for r in average_ranks(df, ["g"], "v", "up", "down").collect() if r.up) == [("b", 1.0, 1.0)]
    assert average_ranks(df, ["g"], "v", "up").count() == 3 and average_ranks(df.limit(0), ["g"], "v", "up").collect() == []


def test_map_side_limit_is_in_the_plan(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    plan = best_rows(df, ["g"], [F.col("v")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # once before and once after the shuffle


def test_carry_over_chunks(spark):
    values = {3: "x", 17: "y"}
    rows = [("k", i, values.get(i)) for i in range(40)] + [("l", 5, None)]
    df = spark.createDataFrame(rows, "k string, seq long, v string")
    got = {(r.k, r.seq): r.known for r in last_known_before(df, ["k"], "seq", F.col("v"), "known", 8).collect()}
    for i in range(40):
        assert got[("k", i)] == ("y" if i > 17 else "x" if i > 3 else None)
    assert got[("l", 5)] is None
