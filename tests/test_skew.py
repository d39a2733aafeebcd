"""One key with more than a third of all rows: same results, and the work is cut before the shuffle."""

import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.ranks import average_rank, best_band
from tidemark.operators.changes import change_status
from tidemark.operators.ic import daily_rank_ic
from tidemark.sources.store import latest_rows
from tidemark.streaming.bars import sessions, ticks_to_bars


def hot_ticks(spark, n=30_000):
    hot = F.when(F.col("id") % 5 < 2, F.lit("HOT")).otherwise(F.concat(F.lit("S"), (F.col("id") % 97).cast("string")))
    return spark.range(n).select(
        hot.alias("symbol"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 37 + F.floor(F.col("id") / 1000) * 9000).cast("timestamp_ntz").alias("timestamp"),
        (F.col("id") % 1013).cast("double").alias("price"), F.lit(1).cast("long").alias("size_shares"))


def test_hot_symbol_bars_and_sessions(spark):
    ticks = hot_ticks(spark)
    frame = ticks.toPandas().sort_values(["symbol", "timestamp"])
    hours = frame.assign(h=frame["timestamp"].dt.floor("h")).groupby(["symbol", "h"])["price"].agg(["first", "last", "max", "min", "count"])
    bars = {(r.symbol, r.date): (r.open, r.close, r.high, r.low, r.trade_count) for r in ticks_to_bars(ticks, "1 hour").collect()}
    assert bars == {k: tuple(v) for k, v in hours.iterrows()}
    gap = frame.groupby("symbol")["timestamp"].diff() >= pd.Timedelta(seconds=1800)
    want = frame.assign(s=gap.groupby(frame["symbol"]).cumsum()).groupby(["symbol", "s"])["timestamp"].agg(["min", "max", "count"])
    got = sorted((r.symbol, r.session_start, r.session_end, r.n) for r in sessions(ticks, 1800).collect())
    assert got == sorted((k[0], v["min"].to_pydatetime(), v["max"].to_pydatetime(), v["count"]) for k, v in want.iterrows())


def test_hot_value_and_hot_date(spark):
    # A third of the rows share one value; one date has most of the rows.
    df = spark.range(6000).select(
        F.lit("f").alias("factor"), F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 7 + 2).alias("date"),
        F.format_string("i%05d", F.col("id")).alias("instrument"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.sin(F.col("id").cast("double"))).alias("value"),
        F.when(F.col("id") % 4 == 0, 0.0).otherwise(F.cos(F.col("id") * 1.7)).alias("fwd"))
    frame = df.toPandas()
    frame["rk"] = frame.groupby("date")["value"].rank()
    got = {r.instrument: r.rk for r in average_rank(df, ["factor", "date"], "value", "rk").collect()}
    assert got == dict(zip(frame["instrument"], frame["rk"]))
    band = {r.instrument for r in best_band(df, ["date"], "value", "instrument", 20).where("avg_rank <= 20").collect()}
    assert band == set(frame[frame["rk"] <= 20]["instrument"])
    got = {r.date: r.rank_ic for r in daily_rank_ic(df).collect()}
    want = {d: g["value"].rank().corr(g["fwd"].rank()) for d, g in frame.groupby("date")}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)


def test_hot_key_in_log_and_upsert(spark):
    ops = F.element_at(F.array(F.lit("insert"), F.lit("replace"), F.lit("delete"), F.lit("replace")), (F.col("id") % 4 + 1).cast("int"))
    log = spark.range(8000).select(
        F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("S"), (F.col("id") % 301).cast("string"))).alias("symbol"),
        F.lit("2024-01-01").cast("date").alias("date"), F.col("id").alias("seq"), ops.alias("op"))
    state = log.limit(0).select("symbol", "date")
    exists, want = set(), {}
    for r in log.orderBy("seq").collect():
        had = r.symbol in exists
        want[r.seq] = {"insert": 409 if had else 201, "replace": 200 if had else 404, "delete": 204 if had else 404}[r.op]
        if r.op != "replace":
            (exists.add if r.op == "insert" else exists.discard)(r.symbol)
    assert {r.seq: r.status for r in change_status(state, log).collect()} == want
    newest = latest_rows([log], ["symbol", "date"], F.col("seq"))
    assert {r.symbol: r.seq for r in newest.collect()} == {r.symbol: r.m for r in log.groupBy("symbol").agg(F.max("seq").alias("m")).collect()}
