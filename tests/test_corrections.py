import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming.bars import ticks_to_bars
from tidemark.streaming.corrections import STATE_STORE, correcting_bars, newest_revisions

TICK = "symbol string, timestamp timestamp_ntz, price double, size_shares long"


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, source, out, checkpoint):
    stream = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(source)
    query = correcting_bars(stream, "2 days").writeStream.foreachBatch(
        lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_shuffled_ticks_with_a_stop_between_give_the_batch_bars(spark, state_store, tmp_path):
    r = random.Random(4)
    start = dt.datetime(2024, 1, 1, 9)
    ticks = [("HOT" if r.random() < 0.5 else f"s{r.randrange(5)}", start + dt.timedelta(seconds=i * 37, microseconds=i), float(r.randrange(900, 1100)), r.choice([1, 2, None]))
             for i in range(400)]
    ticks += [(None, start, 1.0, 1), ("x", None, 1.0, 1), ("x", start, None, 1)]
    r.shuffle(ticks)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for k in range(4):
        spark.createDataFrame(ticks[k::4], TICK).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):  # the query ends, and another one goes on from its checkpoint
            run(spark, source, out, checkpoint)
    revisions = spark.read.parquet(out)
    newest = newest_revisions(revisions.drop("batch"))
    good = spark.createDataFrame([t for t in ticks if None not in t[:3]], TICK).fillna(0)
    for level, interval in (("minute", "1 minute"), ("hour", "1 hour")):
        got = {(b.symbol, b.date): tuple(b)[3:-1] for b in newest.where(F.col("level") == level).collect()}
        want = {(b.symbol, b.date): tuple(b)[2:] for b in ticks_to_bars(good, interval).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    counts = revisions.where("level = 'hour'").groupBy("symbol", "date").agg(F.max("revision").alias("last"), F.count("*").alias("n")).collect()
    assert max(c["last"] for c in counts) == 4 and all(c["last"] == c["n"] for c in counts)


def test_state_stays_inside_spark_and_late_ticks_are_dropped(spark, state_store, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    start = dt.datetime(2024, 1, 1, 9, 30)
    deliveries = [[("a", start, 1.0, 1), ("b", dt.datetime(2024, 1, 9), 2.0, 1)], [("a", start, 9.0, 1), ("b", dt.datetime(2024, 1, 9), 3.0, None)]]
    for ticks in deliveries:
        spark.createDataFrame(ticks, TICK).coalesce(1).write.mode("append").parquet(source)
        run(spark, source, out, checkpoint)
    bars = newest_revisions(spark.read.parquet(out).drop("batch")).where("level = 'hour'").collect()
    assert {b.symbol: (b.open, b.close, b.volume_shares, b.trade_count, b.revision) for b in bars} == {"a": (1.0, 1.0, 1, 1, 1), "b": (2.0, 3.0, 1, 2, 2)}
    stream = correcting_bars(spark.readStream.schema(TICK).parquet(source), "2 days")
    plan = stream._jdf.queryExecution().analyzed().toString()  # a key in Python costs milliseconds, and most keys have one tick
    assert "Aggregate" in plan and "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
