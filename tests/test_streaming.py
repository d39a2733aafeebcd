import datetime as dt

import pytest

from tidemark.sources.store import PanelStore
from tidemark.streaming import bars as streaming

TICK = "symbol string, timestamp timestamp_ntz, price double, size_shares long, event_id long"


def at(minutes: float) -> dt.datetime:
    return dt.datetime(2024, 1, 2, 9) + dt.timedelta(minutes=minutes)


@pytest.fixture
def ticks(spark):
    rows = [("A", at(m), float(100 + (m * 7) % 11), 10, int(m * 10)) for m in (0, 3, 20, 59, 61, 62, 190, 191, 600)]
    rows += [("B", at(m), 50.0 + m, 5, int(m * 10) + 1) for m in (1, 2, 400)]
    return spark.createDataFrame(rows, TICK)


def run(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


@pytest.fixture
def stream(spark, ticks, tmp_path):
    # The last tick moves the watermark past every other bar.
    late = spark.createDataFrame([("Z", at(5000), 1.0, 1, 99999)], TICK)
    ticks.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "ticks"))
    return spark.readStream.schema(TICK).parquet(str(tmp_path / "ticks"))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.where("symbol <> 'Z'").collect())


def test_hour_bars(ticks):
    got = streaming.ticks_to_bars(ticks, "1 hour").where("symbol = 'A'").orderBy("date").collect()
    assert (got[0].open, got[0].close, got[0].volume_shares, got[0].trade_count) == (100.0, 106.0, 40, 4)
    assert [r.date for r in got] == [at(0), at(60), at(180), at(600)]


def test_stream_equals_batch(spark, ticks, stream):
    names = ("symbol", "date", "open", "high", "low", "close", "volume_shares")
    live = run(spark, streaming.ticks_to_bars(stream, "1 hour", watermark="10 minutes"), "live_bars")
    assert rows(live, *names) == rows(streaming.ticks_to_bars(ticks, "1 hour"), *names)


def test_sessions_equal_stream_and_builtin(spark, ticks, stream):
    names = ("symbol", "session_start", "session_end", "n", "total")
    ours = rows(streaming.sessions(ticks, 3600), *names)
    builtin = ticks.groupBy("symbol", streaming.F.session_window("timestamp", "3600 seconds")).agg(
        streaming.F.min("timestamp").alias("session_start"), streaming.F.max("timestamp").alias("session_end"),
        streaming.F.count("price").alias("n"), streaming.F.sum("price").alias("total"))
    assert ours == rows(builtin, *names)
    live = run(spark, streaming.stream_sessions(stream, "3600 seconds", "10 minutes"), "live_sessions")
    assert rows(live, *names) == ours


def test_pause_of_exactly_the_gap_splits(spark):
    df = spark.createDataFrame([("A", at(0), 1.0, 1, 1), ("A", at(60), 1.0, 1, 2), ("A", at(119.99), 1.0, 1, 3)], TICK)
    assert sorted(r.n for r in streaming.sessions(df, 3600).collect()) == [1, 2]


def test_redelivered_rows_overwrite(spark, ticks, tmp_path):
    store = PanelStore(spark, str(tmp_path / "store"))
    source = str(tmp_path / "in")
    bars = streaming.ticks_to_bars(ticks, "1 hour")
    schema = bars.schema
    for round_ in range(2):  # the same delivery twice, then nothing new
        bars.coalesce(1).write.mode("append").parquet(source)
        query = streaming.upsert_stream(spark.readStream.schema(schema).parquet(source), store, "hour_bars", str(tmp_path / "cp"))
        query.awaitTermination()
        stored = spark.read.parquet(f"{store.root}/normalized/hour_bars")
        assert stored.count() == bars.count()


def test_duplicates_within_the_watermark(spark, ticks, tmp_path):
    ticks.unionByName(ticks).coalesce(1).write.parquet(str(tmp_path / "twice"))
    source = spark.readStream.schema(TICK).parquet(str(tmp_path / "twice"))
    got = run(spark, streaming.deduplicate(source, ["symbol", "event_id"], "20 hours"), "deduplicated")
    assert got.count() == ticks.count()
