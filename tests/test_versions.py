import os
import threading

import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.sources.versions import Conflict, VersionedStore, VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), ["symbol", "day"], buckets=4)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "symbol string, day int, close double")


def read(table, *args):
    return sorted(tuple(r) for r in table.read(*args).collect())


def folders(table):
    out = {}
    for folder, _, names in os.walk(f"{table.root}/data"):
        out.update({os.path.join(folder, n): os.path.getmtime(os.path.join(folder, n)) for n in names if n.endswith(".parquet")})
    return out


def test_versions_deletes_and_compaction(spark, table):
    assert table.read() is None and table.latest() == 0
    assert table.upsert(rows(spark, ("A", 1, 1.0), ("B", 1, 2.0), ("A", 1, 3.0)), order=F.col("close")) == 1
    assert table.upsert(rows(spark, ("A", 2, 5.0))) == 2
    assert table.upsert(rows(spark, ("A", 1, 7.0), ("C", 1, 9.0))) == 3
    assert table.delete(rows(spark, ("B", 1, None), ("Z", 9, None))) == 4
    want = {1: [("A", 1, 3.0), ("B", 1, 2.0)], 2: [("A", 1, 3.0), ("A", 2, 5.0), ("B", 1, 2.0)],
            3: [("A", 1, 7.0), ("A", 2, 5.0), ("B", 1, 2.0), ("C", 1, 9.0)], 4: [("A", 1, 7.0), ("A", 2, 5.0), ("C", 1, 9.0)]}
    assert all(read(table, v) == w for v, w in want.items())
    assert table.compact() == 5 and all(read(table, v) == w for v, w in {**want, 5: want[4]}.items())
    assert read(table, None, ["A"]) == want[4][:2]
    table.upsert(rows(spark, ("B", 1, 4.0)))  # a removed key comes back
    assert ("B", 1, 4.0) in read(table) and table.compact(least=9) == 6
    with pytest.raises(ValueError):
        table.read(99)
    table.vacuum(keep=1)
    assert table.versions() == [6] and ("B", 1, 4.0) in read(table)
    assert all(any(c in f for c in {c for e in table._state(6)["live"].values() for c, _ in e}) for f in folders(table))


def test_a_small_delivery_writes_small_files_and_leaves_others(spark, table):
    table.upsert(spark.range(2000).select(F.concat(F.lit("S"), F.col("id") % 50).alias("symbol"), F.col("id").cast("int").alias("day"), F.lit(1.0).alias("close")))
    before = folders(table)
    table.upsert(rows(spark, ("S7", 7, 2.0)))
    after = folders(table)
    assert before.items() <= after.items() and len(after) == len(before) + 1
    bucket = (set(after) - set(before)).pop().split("bucket=")[1].split("/")[0]
    table.compact()
    live = {b: e for b, e in table._state(3)["live"].items()}
    assert live[bucket][0][0] not in "".join(before) and all(e == table._state(1)["live"][b] for b, e in live.items() if b != bucket)
    assert table.read().count() == 2000 and table.read().where("close = 2").count() == 1


def test_two_interleaved_writers_lose_nothing(spark, table):
    table.upsert(rows(spark, ("A", 0, 0.0)))
    other = VersionedTable(spark, table.root, table.key)
    publish, met = table._publish, []

    def late(version, state):
        if not met:  # between this writer's reading of the log and its commit another one commits
            met.append(other.upsert(rows(spark, ("A", 2, 2.0), ("A", 1, 9.0))))
        return publish(version, state)

    table._publish = late
    assert table.upsert(rows(spark, ("A", 1, 1.0))) == 3 and met == [2]
    assert read(table) == [("A", 0, 0.0), ("A", 1, 1.0), ("A", 2, 2.0)] and read(table, 2) == [("A", 0, 0.0), ("A", 1, 9.0), ("A", 2, 2.0)]
    with pytest.raises(Conflict):
        other.upsert(rows(spark, ("A", 1, 5.0)), expect=2)
    assert other.upsert(rows(spark, ("A", 1, 5.0)), expect=3) == 4


def test_many_writers_at_once(spark, table):
    writers = [threading.Thread(target=lambda i=i: VersionedTable(spark, table.root, table.key, 4).upsert(rows(spark, (f"S{i}", i, float(i)), ("ALL", 0, float(i)))))
               for i in range(6)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert table.latest() == 6 and table.read().count() == 7


def test_compaction_keeps_what_comes_in_meanwhile_and_gives_way_to_another(spark, table):
    for i in range(3):
        table.upsert(rows(spark, ("A", i, float(i)), ("A", 0, float(i))))
    write, met = table._write, []
    other = VersionedTable(spark, table.root, table.key)

    def slow(*args):
        out = write(*args)
        met.append(other.upsert(rows(spark, ("A", 0, 99.0))))
        return out

    table._write = slow
    assert table.compact() == 5 and read(table) == [("A", 0, 99.0), ("A", 1, 1.0), ("A", 2, 2.0)]
    table._write = lambda *args: (write(*args), other.compact())[0]
    with pytest.raises(Conflict):
        table.compact()
    assert read(table) == [("A", 0, 99.0), ("A", 1, 1.0), ("A", 2, 2.0)]


def test_a_delivery_comes_twice(spark, table):
    first = table.upsert(rows(spark, ("A", 1, 1.0)), token="batch-1")
    table.upsert(rows(spark, ("A", 1, 2.0)), token="batch-2")
    assert table.upsert(rows(spark, ("A", 1, 1.0)), token="batch-1") == first and read(table) == [("A", 1, 2.0)]
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("A", 1)], "symbol string, day int"))


def test_store(spark, tmp_path, make_bars):
    store = VersionedStore(spark, str(tmp_path / "s"), buckets=3)
    assert store.read("daily").dtypes[3] == ("open", "double") and store.read("daily").count() == 0 and store.read_raw("p", "d") is None
    store.write("daily", make_bars({"A": [1.0, 2.0], "B": [3.0]}))
    store.write("daily", make_bars({"A": [9.0]}))
    store.write("daily", make_bars({"A": [9.0]}).limit(0))
    got = lambda df: sorted((r.symbol, r.date, r.close) for r in df.collect())
    assert got(store.read("daily")) == [("A", day(0), 9.0), ("A", day(1), 2.0), ("B", day(0), 3.0)]
    assert got(store.read("daily", ["A"], day(1))) == [("A", day(1), 2.0)] and got(store.read("daily", version=1))[0] == ("A", day(0), 1.0)
    names = "symbol string, name string"
    store.write_reference("lists", spark.createDataFrame([("A", "x"), ("B", "y")], names), ["symbol"])
    store.write_reference("lists", spark.createDataFrame([("A", "z")], names), ["symbol"])
    assert sorted(tuple(r) for r in store.read("lists").collect()) == [("A", "z"), ("B", "y")]
    for _ in range(2):
        store.write_raw("p", "events", spark.createDataFrame([("A", "e")], "symbol string, what string"))
    assert store.read_raw("p", "events").count() == 2
    with pytest.raises(ValueError):
        store.import_snapshot(make_bars({"A": [-1.0]}))
    assert store.import_snapshot(make_bars({"2330": [4.0]}, source="manual")) == 1 and store.read("daily", ["2330"]).count() == 1
    store.register_views(("daily",))
    assert store.query("select count(*) n from daily").first().n == 4
