import datetime as dt
import random

import pytest

from tidemark.operators.paged import SortedPages


def keys(df):
    return [(r.date, r.symbol) for r in df.collect()]


def test_pages_by_offset_and_by_key(spark, tmp_path):
    r = random.Random(1)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), f"s{k:02d}", float(d * k)) for d in range(60) for k in range(30) if r.random() < 0.8]
    r.shuffle(rows)
    want = sorted(((d, s) for d, s, _ in rows), key=lambda x: (-x[0].toordinal(), x[1]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pages = SortedPages.build(spark.createDataFrame(rows, "date date, symbol string, close double"), str(tmp_path), 7)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert pages.total() == len(rows) and pages.zones.count() == 7
    for offset in (0, 1, 199, 200, 777, len(rows) - 5, len(rows), 10 ** 6):
        assert keys(pages.at(100, offset)) == want[offset:offset + 100]
    seen, token = [], None
    while True:
        page = keys(pages.after(token, 130))
        if not page:
            break
        seen += page
        token = page[-1]
    assert seen == want
    gone = (want[400][0], want[400][1] + "x")  # a key that no row has
    assert keys(pages.after(gone, 50)) == want[401:451]
    files = pages.at(10, 900).inputFiles()
    assert len({f.split("range=")[1].split("/")[0] for f in files}) <= 2
    with pytest.raises(ValueError):
        pages.at(501)
    with pytest.raises(ValueError):
        pages.at(5, -1)


def test_empty_table(spark, tmp_path):
    pages = SortedPages.build(spark.createDataFrame([], "date date, symbol string, close double"), str(tmp_path))
    assert pages.total() == 0 and pages.at(5).collect() == [] and pages.after((dt.date(2024, 1, 1), "a"), 5).collect() == []
