import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(i: int, start: str = "2024-01-01") -> dt.date:
    return dt.date.fromisoformat(start) + dt.timedelta(days=i)


BAR = ["symbol", "market", "date", "open", "high", "low", "close", "volume_shares", "turnover_twd", "trade_count", "source"]
BAR_TYPES = ("symbol string, market string, date date, open double, high double, low double, close double, "
             "volume_shares long, turnover_twd double, trade_count long, source string")


@pytest.fixture
def make_bars(spark):
    """Bars from closes per symbol; other columns take plain values unless given as lists."""

    def build(closes: dict, volumes=None, market="TSE", source="finmind", dates=None):
        rows = []
        for symbol, series in closes.items():
            for i, close in enumerate(series):
                volume = (volumes or {}).get(symbol, [1_000_000] * len(series))[i]
                date = (dates or {}).get(symbol, [day(k) for k in range(len(series))])[i]
                rows.append((symbol, market, date, close, close, close, close, volume, float(volume) * (close or 0), 10, source))
        return spark.createDataFrame(rows, BAR_TYPES)

    return build


def column(df, name: str, *order: str) -> list:
    return [r[name] for r in df.orderBy(*(order or ("date",))).collect()]


def near(values, expected, tolerance=1e-9) -> bool:
    return len(values) == len(expected) and all(
        (a is None and b is None) or (a is not None and b is not None and abs(a - b) < tolerance)
        for a, b in zip(values, expected)
    )
