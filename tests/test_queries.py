"""Registered queries against their SQL on the smallest driver tables."""

import os

import pytest

from workload.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "apply_changes", "bars_page", "normalize_bars", "market_report", "dense_export", "verify_panel", "ml_features",
    "adjusted_prices", "pit_eligibility", "merge_delisted", "user_sessions", "ngram_similar_pairs", "cross_rank_hard",
    "portfolio_metrics", "trade_ledger",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def test_catalog():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(SAMPLE) <= set(entry.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == {"model_rank_ic"} and set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r.factor for r in rows} == {"ma_deviation_20d", "volume_change_5d"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    from workload.check import compare

    assert compare(spark, FOLDER, [name]) == []
