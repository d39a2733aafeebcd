import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.operators.factors import factor_sample
from tidemark.operators.model import fit, model_rank_ic, score, split_by_time
from tidemark.operators.portfolio import Rules
from tidemark.operators.features import ml_features
from tidemark.operators.universe import UniverseSpec
from tidemark.plans import manifest, report, updates
from tidemark.plans.research import Research
from tidemark.sources.store import PanelStore


@pytest.fixture
def store(spark, tmp_path):
    return PanelStore(spark, str(tmp_path / "data"))


def test_daily_run(store, make_bars):
    bars, official = make_bars({"A": [10.0, 13.0], "B": [5.0, 5.0]}), make_bars({"A": [10.0, 14.0]})
    result = updates.run_daily(store, bars, "finmind", official)
    assert {(r.symbol, r.rows) for r in result.counts.collect()} == {("A", 2), ("B", 2)}
    assert [(r.symbol, r.field) for r in result.mismatches.collect()] == [("A", "close")]
    assert [r.check for r in result.issues.collect()] == ["price_jump"]
    assert store.query("SELECT count(*) AS n FROM daily").first().n == 4
    assert store.read_raw("finmind", "daily").count() == 4


def test_hourly_and_instruments(store, spark, make_bars):
    hourly = make_bars({"A": [1.0]}).withColumn("date", F.lit(dt.datetime(2024, 1, 2, 9)).cast("timestamp_ntz"))
    updates.run_hourly(store, hourly, "yfinance")
    updates.run_hourly(store, hourly.withColumn("close", F.lit(2.0)), "yfinance")
    assert [(r.date, r.close) for r in store.read("hourly").collect()] == [(dt.datetime(2024, 1, 2, 9), 2.0)]
    names = spark.createDataFrame([("A", "a", "TSE", "", None, None, "active", day(0))], store.read("instrument").schema)
    assert updates.run_instruments(store, names) == 1 and updates.run_instruments(store, names.limit(0)) == 0
    assert store.read("instrument").count() == 1


def test_backfill_resumes(store, spark, make_bars):
    spans = spark.createDataFrame([("A", dt.date(2022, 6, 1), dt.date(2023, 6, 30))], "symbol string, start date, end date")
    plan = updates.plan_backfill(store, spans, ["daily"])
    assert plan.count() == 2
    landed = make_bars({"A": [1.0, 2.0]}, dates={"A": [dt.date(2022, 7, 1), dt.date(2023, 7, 1)]})  # the second is past the end
    left = updates.load_backfill(store, "daily", landed, plan)
    assert [r.year for r in left.collect()] == [2023]
    assert [r.year for r in updates.plan_backfill(store, spans, ["daily"]).collect()] == [2023]
    gone = spark.createDataFrame([("A", "a", dt.date(2022, 12, 1))], "symbol string, name string, delist_date date")
    assert updates.plan_backfill(store, spans, ["margin"], gone).first().seg_end == dt.date(2022, 12, 1)


def test_manifest(spark, tmp_path):
    days = [dt.date(2024, m, 2) for m in range(1, 10)]
    rows = [("A", "a", d) for d in days] + [("B", "b", d) for d in days[:3]]
    quotes = spark.createDataFrame(rows, "symbol string, name string, date date")
    span = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 9, 30))], "start date, end date")
    built = manifest.build_manifest(quotes, span, F.lit(dt.date(2024, 9, 30)))
    assert built.seen.count() == 12 and built.intervals.count() == 2
    assert [(r.symbol, r.delist_date) for r in built.delisted.collect()] == [("B", None)]
    manifest.write_manifests(built, str(tmp_path), "20240930")
    assert spark.read.csv(str(tmp_path / "seen_20240930"), header=True).count() == 2
    newer = built.seen.where("seen_date >= '2024-03-01'")
    assert manifest.extend_seen(built.seen.where("seen_date < '2024-05-01'"), newer).count() == 12


@pytest.fixture(scope="module")
def panel(spark):
    """Twelve names over 150 days with prices that wander deterministically."""
    days = spark.range(150).select(F.col("id").alias("d"))
    names = days.select("d", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    wave = F.sin(F.col("d") * (F.col("k") + 1) / 17.0) * 6 + F.col("k") + 50
    return names.where("NOT (k = 3 AND d BETWEEN 40 AND 60)").select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int")).alias("date"),
        F.concat(F.lit("TSE"), F.lpad(F.col("k").cast("string"), 4, "0")).alias("instrument"),
        wave.alias("open"), wave.alias("close"), (wave + 1).alias("high"), (wave - 1).alias("low"),
        (F.lit(1000.0) + F.pmod(F.col("d") * (F.col("k") + 3), F.lit(29)) * 50).alias("volume"), F.lit(1.0).alias("factor"))


RULES = Rules(top_n=2, rebalance_days=10, buffer_n=4)


def test_backtest_report(panel):
    run = Research(panel, rules=RULES)
    text = report.backtest_report(run)
    assert "# Portfolio backtest" in text and "combined" in text and "## Trades" in text
    trades = run.metrics().where("factor <> 'combined'").agg(F.sum("trade_count")).first()[0]
    summary = run.ledger_report().agg(F.sum("n_closed"), F.sum("n_open")).first()
    assert trades == 2 * summary[0] + summary[1]
    assert "## Rank IC" in report.factor_report(run)
    assert factor_sample(run.factors, "volume_change_5d").count() == 3


def test_other_runs(panel):
    assert "oos_annual" in report.out_of_sample_report(Research(panel, rules=RULES, is_ratio=.5))
    assert "overnight_pp" in report.timing_report(Research(panel, rules=RULES, direction="top"))
    pit = Research(panel, rules=RULES, universe=UniverseSpec.pit_liquidity(6, 5, 10), direction="bottom")
    assert pit.sizes().first().size_max <= 6 and pit.holdings.count() == 2 * 15
    with pytest.raises(ValueError):
        Research(panel, rules=RULES, direction="short").timing()
    with pytest.raises(Exception, match="span too short"):
        Research(panel.where("date < '2024-03-01'"), rules=RULES, is_ratio=.7).spans.collect()


def test_lazy_and_stored_runs_agree(panel):
    columns = ["factor", "di", "net", "trades"]
    stored = Research(panel, rules=RULES, direction="top").daily.select(columns)
    lazy = Research(panel, rules=RULES, direction="top", reuse=False).daily.select(columns)
    assert sorted(stored.collect()) == sorted(lazy.collect())


def test_model(panel):
    daily = panel.select(
        F.col("instrument").alias("symbol"), "date", "open", "high", "low", "close",
        F.col("volume").cast("long").alias("volume_shares"), (F.col("volume") * F.col("close")).alias("turnover_twd"))
    train, test = split_by_time(ml_features(daily))
    assert train.agg(F.max("date")).first()[0] < test.agg(F.min("date")).first()[0]
    assert test.select("date").distinct().count() == 30
    ics = model_rank_ic(score(fit(train, max_iter=2, max_depth=2), test))
    assert ics.count() > 20 and ics.agg(F.max(F.abs("rank_ic"))).first()[0] <= 1 + 1e-9


def test_report_refuses_large_tables(spark):
    with pytest.raises(ValueError):
        report.to_markdown(spark.range(20_000).toDF("x"))
