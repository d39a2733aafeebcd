"""Evaluation built from portfolios and ICs: interpretation flags and out-of-sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.portfolio import portfolio_metrics

# Thresholds of the interpretation.
SIGNIFICANT_T, EROSION_LIMIT_PP, MIN_SPAN_DAYS = 2.0, 3.0, 60


def stability_flags(stability: DataFrame) -> DataFrame:
    """(subject, flag, value) per factor: short sample, sign flip, insignificant or confirmed."""
    flag = (
        F.when(F.col("oos_ic").isNull(), "short_sample")
        .when(F.col("is_ic").isNotNull() & ((F.col("is_ic") >= 0) != (F.col("oos_ic") >= 0)), "sign_flip")
        .when(F.abs("oos_t") < SIGNIFICANT_T, "insignificant")
        .otherwise("confirmed")
    )
    return stability.select(F.col("factor").alias("subject"), flag.alias("flag"), F.col("oos_t").alias("value"))


def erosion_flags(erosion: DataFrame, subject: str = "combined") -> DataFrame:
    """How much of the combined portfolio's return the costs take."""
    pp = F.col("erosion_pp")
    flag = F.when(pp > EROSION_LIMIT_PP, "erosion_high").when(pp > 0, "erosion_low").otherwise("no_erosion")
    return erosion.select(F.lit(subject).alias("subject"), flag.alias("flag"), pp.alias("value"))


def concentration_flags(excess: DataFrame, subject: str = "combined") -> DataFrame:
    """The year with the largest excess over the benchmark (the first such year on a tie)."""
    known = excess.where(F.col("excess").isNotNull())
    best = known.agg(F.max_by(F.struct("year", "excess"), F.struct("excess", -F.col("year"))).alias("best"))
    return best.where(F.col("best").isNotNull()).select(
        F.lit(subject).alias("subject"),
        F.concat(F.lit("best_year_"), F.col("best.year").cast("string")).alias("flag"),
        F.col("best.excess").alias("value"),
    )


def drawdown_flags(combined: DataFrame, benchmark: DataFrame, subject: str = "combined") -> DataFrame:
    """Whether the portfolio fell deeper than the benchmark. Both sides have one row."""
    base = benchmark.select(F.col("max_drawdown").alias("_bench")).withColumn("_k", F.lit(1))
    joined = combined.select("max_drawdown").withColumn("_k", F.lit(1)).join(base, "_k")
    flag = F.when(F.col("max_drawdown") > F.col("_bench"), "deeper_than_benchmark").otherwise("within_benchmark")
    return joined.select(F.lit(subject).alias("subject"), flag.alias("flag"), F.col("max_drawdown").alias("value"))


def out_of_sample_table(daily: DataFrame, combined: DataFrame, benchmark: DataFrame, oos_ics: DataFrame,
                        directions: DataFrame) -> DataFrame:
    """Per factor and for the combination: out-of-sample and in-sample results next to the benchmark.

    daily and combined hold both spans; benchmark is (span, date, di, ret); oos_ics the
    daily rank ICs inside the out-of-sample span.
    """
    rows = daily.select("factor", "span", "date", "net", "gross").unionByName(
        combined.select(F.lit("combined").alias("factor"), "span", "date", "net", "gross")
    )
    net = portfolio_metrics(rows, ["factor", "span"], "net")
    gross = portfolio_metrics(rows, ["factor", "span"], "gross")
    oos = net.where(F.col("span") == "oos").select(
        "factor", F.col("annual_return").alias("oos_annual"), F.col("sharpe").alias("oos_sharpe"),
        F.col("max_drawdown").alias("oos_mdd"),
    )
    oos_gross = gross.where(F.col("span") == "oos").select("factor", F.col("annual_return").alias("oos_gross_annual"))
    in_sample = net.where(F.col("span") == "is").select("factor", F.col("annual_return").alias("is_annual"))
    bench = portfolio_metrics(benchmark.where(F.col("span") == "oos"), ["span"], "ret").agg(
        F.max("annual_return")
    ).scalar()
    ic = oos_ics.groupBy("factor").agg(
        F.avg("rank_ic").alias("_mean"), F.stddev_samp("rank_ic").alias("_std"), F.count(F.lit(1)).alias("_n")
    ).where((F.col("_n") > 10) & (F.col("_std") > 0)).select(
        "factor", F.col("_mean").alias("oos_ic"),
        (F.col("_mean") / (F.col("_std") / F.sqrt("_n"))).alias("oos_ic_t"),
    )
    return (
        oos.join(oos_gross, "factor").join(in_sample, "factor")
        .join(directions.select("factor", "direction"), "factor", "left").join(ic, "factor", "left")
        .withColumn("direction", F.coalesce("direction", F.lit("mixed")))
        .withColumn("bench_annual", bench)
        .withColumn("oos_excess", F.col("oos_annual") - F.col("bench_annual"))
        .select("factor", "direction", "oos_annual", "oos_sharpe", "oos_mdd", "oos_gross_annual", "is_annual",
                "bench_annual", "oos_excess", "oos_ic", "oos_ic_t")
    )


def require_long_spans(spans: DataFrame, min_days: int = MIN_SPAN_DAYS) -> DataFrame:
    """Fail the job when a span has fewer than ``min_days`` dates."""
    checked = F.assert_true(
        F.col("n_days") >= min_days, F.concat(F.lit("span too short: "), F.col("span"))
    )
    return spans.where(checked.isNull())
