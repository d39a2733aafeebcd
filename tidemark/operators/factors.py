"""Factor registry and factor tables (factor, date, instrument, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.ranks import missing_as_null
from tidemark.functions.windows import change, full_mean, full_stddev, full_sum, history, ratio
from tidemark.operators.quality import duplicate_keys

DEFAULT_FACTORS = ("ma_deviation_20d", "volume_change_5d")

FactorFn = Callable[[DataFrame], "Column | DataFrame"]


def _rows() -> WindowSpec:
    return history("instrument")


def _gap_down_share(_: DataFrame) -> Column:
    return full_mean((F.col("open") < F.col("_prev_low")).cast("double"), _rows(), 20)


def _obv_change(_: DataFrame) -> Column:
    # The change of a running sum over 10 rows is the sum of those 10 rows.
    signed = F.coalesce(F.signum("_ret"), F.lit(0.0)) * F.col("volume")
    return F.when(F.lag("close", 10).over(_rows()).isNotNull(), F.sum(signed).over(_rows().rowsBetween(-9, 0)))


def _down_volume_share(_: DataFrame) -> Column:
    down = F.when(F.col("_ret") < 0, F.col("volume")).otherwise(F.lit(0.0))
    return ratio(full_sum(down, _rows(), 20), full_sum(F.col("volume"), _rows(), 20))


def _momentum(n: int) -> FactorFn:
    return lambda _: change(F.col("close"), _rows(), n)


_REGISTRY: dict[str, FactorFn] = {
    "daily_return": lambda _: F.col("_ret"),
    "momentum_5d": _momentum(5),
    "momentum_10d": _momentum(10),
    "momentum_20d": _momentum(20),
    "ma_deviation_20d": lambda _: ratio(F.col("close"), full_mean(F.col("close"), _rows(), 20)) - 1,
    "volatility_20d": lambda _: full_stddev(F.col("_ret"), _rows(), 20),
    "realized_vol_10d": lambda _: full_stddev(F.col("_ret"), _rows(), 10),
    "risk_adjusted_momentum_20d": lambda _: ratio(
        change(F.col("close"), _rows(), 20), full_stddev(F.col("_ret"), _rows(), 20)
    ),
    "downside_deviation_20d": lambda _: F.sqrt(full_mean(F.pow(F.least("_ret", F.lit(0.0)), 2), _rows(), 20)),
    "obv_10d_change": _obv_change,
    "volume_change_5d": lambda _: change(F.col("volume"), _rows(), 5),
    "upper_shadow_ratio": lambda _: ratio(
        F.col("high") - F.greatest("open", "close"), F.col("high") - F.col("low")
    ),
    "down_volume_share": _down_volume_share,
    "gap_down_frequency": _gap_down_share,
}


def register_factor(name: str, fn: FactorFn) -> None:
    """Add a factor: a function of the panel that returns a column over it.

    The panel it sees has one row per (date, instrument) and the helper columns
    ``_ret`` (one-row return) and ``_prev_low``. A function may instead return a
    DataFrame (date, instrument, value), for example from ``applyInPandas`` per instrument.
    """
    _REGISTRY[name] = fn


def factor_names() -> list[str]:
    return sorted(_REGISTRY)


def factor_table(panel: DataFrame, names: tuple[str, ...] = DEFAULT_FACTORS, keep: tuple[str, ...] = (), wide: bool = False) -> DataFrame:
    """(factor, date, instrument, value) plus the ``keep`` columns of the panel.

    All column factors come from one pass with one shuffle by instrument and are
    then unfolded into rows. NaN is a missing value and becomes null. ``wide`` leaves them folded, which spares a pivot:
    (date, instrument, the ``keep`` columns, a column per factor), a row for each row of the panel.
    """
    missing = [n for n in names if n not in _REGISTRY]
    if missing:
        raise KeyError(f"unknown factors: {', '.join(sorted(missing))}")
    prepared = panel.withColumns({
        "_ret": change(F.col("close"), _rows()),
        "_prev_low": F.lag("low").over(_rows()),
    })
    results = {name: _REGISTRY[name](prepared) for name in names}
    columns = {n: r for n, r in results.items() if isinstance(r, Column)}
    tables = [(n, r) for n, r in results.items() if isinstance(r, DataFrame)]
    if wide:
        out = prepared.select("date", "instrument", *keep, *[c.cast("double").alias(n) for n, c in columns.items()])
        for name, table in tables:
            out = out.join(table.select("date", "instrument", F.col("value").cast("double").alias(name)), ["date", "instrument"], "left")
        return out.select("date", "instrument", *keep, *[missing_as_null(F.col(n), "double").alias(n) for n in names])

    parts = []
    if columns:
        wide = prepared.select(
            "date", "instrument", *keep, *[c.cast("double").alias(f"f_{n}") for n, c in columns.items()]
        )
        cells = F.array(*[F.struct(F.lit(n).alias("factor"), missing_as_null(F.col(f"f_{n}"), "double").alias("value")) for n in columns])
        parts.append(wide.select("date", "instrument", *keep, F.inline(cells)))
    for name, table in tables:
        base = panel.select("date", "instrument", *keep)
        value = missing_as_null(F.col("value").cast("double"), "double")
        parts.append(base.join(table, ["date", "instrument"], "left").withColumn("value", value).withColumn("factor", F.lit(name)))
    columns_out = ["factor", "date", "instrument", "value", *keep]
    out = parts[0].select(*columns_out)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns_out))
    return out


def normalize_factor_output(df: DataFrame, name: str) -> DataFrame:
    """External factor output → (factor, date, instrument, value).

    Accepts any column order and ``datetime`` for ``date``; the value is the first
    other column. Raises when a key column is missing.
    """
    names = {c.lower(): c for c in df.columns}
    day = names.get("date") or names.get("datetime")
    instrument = names.get("instrument")
    if day is None or instrument is None:
        raise ValueError(f"{name}: needs a date and an instrument column")
    values = [c for c in df.columns if c not in (day, instrument)]
    if not values:
        raise ValueError(f"{name}: has no value column")
    return df.select(
        F.lit(name).alias("factor"), F.col(day).cast("date").alias("date"),
        F.col(instrument).alias("instrument"), missing_as_null(F.col(values[0]).cast("double"), "double").alias("value"),
    )


def load_factor_folder(spark: SparkSession, folder: str, names: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """(factors, rejected) from a folder with one subfolder of Parquet files per factor.

    factors: (factor, date, instrument, value), a factor named like its subfolder; ``names``
    keeps those factors only and raises for one that is not there. rejected: (factor, reason) of
    subfolders without the key columns or a value, and of factors with two rows for a key.
    The listing of subfolders goes through the driver: a handful of names.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    found = sorted(f.getPath().getName() for f in listed if f.isDirectory())
    rows = spark.createDataFrame([], "factor string, date date, instrument string, value double")
    broken = []
    for name in found:
        try:
            rows = rows.unionByName(normalize_factor_output(spark.read.parquet(f"{folder}/{name}"), name))
        except (ValueError, AnalysisException) as error:
            broken.append((name, "no files" if isinstance(error, AnalysisException) else str(error)))
    twice = duplicate_keys(rows, ["factor", "date", "instrument"]).select("factor").distinct()
    rejected = spark.createDataFrame(broken, "factor string, reason string").unionByName(
        twice.withColumn("reason", F.lit("two rows for a date and instrument")))
    factors = reject_ambiguous(rows)
    return (factors if names is None else select_factors(factors, names)), rejected


def reject_ambiguous(factors: DataFrame) -> DataFrame:
    """Drop every factor that has two rows for one (date, instrument)."""
    bad = duplicate_keys(factors, ["factor", "date", "instrument"]).select("factor").distinct()
    return factors.join(bad, "factor", "left_anti")


def select_factors(factors: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows of the named factors; raises when one is absent."""
    present = {r.factor for r in factors.select("factor").distinct().collect()}  # a handful of names
    missing = sorted(set(names) - present)
    if missing:
        raise KeyError(f"unknown factors: {', '.join(missing)}")
    return factors.where(F.col("factor").isin(*names))


def factor_summary(factors: DataFrame) -> DataFrame:
    """Per factor: rows, instruments, date range, moments and share of missing values."""
    value = missing_as_null(F.col("value"), "double")
    return factors.groupBy("factor").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("instrument").alias("n_instruments"),
        F.min("date").alias("start"), F.max("date").alias("end"),
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.avg(F.when(value.isNull(), 1.0).otherwise(0.0)).alias("na_ratio"),
    )


def factor_sample(factors: DataFrame, factor: str, rows: int = 3) -> DataFrame:
    """The last rows of one factor, for display."""
    return factors.where((F.col("factor") == factor) & F.col("value").isNotNull()).orderBy(
        F.col("date").desc(), F.col("instrument").desc()
    ).limit(rows)
