"""Forward returns, cross-sectional rank IC and what is decided from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ranks import average_rank, missing_as_null
from tidemark.functions.windows import at_calendar_offset, ratio

# Names a day needs, days a summary needs.
MIN_SYMBOLS, MIN_DAYS = 5, 10


def with_forward_return(panel: DataFrame, days: int = 5, group: tuple[str, ...] = ("instrument",)) -> DataFrame:
    """Add ``fwd``: adjusted return to the row ``days`` calendar rows ahead (needs ``adj`` and ``di``)."""
    ahead = at_calendar_offset(F.col("adj"), days, *group)
    return panel.withColumn("fwd", ratio(ahead, F.col("adj")) - 1)


def align(factors: DataFrame, forward: DataFrame) -> DataFrame:
    """Factor rows that have both a value and a forward return (forward: date, instrument, fwd)."""
    returns = forward.where(F.col("fwd").isNotNull()).select("date", "instrument", "fwd")
    return factors.where(F.col("value").isNotNull()).join(returns, ["date", "instrument"])


def daily_rank_ic(pairs: DataFrame, min_symbols: int = MIN_SYMBOLS, keys: tuple[str, ...] = ("factor",),
                  day: str = "date") -> DataFrame:
    """(keys…, date, n, rank_ic): Spearman correlation of ``value`` and ``fwd`` per day.

    Both are ranked on their common rows (null and NaN are missing); days with fewer than
    ``min_symbols`` names or no variation are left out. Ranks come from value buckets
    whatever the width of a day; the sums are combined map-side.
    """
    group = [*keys, day]
    kinds = dict(pairs.dtypes)
    both = [missing_as_null(F.col(c), kinds[c]) for c in ("value", "fwd")]
    common = pairs.select(*group, "value", "fwd").where(both[0].isNotNull() & both[1].isNotNull())
    ranked = average_rank(average_rank(common, group, "value", "_rv"), group, "fwd", "_rf").withColumn("_c", F.lit(1))

    def mean_of(product: Column) -> Column:
        return F.sum(F.col("_c") * product) / F.sum("_c")

    centre = (F.sum("_c") + 1) / F.lit(2.0)  # the mean of average-tie ranks
    moments = ranked.groupBy(*group).agg(
        F.sum("_c").alias("n"),
        (mean_of(F.col("_rv") * F.col("_rf")) - centre * centre).alias("_cov"),
        (mean_of(F.col("_rv") * F.col("_rv")) - centre * centre).alias("_vv"),
        (mean_of(F.col("_rf") * F.col("_rf")) - centre * centre).alias("_vf"),
    )
    return moments.where((F.col("n") >= min_symbols) & (F.col("_vv") > 0) & (F.col("_vf") > 0)).select(
        *group, "n", (F.col("_cov") / F.sqrt(F.col("_vv") * F.col("_vf"))).alias("rank_ic")
    )


def ic_summary(ics: DataFrame, keys: tuple[str, ...] = ("factor",), min_days: int = MIN_DAYS) -> DataFrame:
    """Mean, ICIR, share of positive days, t statistic; too short or constant series are left out."""
    moments = ics.groupBy(*keys).agg(
        F.avg("rank_ic").alias("ic_mean"),
        F.stddev_samp("rank_ic").alias("_std"),
        F.avg((F.col("rank_ic") > 0).cast("double")).alias("ic_pos_ratio"),
        F.count(F.lit(1)).alias("n_days"),
    )
    return moments.where((F.col("n_days") >= min_days) & (F.col("_std") > 0)).select(
        *keys, "ic_mean",
        (F.col("ic_mean") / F.col("_std")).alias("icir"),
        "ic_pos_ratio",
        (F.col("ic_mean") / (F.col("_std") / F.sqrt("n_days"))).alias("t_stat"),
        "n_days",
    )


def split_index(n_days, is_ratio: float = 0.7):
    """Number of calendar days in the first part of the sample."""
    return F.floor(n_days * F.lit(is_ratio))


def ic_stability(ics: DataFrame, cal: DataFrame, is_ratio: float = 0.7, min_days: int = MIN_DAYS) -> DataFrame:
    """Per factor: mean IC before and after the split and the t statistic of the second part."""
    n_days = cal.agg(F.max("di")).scalar()
    rows = ics.join(F.broadcast(cal), "date").withColumn("_first", F.col("di") <= split_index(n_days, is_ratio))
    first, later = F.when(F.col("_first"), F.col("rank_ic")), F.when(~F.col("_first"), F.col("rank_ic"))
    parts = rows.groupBy("factor").agg(
        F.avg(first).alias("is_ic"), F.avg(later).alias("_mean"),
        F.stddev_samp(later).alias("_std"), F.count(later).alias("_n"),
    )
    usable = (F.col("_n") >= min_days) & (F.col("_std") > 0)
    t_stat = F.when(usable, F.col("_mean") / (F.col("_std") / F.sqrt("_n")))
    return parts.select("factor", "is_ic", F.when(usable, F.col("_mean")).alias("oos_ic"), t_stat.alias("oos_t"))


def auto_direction(ics: DataFrame, factors: DataFrame, keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    """(factor, direction, ic_mean): buy the top when the mean IC is not negative, else (or without IC) the bottom.

    factors lists the factor names, so that one without any IC still gets a row.
    """
    means = ics.groupBy(*keys).agg(F.avg("rank_ic").alias("ic_mean"))
    return factors.select(*keys).distinct().join(means, list(keys), "left").select(
        *keys, F.when(F.col("ic_mean") >= 0, "top").otherwise("bottom").alias("direction"), "ic_mean"
    )


def fixed_direction(factors: DataFrame, direction: str) -> DataFrame:
    """The same direction (top, bottom or short) for every factor."""
    if direction not in ("top", "bottom", "short"):
        raise ValueError(f"direction must be top, bottom or short, got {direction!r}")
    return factors.select("factor").distinct().withColumn("direction", F.lit(direction))


def given_directions(factors: DataFrame, directions: dict[str, str | None]) -> DataFrame:
    """(factor, direction) from a mapping; every factor needs top or bottom."""
    wrong = sorted(f for f, d in directions.items() if d not in ("top", "bottom"))
    if wrong:
        raise ValueError(f"direction must be top or bottom for: {', '.join(wrong)}")
    chosen = F.lit(None).cast("string")
    for factor, direction in directions.items():
        chosen = F.when(F.col("factor") == factor, F.lit(direction)).otherwise(chosen)
    return factors.select("factor").distinct().withColumn("direction", chosen)
