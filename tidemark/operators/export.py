"""Dense export: one float vector per (symbol, field) aligned to the full calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.calendar import calendar, with_calendar_index
from tidemark.sources.store import latest_rows

# Stored column → exported field.
FIELD_NAMES = {
    "open": "open", "high": "high", "low": "low", "close": "close",
    "volume_shares": "volume", "turnover_twd": "turnover",
}


def dense_vectors(daily: DataFrame) -> DataFrame:
    """(symbol, field, start_index, first_date, last_date, vector).

    ``vector`` has one 32-bit float per calendar day, NaN where the symbol has no row.
    Each row brings the run of missing days before it (the last one also those after
    it), so a vector is put together in one pass over its symbol's rows and no
    calendar × symbol product is built. A vector is as long as the calendar: symbols that
    differ in case are one, and of several rows of a day the one with the largest values counts
    (open first, then high, and so on).
    """
    upper = daily.withColumn("symbol", F.upper("symbol"))
    rows = latest_rows([upper], ["symbol", "date"], F.struct(*[F.col(c) for c in upper.columns if c in FIELD_NAMES]))
    cal = calendar(daily)
    n_days = cal.agg(F.max("di")).scalar()
    by_day = Window.partitionBy("symbol").orderBy("di")
    padded = with_calendar_index(rows, cal).withColumns({
        "_before": (F.col("di") - F.coalesce(F.lag("di").over(by_day), F.lit(0)) - 1).cast("int"),
        "_after": F.when(F.lead("di").over(by_day).isNull(), n_days - F.col("di")).otherwise(F.lit(0)).cast("int"),
    })
    values = [F.col(name).cast("float").alias(out) for name, out in FIELD_NAMES.items()]
    by_symbol = padded.groupBy("symbol").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.array_sort(F.collect_list(F.struct("di", "_before", "_after", *values))).alias("_rows"),
    )
    missing = F.lit(float("nan")).cast("float")

    def vector(field: str) -> Column:
        pieces = F.transform("_rows", lambda r: F.concat(
            F.array_repeat(missing, r["_before"]), F.array(F.coalesce(r[field], missing)),
            F.array_repeat(missing, r["_after"]),
        ))
        return F.struct(F.lit(field).alias("field"), F.flatten(pieces).alias("vector"))

    return by_symbol.select(
        "symbol", F.lit(0).alias("start_index"), "first_date", "last_date",
        F.inline(F.array(*[vector(out) for out in FIELD_NAMES.values()])),
    ).select("symbol", "field", "start_index", "first_date", "last_date", "vector")
