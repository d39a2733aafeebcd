"""Trading calendar and the helpers that put a panel on the calendar axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame, date: str = "date") -> DataFrame:
    """Distinct dates numbered from 1: (date, di).

    At most one row per day of the covered span, so the single unpartitioned
    window runs over thousands of rows whatever the size of the panel.
    """
    dates = panel.select(F.col(date).alias("date")).where(F.col("date").isNotNull()).distinct()
    return dates.select("date", F.row_number().over(Window.orderBy("date")).cast("long").alias("di"))


def with_calendar_index(panel: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """Add ``di``. The calendar is day-bounded (366 rows a year), hence the broadcast."""
    cal = calendar(panel) if cal is None else cal
    return panel.join(F.broadcast(cal), "date")
