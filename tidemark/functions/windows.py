"""Per-instrument window helpers.

Every window here is partitioned by instrument. Rows are unique per
(instrument, date), so one window group never holds more rows than there are
dates in the calendar, however many instruments the panel has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null instead of an error or infinity on a zero base."""
    return F.try_divide(numerator, denominator)


def history(*group: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*group).orderBy(order)


def trailing(window: WindowSpec, rows: int) -> WindowSpec:
    return window.rowsBetween(-(rows - 1), 0)


def change(value: Column, window: WindowSpec, rows: int = 1) -> Column:
    """Relative change against the row ``rows`` places earlier (compressed axis)."""
    return ratio(value, F.lag(value, rows).over(window)) - 1


def full_mean(value: Column, window: WindowSpec, rows: int) -> Column:
    frame = trailing(window, rows)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def full_stddev(value: Column, window: WindowSpec, rows: int) -> Column:
    frame = trailing(window, rows)
    return F.when(F.count(value).over(frame) == rows, F.stddev_samp(value).over(frame))


def full_sum(value: Column, window: WindowSpec, rows: int) -> Column:
    frame = trailing(window, rows)
    return F.when(F.count(value).over(frame) == rows, F.sum(value).over(frame))


def at_calendar_offset(value: Column, offset: int, *group: str, index: str = "di") -> Column:
    """The value ``offset`` calendar rows away, or null when that row is missing.

    A range frame that covers exactly one index value replaces the self-join on
    ``index + offset``: one shuffle by group and no densified table.
    """
    frame = Window.partitionBy(*group).orderBy(index).rangeBetween(offset, offset)
    return F.first(value).over(frame)


def wilder_mean(df: DataFrame, inputs: dict[str, str], n: int, group: str = "symbol", order: str = "date",
                block_rows: int | None = None) -> DataFrame:
    """Add recursive exponential means (alpha = 1/n, seeded by the first value that is set).

    ``inputs`` maps output name to input column; all inputs are null on the same rows.
    Those rows take no step: they show the mean before them (null before the first). The recursion ``y = (1-a)·y' + a·x`` is a
    weighted running sum, so it needs neither a per-group fold nor Python. Weights
    restart in blocks to stay inside double range; a block starts from the mean at
    the end of the block before, older blocks having decayed below the smallest
    double.
    """
    decay = 1.0 - 1.0 / n
    if decay <= 0.0:
        return df.select("*", *[F.col(source).alias(out) for out, source in inputs.items()])
    rows = block_rows or max(2, int(575 / -math.log(decay)))
    series = history(group, order=order)
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    step = df.withColumn("_step", F.count(next(iter(inputs.values()))).over(so_far) - 1)
    step = step.withColumn("_block", F.floor(F.col("_step") / rows)).withColumn(
        "_pos", F.col("_step") - F.col("_block") * rows
    )
    in_block = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(F.col("_step") == 0, F.lit(1.0)).otherwise(F.lit(1.0 / n)) * F.pow(F.lit(decay), -F.col("_pos"))
    step = step.withColumns({
        f"_own_{out}": F.sum(F.col(source) * weight).over(in_block) * F.pow(F.lit(decay), F.col("_pos"))
        for out, source in inputs.items()
    })
    block_before = Window.partitionBy(group).orderBy("_block").rangeBetween(-1, -1)
    carried = {
        out: F.col(f"_own_{out}")
        + F.coalesce(F.max_by(f"_own_{out}", "_step").over(block_before), F.lit(0.0))
        * F.pow(F.lit(decay), F.col("_pos") + 1)
        for out in inputs
    }
    return step.withColumns(carried).drop("_step", "_block", "_pos", *[f"_own_{out}" for out in inputs])
