"""Batch changes to a keyed table: insert, replace, delete with a status per change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.carry import last_known_before

KEY = ["symbol", "date"]


def change_status(state: DataFrame, changes: DataFrame, key: list[str] = KEY, order: str = "seq") -> DataFrame:
    """Add ``status``: 201/409 for insert, 200/404 for replace, 204/404 for delete.

    Whether a key exists before a change depends only on the last insert or delete
    before it (either outcome of an insert leaves the key present, of a delete
    absent), else on the stored state. ``order`` is unique per key.
    """
    outcome = F.when(F.col("op") == "insert", True).when(F.col("op") == "delete", False)
    stored = state.select(*key).distinct().withColumn("_stored", F.lit(True))
    known = last_known_before(changes, key, order, outcome, "_known").join(stored, key, "left")
    exists = F.coalesce(F.col("_known"), F.col("_stored"), F.lit(False))
    status = (
        F.when(F.col("op") == "insert", F.when(exists, 409).otherwise(201))
        .when(F.col("op") == "replace", F.when(exists, 200).otherwise(404))
        .when(F.col("op") == "delete", F.when(exists, 204).otherwise(404))
    )
    return known.withColumn("status", status).drop("_known", "_stored")


def apply_changes(state: DataFrame, changes: DataFrame, key: list[str] = KEY, order: str = "seq") -> DataFrame:
    """The table after all changes.

    Per key, two map-side combined aggregates decide: the last insert/delete tells
    whether the key remains, the last accepted insert/replace gives its values.
    """
    values = [c for c in state.columns if c not in key]
    checked = change_status(state, changes, key, order)
    accepted = (F.col("status") < 400) & F.col("op").isin("insert", "replace")
    written = F.when(accepted, F.col(order))
    settled = F.when(F.col("op") != "replace", F.col(order))
    last = checked.groupBy(*key).agg(
        F.max_by(F.struct(*values), written).alias("_new"),
        F.max(written).alias("_written"),
        F.max_by(F.col("op") == "insert", settled).alias("_remains"),
    )
    joined = state.withColumn("_old", F.struct(*values)).select(*key, "_old").join(last, key, "full_outer")
    remains = F.coalesce(F.col("_remains"), F.col("_old").isNotNull())
    row = F.when(F.col("_written").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return joined.where(remains).withColumn("_row", row).select(*key, "_row.*")


def page(bars: DataFrame, limit: int = 100, offset: int = 0, symbol: str | None = None,
         start=None, end=None) -> DataFrame:
    """One page, newest date first, with the total number of matching rows on every row."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset not negative")
    if start is not None and end is not None and start > end:
        raise ValueError("start must not be after end")
    rows = bars
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("date") <= F.lit(end))
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(F.col("date").desc(), "symbol").offset(offset).limit(limit).withColumn("total", total)


def find(bars: DataFrame, symbol: str, day) -> DataFrame:
    """Point read by key."""
    return bars.where((F.col("symbol") == symbol) & (F.col("date") == F.lit(day)))
