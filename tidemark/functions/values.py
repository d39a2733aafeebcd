"""Scalar helpers for vendor records: numbers, units and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names and their multiplier to shares.
UNIT_MULTIPLIER = {"share": 1, "shares": 1, "股": 1, "lot": 1000, "lots": 1000, "張": 1000}

# Fixed value: offset between the Republic-of-China calendar and the common era.
ROC_YEAR_OFFSET = 1911


def plain_number(text: Column) -> Column:
    """Text with thousands separators → double; blank or unreadable → null."""
    return F.trim(F.regexp_replace(text.cast("string"), ",", "")).try_cast("double")


def multiplier_of(unit: str) -> int:
    key = str(unit).strip().lower()
    if key not in UNIT_MULTIPLIER:
        raise ValueError(f"unknown volume unit: {unit!r} (known: {sorted(UNIT_MULTIPLIER)})")
    return UNIT_MULTIPLIER[key]


def to_shares(value: Column, unit: str) -> Column:
    """Any volume in ``unit`` → whole shares, half-even; missing or blank counts as zero.

    Text that is present but not a number is an error, as it is at the source.
    """
    text = F.trim(F.regexp_replace(value.cast("string"), ",", ""))
    number = F.when(F.coalesce(text, F.lit("")) == "", F.lit(0.0)).otherwise(text.cast("double"))
    return F.bround(number * multiplier_of(unit)).cast("long")


def to_lots(shares: Column) -> Column:
    return F.coalesce(plain_number(shares), F.lit(0.0)) / F.lit(1000.0)


def roc_compact_date(text: Column) -> Column:
    """``1150924`` → 2026-09-24; null when the text is not seven digits, error on a date that does not exist."""
    return F.when(
        text.rlike(r"^\d{7}$"),
        F.make_date(
            F.substring(text, 1, 3).cast("int") + ROC_YEAR_OFFSET,
            F.substring(text, 4, 2).cast("int"),
            F.substring(text, 6, 2).cast("int"),
        ),
    )


def roc_slash_date(text: Column) -> Column:
    """``112/08/28`` → 2023-08-28, spaces ignored."""
    parts = F.split(F.regexp_replace(text, " ", ""), "/")
    return F.make_date(parts[0].cast("int") + ROC_YEAR_OFFSET, parts[1].cast("int"), parts[2].cast("int"))
