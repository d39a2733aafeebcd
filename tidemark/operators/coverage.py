"""Which days a symbol has, as bitmaps: kept per delivery, merged without reading rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = 40_000  # days that are added to a date's number, so that dates from 1860 on are positive


def _number(date: Column) -> Column:
    return F.unix_date(date.cast("date")).cast("long") + EPOCH


def coverage(rows: DataFrame, key: list[str], date: str = "date") -> DataFrame:
    """(key…, bucket, days, first, last): a bitmap of the days that the rows of a key have, one row per 32,768 days.

    Combined map-side to 4 KB a key and task, whatever the number of rows. Null dates are no days.
    """
    n = _number(F.col(date))
    return rows.where(F.col(date).isNotNull()).groupBy(*key, F.bitmap_bucket_number(n).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("days"), F.min(F.col(date).cast("date")).alias("first"), F.max(F.col(date).cast("date")).alias("last"))


def merged_coverage(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The coverage of all deliveries together."""
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(*key, "bucket").agg(F.bitmap_or_agg("days").alias("days"), F.min("first").alias("first"), F.max("last").alias("last"))


def _has(days: Column, place: Column) -> Column:
    """Whether the bit at ``place`` is set."""
    byte = F.conv(F.hex(F.substring(days, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (place % 8).cast("int")) == 1


def missing_days(covered: DataFrame, key: list[str], cal: DataFrame) -> DataFrame:
    """(key…, date): days of the calendar between the first and the last day of a key that it does not have.

    Reads the bitmaps only. ``cal`` (date) is bounded by time and goes to all tasks, a list per bucket.
    """
    days = cal.select("date", _number(F.col("date")).alias("n")).groupBy(F.bitmap_bucket_number("n").alias("bucket")).agg(
        F.collect_list(F.struct("date", F.bitmap_bit_position("n").alias("place"))).alias("calendar"))
    spans = covered.groupBy(*key).agg(F.min("first").alias("_first"), F.max("last").alias("_last"))
    # a key may have no bitmap for a bucket between its first and its last one
    wanted = spans.withColumn("bucket", F.explode(F.sequence(F.bitmap_bucket_number(_number(F.col("_first"))), F.bitmap_bucket_number(_number(F.col("_last"))))))
    held = wanted.join(covered.select(*key, "bucket", "days"), [*key, "bucket"], "left").join(F.broadcast(days), "bucket")
    lacks = F.filter("calendar", lambda d: d["date"].between(F.col("_first"), F.col("_last")) & ~F.coalesce(_has(F.col("days"), d["place"]), F.lit(False)))
    return held.select(*key, F.explode(lacks).alias("_day")).select(*key, "_day.date")


def covered_days(covered: DataFrame, key: list[str]) -> DataFrame:
    """(key…, n_days): how many different days a key has."""
    return covered.groupBy(*key).agg(F.sum(F.bitmap_count("days")).alias("n_days"))


def covered_years(covered: DataFrame, key: list[str]) -> DataFrame:
    """(key…, year): the years in which a key has any day, for fetch plans."""
    years = F.sequence(F.year("first"), F.year("last"))
    number = lambda y, month, day: _number(F.make_date(y, F.lit(month), F.lit(day)))
    first_of_bucket = (F.col("bucket") - 1) * 32768 + 1
    places = lambda y: F.sequence(F.greatest(number(y, 1, 1), first_of_bucket), F.least(number(y, 12, 31), first_of_bucket + 32767))
    any_day = lambda y: F.exists(places(y), lambda n: _has(F.col("days"), n - first_of_bucket))
    return covered.select(*key, F.explode(F.filter(years, any_day)).alias("year")).distinct()
