"""List files: delisting text, delisted CSV, symbol lists, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.values import ROC_YEAR_OFFSET

# Fixed value: one line of the official delisting list.
DELISTED_LINE = r'"(?:民國)?(\d{2,3})年(\d{1,2})月(\d{1,2})日","(.*?)","([0-9A-Z]+)"'

DELISTED_SCHEMA = "symbol string, name string, delist_date date, source string"


def parse_delisted_text(texts: DataFrame, text: str = "text") -> DataFrame:
    """Texts (whole lists or single lines) → (symbol, name, delist_date); other lines are ignored."""
    lines = texts.select(F.explode(F.regexp_extract_all(text, F.lit(DELISTED_LINE), F.lit(0))).alias("_line"))

    def part(i: int) -> Column:
        return F.regexp_extract("_line", DELISTED_LINE, i)

    return lines.select(
        part(5).alias("symbol"), part(4).alias("name"),
        F.make_date(part(1).cast("int") + ROC_YEAR_OFFSET, part(2).cast("int"), part(3).cast("int")).alias("delist_date"),
    )


def read_delisted_text(spark: SparkSession, path: str, charset: str = "BIG5") -> DataFrame:
    """Official list files in their legacy charset. Each file is one list of a few hundred kilobytes.

    Spark decodes it only under a setting that counts when the plan is made; the session's own value is put back.
    """
    files = spark.read.format("binaryFile").load(path)
    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        return parse_delisted_text(files.select(F.decode("content", charset).alias("text")))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def read_delisted_csv(spark: SparkSession, path: str, start=None) -> DataFrame:
    """Delisted manifest; dates that do not parse are null. Keeps null dates and dates from ``start`` on."""
    raw = spark.read.schema("symbol string, name string, delist_date string, source string").csv(path, header=True)
    rows = raw.withColumn("delist_date", F.try_to_date("delist_date", "yyyy-MM-dd"))
    if start is None:
        return rows
    return rows.where(F.col("delist_date").isNull() | (F.col("delist_date") >= F.lit(start)))


def read_symbol_list(spark: SparkSession, path: str) -> DataFrame:
    """One symbol per line; blank lines and lines starting with # are skipped."""
    lines = spark.read.text(path)
    kept = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    return kept.select(F.trim("value").alias("symbol"))


def write_manifest(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Seen log, intervals or delisted list as CSV with header, or as Parquet."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
