"""Pages by key over a sorted copy of a table: a page reads the files that hold it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIRST = Window.unboundedPreceding


class SortedPages:
    """Rows ordered by (date descending, symbol), in one folder per range, with a zone index: a row per range with its row count, keys and place.

    (date, symbol) is unique. The index is small (a row per range of the shuffle) and is all that finding a page reads; rows outside a page's
    ranges are not touched, however far back the page is. The copy does not change: build a new one for a new state of the table.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T.StructType.fromJson(json.loads(spark.read.text(f"{self.root}/schema", wholetext=True).first().value))

    @classmethod
    def build(cls, bars: DataFrame, root: str, ranges: int | None = None) -> SortedPages:
        """Write the sorted copy and its index. ``ranges``: how many files to aim at (default: Spark's shuffle partitions)."""
        order = [F.col("date").desc(), F.col("symbol")]
        placed = bars.repartitionByRange(ranges, *order) if ranges else bars.repartitionByRange(*order)
        placed = placed.withColumn("range", F.spark_partition_id()).sortWithinPartitions("range", *order)
        folder = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        placed.write.partitionBy("range").parquet(f"{folder}/rows")
        bars.sparkSession.createDataFrame([(json.dumps(placed.schema.jsonValue()),)], "value string").coalesce(1).write.text(f"{folder}/schema")
        rows = bars.sparkSession.read.schema(placed.schema).parquet(f"{folder}/rows")
        zones = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("from_date"), F.min("date").alias("to_date"),
                                          F.max_by("symbol", F.struct(-F.unix_date("date"), "symbol")).alias("last_symbol"))
        before = Window.orderBy("range").rowsBetween(FIRST, -1)  # a row per range
        zones.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1).write.parquet(f"{folder}/zones")
        return cls(bars.sparkSession, folder)

    @property
    def zones(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/zones")

    def total(self) -> int:
        return self.zones.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _rows(self, ranges: list[int]) -> DataFrame:
        """The rows of these ranges; other folders are not even listed."""
        if not ranges:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.root}/rows")
        return reader.parquet(*[f"{self.root}/rows/range={r}" for r in ranges])

    @staticmethod
    def _limit(limit: int) -> None:
        if not 1 <= limit <= 500:
            raise ValueError("limit must be 1..500")

    def at(self, limit: int, offset: int = 0) -> DataFrame:
        """The page that starts after ``offset`` rows: the offset is looked up in the index."""
        self._limit(limit)
        if offset < 0:
            raise ValueError("offset must not be negative")
        zones = self.zones.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).select("range", "before").collect()
        skip = offset - min((z.before for z in zones), default=0)
        return self._page(self._rows([z.range for z in zones]), limit, skip)

    def after(self, token: tuple | None, limit: int) -> DataFrame:
        """The page behind the row with the key ``token`` (date, symbol); None is the first page. The key need not exist (any more)."""
        self._limit(limit)
        if token is None:
            return self.at(limit)
        date, symbol = F.lit(token[0]).cast("date"), F.lit(token[1])
        behind = self._behind(F.col("to_date"), F.col("last_symbol"), date, symbol)
        zones = self.zones.where(behind).select("range", "n").orderBy("range").limit(limit + 1).collect()
        chosen, held = [], 0
        for k, z in enumerate(zones):  # the first range may hold rows up to the key, the others count in full
            chosen.append(z.range)
            held += z.n if k else 0
            if held >= limit:
                break
        return self._page(self._rows(chosen).where(self._behind(F.col("date"), F.col("symbol"), date, symbol)), limit, 0)

    @staticmethod
    def _behind(own_date: Column, own_symbol: Column, date: Column, symbol: Column) -> Column:
        return (own_date < date) | ((own_date == date) & (own_symbol > symbol))

    def _page(self, rows: DataFrame, limit: int, skip: int) -> DataFrame:
        return rows.drop("range").orderBy(F.col("date").desc(), "symbol").offset(skip).limit(limit)
