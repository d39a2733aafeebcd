"""Layered Parquet store: raw, normalized (by year), reference tables and features.

Layout: ``raw/<provider>/<dataset>``, ``normalized/<table>/year=YYYY`` for dated
tables, ``normalized/<table>`` for undated ones, ``features/<name>``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ranks import best_rows
from tidemark.operators.quality import contract_errors
from tidemark.schemas import TABLES, columns_of, empty, schema_of


def scan(df: DataFrame, symbols: list[str] | DataFrame | None = None, start=None, end=None,
         date: str = "date", symbol: str = "symbol") -> DataFrame:
    """Rows of the given symbols with start <= date <= end; all conditions reach the file scan.

    A symbol table instead of a list becomes a semi-join.
    """
    rows = df
    if start is not None:
        rows = rows.where(F.col(date) >= F.lit(start))
        if "year" in df.columns:
            rows = rows.where(F.col("year") >= F.year(F.lit(start).cast("date")))
    if end is not None:
        rows = rows.where(F.col(date) <= F.lit(end))
        if "year" in df.columns:
            rows = rows.where(F.col("year") <= F.year(F.lit(end).cast("date")))
    if isinstance(symbols, DataFrame):
        rows = rows.join(symbols.select(symbol), symbol, "left_semi")
    elif symbols:
        rows = rows.where(F.col(symbol).isin(list(symbols)))
    return rows


def latest_rows(parts: list[DataFrame], key: list[str], order: Column | None = None) -> DataFrame:
    """One row per key; later parts win, and inside a part the largest ``order``.

    Spark keeps one row per key and map task before the shuffle, so a key that is
    delivered over and over does not pile up in one task.
    """
    columns = parts[0].columns
    marked = [p.select(*columns).withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = marked[0]
    for part in marked[1:]:
        union = union.unionByName(part)
    ranking = [F.col("_part").desc()] + ([order.desc_nulls_last()] if order is not None else [])
    return best_rows(union, key, ranking, 1, "_first").select(*columns)


class PanelStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, str(root).rstrip("/")

    # -- paths ------------------------------------------------------------

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _files(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._files(path).exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def _replace(self, df: DataFrame, path: str) -> None:
        """Write beside the target, then swap. The old table goes only when the new one stands in its place.

        A swap that fails puts the old table back and raises; between the two renames a reader finds no table.
        """
        staged, retired = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.retired-{uuid.uuid4().hex}"
        df.write.parquet(staged)
        make_path = self.spark._jvm.org.apache.hadoop.fs.Path
        files = self._files(path)
        had = files.exists(make_path(path))
        if had and not files.rename(make_path(path), make_path(retired)):
            files.delete(make_path(staged), True)
            raise OSError(f"cannot move {path} aside")
        if not files.rename(make_path(staged), make_path(path)):
            if had and not files.rename(make_path(retired), make_path(path)):
                raise OSError(f"cannot publish {staged}; the table before is {retired}")
            raise OSError(f"cannot publish {staged} as {path}")
        if had:
            files.delete(make_path(retired), True)

    # -- raw --------------------------------------------------------------

    def write_raw(self, provider: str, dataset: str, df: DataFrame) -> str:
        path = self._path("raw", provider, dataset)
        old = self.read_raw(provider, dataset)
        parts = [df] if old is None else [old, df]
        if "date" in df.columns:
            merged = latest_rows(parts, ["symbol", "date"])
        else:
            merged = parts[0] if old is None else old.unionByName(df)
        self._replace(merged, path)
        return path

    def read_raw(self, provider: str, dataset: str) -> DataFrame | None:
        path = self._path("raw", provider, dataset)
        return self.spark.read.parquet(path) if self._exists(path) else None

    # -- normalized -------------------------------------------------------

    def read(self, table: str, symbols=None, start=None, end=None) -> DataFrame:
        """A stored table with the contract columns; typed and empty when nothing is stored."""
        path = self._path("normalized", table)
        if not self._exists(path):
            return empty(self.spark, table) if table in TABLES else self.spark.createDataFrame([], "symbol string")
        reader = self.spark.read
        if table in TABLES:
            schema = schema_of(table)
            if "date" in schema.fieldNames():
                schema = T.StructType([*schema.fields, T.StructField("year", T.IntegerType())])
            reader = reader.schema(schema)
        return scan(reader.parquet(path), symbols, start, end).drop("year")

    def write(self, table: str, df: DataFrame, order: Column | None = None) -> None:
        """Upsert by (symbol, date); incoming rows win. Only the incoming years are rewritten.

        ``order`` decides between several incoming rows of one key. The number of years
        is small, so the list of touched years goes through the driver.
        """
        if "date" not in df.columns:
            raise ValueError(f"{table} has no date column")
        incoming = df.withColumn("year", F.year("date"))
        years = [r.year for r in incoming.select("year").distinct().collect()]
        if not years:
            return
        path = self._path("normalized", table)
        parts = [incoming]
        if self._exists(path):
            stored = self.spark.read.schema(incoming.schema).parquet(path)
            parts = [stored.where(F.col("year").isin(years)), incoming]
        merged = latest_rows(parts, ["symbol", "date"], order)
        # AQE splits large years and merges small ones, so file sizes do not depend on the task count.
        balanced = merged.hint("rebalance", F.col("year"))
        balanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "compression", "zstd"
        ).partitionBy("year").parquet(path)

    def write_reference(self, table: str, df: DataFrame, key: list[str], order: Column | None = None) -> None:
        """Upsert an undated table by ``key``; the whole table is replaced in one step."""
        path = self._path("normalized", table)
        parts = [df]
        if self._exists(path):
            parts = [self.spark.read.schema(df.schema).parquet(path), df]
        if df.isEmpty():
            return
        self._replace(latest_rows(parts, key, order), path)

    def import_snapshot(self, df: DataFrame, table: str = "daily") -> int:
        """All or nothing: every row must meet the bar contract, then one upsert. Returns the row count."""
        checked = contract_errors(df, columns_of(table))
        found = checked.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") > 0).alias("bad")).first()
        if found["bad"]:
            raise ValueError(f"import rejected: {found['bad']} rows break the bar contract")
        self.write(table, df)
        return found["rows"]

    # -- features ---------------------------------------------------------

    def write_feature(self, name: str, df: DataFrame) -> None:
        self._replace(df, self._path("features", name))

    def read_feature(self, name: str) -> DataFrame | None:
        path = self._path("features", name)
        return self.spark.read.parquet(path) if self._exists(path) else None

    # -- SQL --------------------------------------------------------------

    def register_views(self, tables: tuple[str, ...] = tuple(TABLES)) -> None:
        for table in tables:
            self.read(table).createOrReplaceTempView(table)

    def query(self, sql: str, args: dict | list | None = None) -> DataFrame:
        return self.spark.sql(sql, args=args) if args else self.spark.sql(sql)

    def table_exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(table)

    def query_parquet(self, path: str, sql: str) -> DataFrame:
        """SQL over files: ``<TABLE>`` stands for the path or glob."""
        return self.spark.sql(sql.replace("<TABLE>", f"parquet.`{path}`"))
