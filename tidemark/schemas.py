"""Typed registry of the stored tables and the column contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_STRING, _DOUBLE, _LONG = T.StringType(), T.DoubleType(), T.LongType()
_DATE, _LOCAL_TIME = T.DateType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns.items()])


def _bar_schema(time_type: T.DataType) -> T.StructType:
    return _schema(
        symbol=_STRING, market=_STRING, date=time_type,
        open=_DOUBLE, high=_DOUBLE, low=_DOUBLE, close=_DOUBLE,
        volume_shares=_LONG, turnover_twd=_DOUBLE, trade_count=_LONG, source=_STRING,
    )


# Table and column names of the stored layout.
TABLES: dict[str, T.StructType] = {
    "daily": _bar_schema(_DATE),
    "hourly": _bar_schema(_LOCAL_TIME),
    "minute": _schema(
        symbol=_STRING, timestamp=_LOCAL_TIME, open=_DOUBLE, high=_DOUBLE, low=_DOUBLE, close=_DOUBLE,
        volume_shares=_LONG, turnover_twd=_DOUBLE, source=_STRING,
    ),
    "tick": _schema(
        symbol=_STRING, timestamp=_LOCAL_TIME, price=_DOUBLE, size_shares=_LONG, tick_type=_STRING,
        bid=_DOUBLE, ask=_DOUBLE, source=_STRING,
    ),
    "instrument": _schema(
        symbol=_STRING, name=_STRING, market=_STRING, industry=_STRING,
        list_date=_DATE, delist_date=_DATE, status=_STRING, snapshot_date=_DATE,
    ),
    "institutional": _schema(
        symbol=_STRING, date=_DATE, foreign_buy=_DOUBLE, foreign_sell=_DOUBLE,
        investment_trust_buy=_DOUBLE, investment_trust_sell=_DOUBLE,
        dealer_buy=_DOUBLE, dealer_sell=_DOUBLE, source=_STRING,
    ),
    "margin": _schema(
        symbol=_STRING, date=_DATE, margin_balance=_DOUBLE, margin_buy=_DOUBLE, margin_sell=_DOUBLE,
        short_balance=_DOUBLE, short_sell=_DOUBLE, short_cover=_DOUBLE, source=_STRING,
    ),
}


def schema_of(table: str) -> T.StructType:
    if table not in TABLES:
        raise KeyError(f"unknown table: {table}")
    return TABLES[table]


def columns_of(table: str) -> list[str]:
    return schema_of(table).fieldNames()


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], schema_of(table))


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """Raise when a contract column is missing; extra columns pass."""
    missing = [name for name in columns_of(table) if name not in df.columns]
    if missing:
        raise ValueError(f"{table} is missing columns: {missing}")
    return df


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project onto the contract columns in order, with the contract types."""
    require_columns(df, table)
    return df.select(*[df[field.name].cast(field.dataType).alias(field.name) for field in schema_of(table)])
