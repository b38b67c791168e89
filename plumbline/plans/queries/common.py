"""Helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.series import Series, build_series


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, /, **digits: int) -> DataFrame:
    """Round columns; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})


def as_text(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps as text, seconds precision."""
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


def daily_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("total"))


def daily_series(spark: SparkSession, folder: str) -> Series:
    return build_series(daily_orders(spark, folder), "o_orderdate", ["total"])


def monthly_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Totals per month; the month is kept as a timestamp without time zone."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").cast("timestamp_ntz").alias("month")
    return table(spark, folder, "orders").groupBy(month).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders"))


def monthly_series(spark: SparkSession, folder: str) -> Series:
    return build_series(monthly_orders(spark, folder), "month", ["total"])


def monthly_panel(spark: SparkSession, folder: str) -> DataFrame:
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").cast("timestamp_ntz").alias("month")
    return table(spark, folder, "orders").groupBy("o_orderpriority", month).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders"))


# SQL of the same tables. Every one gives (…, ts, y) and the position t.
DAILY = """daily AS (SELECT o_orderdate AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS t, count(*) OVER () AS n, avg(y) OVER () AS mean FROM daily)"""

MONTHLY = """monthly AS (SELECT date_trunc('month', o_orderdate) AS ts, sum(o_totalprice) AS y FROM orders GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS t, count(*) OVER () AS n, avg(y) OVER () AS mean FROM monthly)"""
