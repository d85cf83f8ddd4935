"""Sales facts over the driver's parquet tables.

The sales fact view maps ``lineitem`` onto the canonical sales schema:
``store = l_suppkey`` (string key), ``date = l_shipdate`` (DATE),
``sales = l_extendedprice``, plus pass-through numeric extras. Only the
projected columns reach the parquet scan (``ReadSchema`` is pruned).

The same mappings are written as SQL CTEs (``FACT_CTE`` …) for the DuckDB
oracle, so both sides see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").cast("string").alias("store"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").alias("sales"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_partkey").alias("product"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
    )


# Deterministic null injection (identical arithmetic on both engines).
NULL_RULE = "(order_key * 7 + line_number) % 17 = 0"


def sales_fact_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact with every 17th-ish sales value blanked, to exercise the fill operators."""
    return sales_fact(spark, sf_dir).withColumn(
        "sales", F.when(F.expr(NULL_RULE), F.lit(None).cast("double")).otherwise(F.col("sales"))
    )


def tenant_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-tenant stored-sales shape from ``events``: tenant = user, store = event type."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("user_id"),
        F.col("event_type").alias("store_id"),
        F.col("ts").cast("date").alias("date"),
        F.col("value").alias("sales"),
        F.col("event_id").alias("event_id"),
    )


FACT_CTE = """fact AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS store, CAST(l_shipdate AS DATE) AS date,
         l_extendedprice AS sales, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
         l_partkey AS product, l_orderkey AS order_key, l_linenumber AS line_number
  FROM lineitem)"""

GAPS_CTE = """gaps AS (
  SELECT store, date, CASE WHEN (order_key * 7 + line_number) % 17 = 0 THEN NULL ELSE sales END AS sales,
         quantity, discount, tax, product, order_key, line_number
  FROM fact)"""

TENANT_CTE = """tfact AS (
  SELECT user_id, event_type AS store_id, CAST(ts AS DATE) AS date, value AS sales, event_id
  FROM events)"""

ENRICHED_CTE = """efact AS (
  SELECT *, year(date) AS year, month(date) AS month, week(date) AS week, isodow(date) - 1 AS day_of_week,
         quarter(date) AS quarter, dayofyear(date) AS day_of_year,
         CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4, 5) THEN 'Spring'
              WHEN month(date) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END AS season
  FROM fact)"""
