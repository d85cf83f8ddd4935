"""Reads of the multi-tenant stored-sales table (Parquet partitioned by a hashed tenant bucket and month).

Tenant, store and date filters are plain predicates: the tenant's bucket and the
dates' months (ISO dates) prune partitions, the others are pushed into the Parquet scan (row-group statistics).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TENANT = "user_id"


def tenant_scan(table: DataFrame, user_id, store_id=None, start_date=None, end_date=None) -> DataFrame:
    """src_tenant_scan: one tenant's rows with optional store / date-range filters, ordered by store, date."""
    from ..sinks.tables import BUCKET, MONTH, tenant_bucket

    cond = (F.col(TENANT) == F.lit(user_id)) & (F.col(BUCKET) == tenant_bucket(F.lit(user_id)))
    if store_id is not None:
        cond &= F.col("store_id") == F.lit(str(store_id))
    if start_date is not None:
        cond &= (F.col("date") >= F.to_date(F.lit(start_date))) & (F.col(MONTH) >= str(start_date)[:7])
    if end_date is not None:
        cond &= (F.col("date") <= F.to_date(F.lit(end_date))) & (F.col(MONTH) <= str(end_date)[:7])
    return table.where(cond).drop(BUCKET, MONTH).orderBy("store_id", "date")


def read_stored(spark: SparkSession, path: str, with_bucket: bool = False) -> DataFrame:
    t = spark.read.parquet(path)
    return t if with_bucket else t.drop("tenant_bucket", "sale_month")


def export_tenant(table: DataFrame, user_id, path: str) -> str | None:
    """src_export_tenant: all rows of one tenant to CSV; ``None`` when the tenant has no rows."""
    rows = tenant_scan(table, user_id).drop(TENANT)  # the file is the tenant's own: no tenant column
    if rows.limit(1).count() == 0:
        return None
    rows.write.mode("overwrite").option("header", True).csv(path)
    return path
