"""Queries for the streaming ingest path: each runs a stream to completion (availableNow) into
the shared folder and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import log_table as lt
from ..sinks import tables as sk
from ..sources.testdata import TENANT_CTE, tenant_fact
from ..streaming import ingest
from .q_io import PARTS_SQL
from .registry import register, rnd, with_ctes

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@register(
    "stream_daily_sales",
    """SELECT day, event_type, round(sum(value), 2) AS total, count(*) AS events
FROM (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, value FROM events)
WHERE CAST(day + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
)
def q_stream_daily_sales(spark, sf):
    base = sk.shared_path(spark, "daily-stream")
    ingest.run_daily_totals(spark, sf, "events.parquet", base + "/out", base + "/_checkpoint", EVENT_SCHEMA)
    out = spark.read.parquet(base + "/out")
    return rnd(out.select("day", "event_type", "total", "events"))


@register(
    "stream_upsert",
    with_ctes(TENANT_CTE)
    + f""", l AS (SELECT user_id, store_id, date, sales FROM tfact QUALIFY row_number() OVER (PARTITION BY user_id, store_id, date ORDER BY event_id DESC) = 1)
SELECT user_id, store_id, date, sales, {PARTS_SQL} FROM l""",
)
def q_stream_upsert(spark, sf):
    base = sk.shared_path(spark, "upload-stream")
    landing, table = base + "/landing", base + "/table"
    t = tenant_fact(spark, sf).select(
        F.col("user_id").cast("string").alias("user_id"), "store_id", F.col("date").cast("string").alias("date"),
        F.col("sales").cast("string").alias("sales"), F.col("event_id").cast("string").alias("event_id"),
    )
    # one file per group of tenants: every key lives in exactly one file, so file order cannot change a result
    t.repartition(4, "user_id").write.option("header", True).csv(landing)
    ingest.run_upload_ingest(spark, landing, table, base + "/_checkpoint", ["user_id", "store_id", "date", "sales", "event_id"])
    return lt.read(spark, table).drop(*sk.PARTITION)
