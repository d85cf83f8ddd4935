"""Incremental ingest with Structured Streaming.

The reference re-ingests and recomputes on every upload; the streaming form of
that is a file stream over a landing folder whose micro-batches are validated
row by row and appended to the stored-sales table (``foreachBatch`` → one batch of
the log, committed once). A second
job keeps daily totals per store with an event-time watermark. Checkpoints and
outputs live under the cluster's shared checkpoint folder, so a restarted job
resumes exactly where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date, parse_sales
from ..schema import all_string
from ..sinks import log_table as lt


def read_upload_stream(spark: SparkSession, landing: str, columns: Sequence[str], max_files_per_trigger: int | None = None) -> DataFrame:
    """All-STRING CSV file stream (header per file); typing happens per row downstream."""
    r = spark.readStream.schema(all_string(columns)).option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(landing)


def typed_events(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("user_id").try_cast("bigint").alias("user_id"),
        F.trim("store_id").alias("store_id"),
        parse_date("date").alias("date"),
        parse_sales("sales").alias("sales"),
        F.col("event_id").try_cast("bigint").alias("event_id"),
    )


def upsert_batch(spark: SparkSession, table_path: str, name: str = "uploads"):
    """foreachBatch body: append the micro-batch to the stored table, once however often it is delivered."""

    def run(batch: DataFrame, batch_id: int) -> None:
        lt.append(spark, table_path, batch, order="event_id", stream=(name, batch_id))

    return run


def run_upload_ingest(spark: SparkSession, landing: str, table_path: str, checkpoint: str, columns: Sequence[str],
                      max_files_per_trigger: int | None = 1) -> None:
    """Process everything available in ``landing`` and stop (``availableNow``)."""
    stream = typed_events(read_upload_stream(spark, landing, columns, max_files_per_trigger))
    q = (
        stream.writeStream.foreachBatch(upsert_batch(spark, table_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def wall_clock_instant(ts_ntz: str):
    """The instant whose UTC wall clock equals a TIMESTAMP_NTZ value, independent of the session time zone
    (a plain cast would read the wall clock in the session zone and shift the day windows)."""
    c = F.col(ts_ntz)
    secs = F.unix_date(c.cast("date")).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    micros = secs * 1_000_000 + F.date_format(c, "SSSSSS").cast("long")
    return F.timestamp_micros(micros)


def daily_totals_stream(events: DataFrame, ts: str = "ts", key: str = "event_type", value: str = "value",
                        watermark: str = "1 hour") -> DataFrame:
    """Daily tumbling-window totals per key with an event-time watermark (append-safe)."""
    e = events.withColumn("__t", wall_clock_instant(ts)).withWatermark("__t", watermark)
    g = e.groupBy(F.window("__t", "1 day").alias("w"), F.col(key)).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("events"))
    day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
    return g.select(day.alias("day"), F.col(key), "total", "events")


def run_daily_totals(spark: SparkSession, source_dir: str, file_glob: str, out: str, checkpoint: str, schema: str,
                     watermark: str = "1 hour") -> None:
    src = spark.readStream.schema(schema).option("pathGlobFilter", file_glob).parquet(source_dir)
    q = (
        daily_totals_stream(src, watermark=watermark)
        .writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", out)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
