"""Sinks: CSV / JSON files and the multi-tenant stored-sales table as plain partitioned Parquet.

``log_table`` keeps the same rows as a log of batches, which is what uploads, replacements and streams write to. The plain
table is Parquet partitioned by a hashed tenant bucket
(``tenant_bucket = pmod(xxhash64(user_id), TENANT_BUCKETS)``) and the sale's month:
a tenant filter prunes to one bucket and a date filter to its months, and an upload
of a few days rewrites only the (bucket, month) directories it touches, however
large the table has grown. Upserts are one aggregate (``max_by`` over a (batch,
order) struct: last write wins, combined map-side so a hot key is collapsed before
the shuffle) followed by a *dynamic* partition overwrite of those directories.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import season, weekday0
from ..functions.dates import parse_date
from ..session import ensure_checkpoint_dir

TENANT = "user_id"
BUCKET = "tenant_bucket"
MONTH = "sale_month"
PARTITION = (BUCKET, MONTH)
TENANT_BUCKETS = 64
STORED_KEY = ("user_id", "store_id", "date")
STORED_COLUMNS = ["user_id", "store_id", "date", "sales", "year", "month", "week", "quarter", "season", "day_of_week", "day_of_year"]


def tenant_bucket(tenant_col=TENANT, buckets: int = TENANT_BUCKETS):
    c = F.col(tenant_col) if isinstance(tenant_col, str) else tenant_col
    return F.pmod(F.xxhash64(c.cast("bigint")), F.lit(buckets)).cast("int")


def partition_columns() -> dict:
    """Partition key of a stored row."""
    return {BUCKET: tenant_bucket(), MONTH: F.date_format("date", "yyyy-MM")}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory (never a node-local temp dir)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """snk_csv: header CSV (dates ISO, doubles as shortest text)."""
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """snk_json: JSON lines."""
    df.write.mode(mode).json(path)
    return path


def json_report(predictions: DataFrame, keys: Sequence[str], order: str = "date", value: str = "predicted_sales",
                extra: Sequence[str] = ()) -> DataFrame:
    """snk_json report body: per series metadata + summary + the nested prediction list
    (one document per series; the list is bounded by the forecast horizon)."""
    keys = list(keys)
    g = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_predictions"),
        F.min(order).alias("start"),
        F.max(order).alias("end"),
        F.avg(value).alias("average"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
        F.sort_array(F.collect_list(F.struct(F.col(order), F.col(value), *[F.col(c) for c in extra]))).alias("predictions"),
    )
    doc = F.struct(
        F.struct(*[F.col(k) for k in keys], F.col("start"), F.col("end")).alias("metadata"),
        F.struct("total_predictions", "average", "max", "min").alias("summary"),
        F.col("predictions"),
    )
    return g.select(*keys, F.to_json(doc).alias("report_json"))


def typed_date(df: DataFrame, date: str = "date"):
    """The date column as DATE; texts are parsed row by row, in every layout of the intake."""
    return parse_date(F.col(date)) if dict(df.dtypes)[date] == "string" else F.col(date).cast("date")


def key_types(df: DataFrame):
    """Whether a row's key types, so that it can be stored."""
    return F.col(TENANT).try_cast("bigint").isNotNull() & F.col("store_id").isNotNull() & typed_date(df).isNotNull()


def stored_shape(df: DataFrame, date: str = "date") -> DataFrame:
    """The stored-sales row: key, sales and the calendar parts kept with it. What does not type is NULL."""
    df = df.withColumn(date, typed_date(df, date))
    d = F.col(date)
    return df.select(
        F.col(TENANT).try_cast("bigint").alias(TENANT), F.col("store_id").cast("string").alias("store_id"), d.alias("date"),
        F.col("sales").try_cast("double").alias("sales"),
        F.year(d).alias("year"), F.month(d).alias("month"), F.weekofyear(d).alias("week"), F.quarter(d).alias("quarter"),
        season(F.month(d)).alias("season"), weekday0(d).alias("day_of_week"), F.dayofyear(d).alias("day_of_year"),
        *[F.col(c) for c in ("__batch", "__order") if c in df.columns],
    )


def merge_last_wins(existing: DataFrame | None, batches: Sequence[DataFrame], key: Sequence[str] = STORED_KEY,
                    *, order: str) -> DataFrame:
    """Union existing rows (batch 0) and new batches (1..n); keep the last version of every key.

    ``order`` ranks the rows of one batch (the largest value wins), like row order in an upload; rows
    that tie in it too are ranked by their content, so the result never depends on the plan.
    """
    parts = []
    if existing is not None:
        parts.append(existing.withColumns({"__batch": F.lit(0), "__order": F.lit(None).cast("long")}))
    for i, b in enumerate(batches, start=1):
        parts.append(b.withColumns({"__batch": F.lit(i), "__order": F.col(order).cast("long")}))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p, allowMissingColumns=True)
    rest = [c for c in u.columns if c not in key and not c.startswith("__")]
    g = u.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct("__batch", "__order", *rest)).alias("__row"))
    return g.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def upsert(spark: SparkSession, path: str | None, batches: Sequence[DataFrame], *, order: str) -> DataFrame:
    """snk_upsert: insert-or-replace on (user_id, store_id, date), written with dynamic partition overwrite.

    Rows whose key does not type are not stored; ``upsert_report`` counts them.
    Writing the result back over the table it read is safe: dynamic overwrite writes into a
    staging folder and swaps the touched directories only at job commit, after every
    task (including retries after an executor loss) has read the old files. A table that is
    there but cannot be read fails the upsert: nothing is merged with nothing.
    """
    typed = [stored_shape(b.withColumn("__order", F.col(order))).where(
        F.col(TENANT).isNotNull() & F.col("store_id").isNotNull() & F.col("date").isNotNull()) for b in batches]
    existing = _read_existing(spark, path)
    touched = None
    if existing is not None:
        # every row of every touched directory is rewritten: read exactly those (partition pruning)
        parts = None
        for t in typed:
            ids = t.select(*[c.alias(n) for n, c in partition_columns().items()]).distinct()
            parts = ids if parts is None else parts.union(ids)
        touched = existing.join(parts.distinct(), list(PARTITION), "left_semi").select(*STORED_COLUMNS)
    merged = merge_last_wins(touched, typed, order="__order")
    return stored_shape(merged).drop("__batch", "__order")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there, asked of its file system; errors of the file system are raised."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath))


def _read_existing(spark: SparkSession, path: str | None) -> DataFrame | None:
    return spark.read.parquet(path) if path is not None and exists(spark, path) else None


def write_stored(merged: DataFrame, path: str) -> str:
    """Dynamic partition overwrite: only the directories present in ``merged`` are replaced.

    ``rebalance`` on the partition key groups each directory's rows into few files while
    AQE splits a hot one (a tenant holding a third of all rows) across tasks
    instead of funnelling it through one.
    """
    out = merged.select(*STORED_COLUMNS).withColumns(partition_columns())
    (out.hint("rebalance", *PARTITION).sortWithinPartitions(*PARTITION, TENANT, "store_id", "date")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(path))
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert_report(batches: Sequence[DataFrame]) -> DataFrame:
    """Counts stored / failed in one aggregate: a row fails when its key does not type."""
    u = batches[0]
    for b in batches[1:]:
        u = u.unionByName(b, allowMissingColumns=True)
    ok = key_types(u)
    return u.agg(F.count_if(ok).alias("stored"), F.count_if(~ok).alias("failed"))
