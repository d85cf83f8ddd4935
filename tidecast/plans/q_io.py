"""Queries for file intake (§2.1 sources) and sinks: every one writes to / reads from a fresh folder
under the shared checkpoint directory, then returns what was read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import log_table as lt
from ..sinks import tables as sk
from ..sources import intake, tenant
from ..sources.testdata import FACT_CTE, TENANT_CTE, sales_fact, table, tenant_fact
from .q_clean import RAW_CTE, TYPED_CTE, rendered_upload
from .registry import register, rnd, with_ctes

WR = with_ctes(FACT_CTE, RAW_CTE, TYPED_CTE)
VALID_SQL = WR + """SELECT store, date, sales, quantity, order_key, line FROM typed WHERE date IS NOT NULL AND sales IS NOT NULL"""


def clean_headers(df):
    return df.toDF(*[c.strip() for c in df.columns])


def upload_csv(spark, sf):
    return sk.write_csv(clean_headers(rendered_upload(spark, sf)), sk.shared_path(spark, "upload"))


@register(
    "src_csv",
    WR + """SELECT "Store_ID", "Date " AS "Date", " Weekly_Sales" AS "Weekly_Sales", "Quantity", "Order_Key", "Line" FROM raw""",
)
def q_src_csv(spark, sf):
    return intake.read_csv(spark, upload_csv(spark, sf))


@register(
    "src_schema",
    with_ctes(FACT_CTE)
    + """SELECT strftime(date, '%d-%m-%Y') AS "Date", sales AS "Sales", CAST(store AS INTEGER) AS "Store", sales * (1 - discount) AS "Weekly_Sales" FROM fact""",
)
def q_src_schema(spark, sf):
    f = sales_fact(spark, sf)
    out = f.select(
        F.date_format("date", "dd-MM-yyyy").alias("Date"), F.col("sales").alias("Sales"), F.col("store").cast("int").alias("Store"),
        (F.col("sales") * (1 - F.col("discount"))).alias("Weekly_Sales"),
    )
    path = sk.write_csv(out, sk.shared_path(spark, "contract"))
    return intake.read_csv(spark, path, schema=intake.contract_schema()).drop(intake.CORRUPT)


@register("src_validate_file", VALID_SQL)
def q_src_validate_file(spark, sf):
    valid, _, _ = intake.validate_csv(spark, upload_csv(spark, sf))
    return valid


@register("src_fallback", VALID_SQL)
def q_src_fallback(spark, sf):
    good = upload_csv(spark, sf)
    _, valid, _, _ = intake.load_with_fallback(spark, [good + "-missing", good])
    return valid


@register("src_required", VALID_SQL)
def q_src_required(spark, sf):
    valid, _, _ = intake.validate_csv(spark, upload_csv(spark, sf))
    return intake.require_columns(valid, ["store", "date", "sales"])


@register(
    "src_manifest",
    """SELECT 'csv/n_regionkey=' || r_regionkey AS folder, 'csv' AS kind, CAST(NULL AS VARCHAR) AS reject_reason, true AS accepted FROM region
UNION ALL SELECT 'json/n_regionkey=' || r_regionkey, 'json', 'not a .csv file', false FROM region
UNION ALL SELECT 'large', 'csv', 'file too large', false UNION ALL SELECT 'none', 'csv', 'empty file', false""",
)
def q_src_manifest(spark, sf):
    """A landing folder of accepted files and of every reason to reject one."""
    landing, nation = sk.shared_path(spark, "landing"), table(spark, sf, "nation").coalesce(1)
    nation.write.partitionBy("n_regionkey").csv(f"{landing}/csv")
    nation.write.partitionBy("n_regionkey").json(f"{landing}/json")
    table(spark, sf, "events").coalesce(1).write.csv(f"{landing}/large")
    nation.limit(0).coalesce(1).write.csv(f"{landing}/none")
    found = intake.upload_manifest(spark, landing, max_bytes=20_000)
    folder = F.regexp_extract("path", "/landing-[0-9a-f]+/(.*)/[^/]*$", 1)
    return found.select(folder.alias("folder"), F.element_at(F.split("file_name", "\\."), -1).alias("kind"), "reject_reason", "accepted")


@register(
    "snk_csv",
    VALID_SQL.replace("SELECT store, date, sales, quantity, order_key, line FROM typed", "SELECT store, date, sales, CAST(quantity AS BIGINT) AS quantity, CAST(order_key AS BIGINT) AS order_key, CAST(line AS INTEGER) AS line FROM typed"),
)
def q_snk_csv(spark, sf):
    valid, _, _ = intake.validate_frame(rendered_upload(spark, sf))
    path = sk.write_csv(valid, sk.shared_path(spark, "valid"))
    schema = "store string, date date, sales double, quantity bigint, order_key bigint, line int"
    return spark.read.option("header", True).schema(schema).csv(path)


@register("snk_json")
def q_snk_json(spark, sf):
    from ..operators import forecast as fc
    from ..operators import series as ts

    d = ts.aggregate(sales_fact(spark, sf), "D", ["store"], positive=False).withColumnRenamed("period", "date").withColumnRenamed("value", "sales")
    pred = fc.profile_forecast(d, 30, ["store"])
    report = sk.json_report(pred, ["store"])
    path = sk.write_json(report, sk.shared_path(spark, "report"))
    return spark.read.schema("store string, report_json string").json(path)


REPORT = "metadata struct<store:string,start:date,end:date>, summary struct<total_predictions:bigint,average:double,max:double,min:double>, predictions array<struct<date:date,predicted_sales:double>>"


@register(
    "snk_json_report",
    with_ctes(FACT_CTE)
    + """, d AS (SELECT store, date, sum(sales) AS sales FROM fact GROUP BY store, date)
SELECT store, min(date) AS start, max(date) AS "end", count(*) AS total_predictions, round(avg(sales), 2) AS average, round(max(sales), 2) AS max, round(min(sales), 2) AS min,
       list(date ORDER BY date) AS dates, round(list_sum(list_transform(list(sales ORDER BY date), lambda v, i: v * i)), 2) AS weighed FROM d GROUP BY store""",
)
def q_snk_json_report(spark, sf):
    """A report document per store of its daily totals, written, read again and taken apart."""
    from ..operators import series as ts

    d = ts.aggregate(sales_fact(spark, sf), "D", ["store"], positive=False).select("store", F.col("period").alias("date"), F.col("value").alias("predicted_sales"))
    path = sk.write_json(sk.json_report(d, ["store"]), sk.shared_path(spark, "report"))
    doc = spark.read.schema("store string, report_json string").json(path).withColumn("r", F.from_json("report_json", REPORT))
    weighed = F.aggregate(F.transform("r.predictions", lambda p, i: p["predicted_sales"] * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    out = doc.select("r.metadata.*", "r.summary.*", F.transform("r.predictions", lambda p: p["date"]).alias("dates"), weighed.alias("weighed"))
    return rnd(out)


# --- stored multi-tenant table -------------------------------------------------------------------
CORRECTED_FROM = "2024-01-10"
STORED_SQL = """stored_in AS (SELECT user_id, store_id, date, sales, event_id FROM tfact),
b1 AS (SELECT * FROM stored_in),
b2 AS (SELECT user_id, store_id, date, sales + 1 AS sales, event_id FROM stored_in WHERE date >= DATE '2024-01-10' AND event_id % 3 = 0),
s1 AS (SELECT user_id, store_id, date, sales FROM b1 QUALIFY row_number() OVER (PARTITION BY user_id, store_id, date ORDER BY event_id DESC) = 1)"""
PARTS_SQL = """CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(week(date) AS INTEGER) AS week,
       CAST(quarter(date) AS INTEGER) AS quarter, CASE WHEN month(date) IN (12,1,2) THEN 'Winter' WHEN month(date) IN (3,4,5) THEN 'Spring'
       WHEN month(date) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END AS season, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(dayofyear(date) AS INTEGER) AS day_of_year"""
WS = with_ctes(TENANT_CTE, STORED_SQL)


def batches(spark, sf):
    """All stored sales, and a correction of a third of the later ones, whose keys arrive as text with junk among them."""
    t = tenant_fact(spark, sf)
    late = t.where((F.col("date") >= F.lit(CORRECTED_FROM).cast("date")) & (F.col("event_id") % 3 == 0))
    text = late.select(F.col("user_id").cast("string").alias("user_id"), "store_id", F.date_format("date", "dd/MM/yyyy").alias("date"), (F.col("sales") + 1).alias("sales"), "event_id")
    return t, text.union(text.select(F.lit("not a tenant"), "store_id", "date", "sales", "event_id")).union(text.select("user_id", "store_id", F.lit("bad"), "sales", "event_id"))


def stored_table(spark, sf) -> str:
    b1, _ = batches(spark, sf)
    path = sk.shared_path(spark, "stored")
    lt.append(spark, path, b1, order="event_id")
    return path


@register(
    "snk_upsert",
    WS
    + f""", t2 AS (SELECT DISTINCT user_id FROM b2),
m AS (SELECT user_id, store_id, date, sales, 0 AS batch, NULL AS event_id FROM s1 WHERE user_id IN (SELECT user_id FROM t2)
      UNION ALL SELECT user_id, store_id, date, sales, 1, event_id FROM b2),
w AS (SELECT user_id, store_id, date, sales FROM m QUALIFY row_number() OVER (PARTITION BY user_id, store_id, date ORDER BY batch DESC, event_id DESC NULLS LAST) = 1),
f AS (SELECT * FROM w UNION ALL SELECT * FROM s1 WHERE user_id NOT IN (SELECT user_id FROM t2))
SELECT user_id, store_id, date, sales, {PARTS_SQL} FROM f""",
)
def q_snk_upsert(spark, sf):
    path = stored_table(spark, sf)
    _, b2 = batches(spark, sf)
    lt.append(spark, path, b2, order="event_id")
    return lt.read(spark, path).drop(*sk.PARTITION)


@register(
    "snk_compact",
    WS
    + f""", m AS (SELECT user_id, store_id, date, sales, 0 AS batch, NULL AS event_id FROM s1 UNION ALL SELECT user_id, store_id, date, sales, 1, event_id FROM b2),
f AS (SELECT user_id, store_id, date, sales FROM m WHERE user_id <> 4 QUALIFY row_number() OVER (PARTITION BY user_id, store_id, date ORDER BY batch DESC, event_id DESC NULLS LAST) = 1)
SELECT user_id, store_id, date, sales, {PARTS_SQL} FROM f""",
)
def q_snk_compact(spark, sf):
    """Two uploads and the removal of a tenant, folded into one batch."""
    path = stored_table(spark, sf)
    lt.append(spark, path, batches(spark, sf)[1], order="event_id")
    lt.delete_tenant(spark, path, 4)
    lt.compact(spark, path)
    return lt.read(spark, path).drop(*sk.PARTITION)


@register(
    "snk_plain_upsert",
    WS
    + f""", m AS (SELECT user_id, store_id, date, sales, 0 AS batch, NULL AS event_id FROM s1 UNION ALL SELECT user_id, store_id, date, sales, 1, event_id FROM b2),
f AS (SELECT user_id, store_id, date, sales FROM m QUALIFY row_number() OVER (PARTITION BY user_id, store_id, date ORDER BY batch DESC, event_id DESC NULLS LAST) = 1)
SELECT user_id, store_id, date, sales, {PARTS_SQL} FROM f""",
)
def q_snk_plain_upsert(spark, sf):
    """The same two uploads into plain partitioned Parquet, whose touched folders are rewritten."""
    b1, b2 = batches(spark, sf)
    path = sk.shared_path(spark, "plain")
    sk.write_stored(sk.upsert(spark, None, [b1], order="event_id"), path)
    sk.write_stored(sk.upsert(spark, path, [b2], order="event_id"), path)
    return tenant.read_stored(spark, path)


@register(
    "snk_upsert_report",
    WS + """SELECT count(*) AS stored, 2 * count(*) AS failed FROM b2""",
)
def q_snk_upsert_report(spark, sf):
    return sk.upsert_report([batches(spark, sf)[1]])


@register(
    "snk_replace_tenant",
    WS
    + f""", r AS (SELECT user_id, store_id, date, sales * 2 AS sales FROM b2 WHERE user_id IN (3, 5)
      QUALIFY row_number() OVER (PARTITION BY user_id, store_id, date ORDER BY event_id DESC) = 1),
f AS (SELECT * FROM s1 WHERE user_id NOT IN (3, 5) UNION ALL SELECT * FROM r)
SELECT user_id, store_id, date, sales, {PARTS_SQL} FROM f""",
)
def q_snk_replace_tenant(spark, sf):
    path = stored_table(spark, sf)
    _, b2 = batches(spark, sf)
    new_rows = b2.where(F.col("user_id").isin("3", "5")).withColumn("sales", F.col("sales") * 2)
    lt.replace_tenants(spark, path, new_rows, tenants=[3, 5], order="event_id")
    return lt.read(spark, path).drop(*sk.PARTITION)


@register(
    "src_tenant_scan",
    WS + f"""SELECT user_id, store_id, date, sales, {PARTS_SQL} FROM s1
WHERE user_id = 7 AND store_id = 'click' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' ORDER BY store_id, date""",
)
def q_src_tenant_scan(spark, sf):
    t = lt.read(spark, stored_table(spark, sf))
    return tenant.tenant_scan(t, 7, "click", "2024-01-05", "2024-01-12")


@register(
    "src_export_tenant",
    WS + f"""SELECT store_id, date, sales, {PARTS_SQL} FROM s1 WHERE user_id = 8""",
)
def q_src_export_tenant(spark, sf):
    t = lt.read(spark, stored_table(spark, sf))
    out = tenant.export_tenant(t, 8, sk.shared_path(spark, "export"))
    schema = ("store_id string, date date, sales double, year int, month int, week int, quarter int, season string, "
              "day_of_week int, day_of_year int")
    return spark.read.option("header", True).schema(schema).csv(out)
