"""Checked queries for intake (§2.1) and projections / cleaning (§2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import day_name, season, temporal_features, temporal_features7
from ..operators import clean
from ..sources import intake
from ..sources.testdata import FACT_CTE, GAPS_CTE, sales_fact, sales_fact_with_gaps
from .registry import register, rnd, with_ctes

W = with_ctes(FACT_CTE)
WG = with_ctes(FACT_CTE, GAPS_CTE)

# Upload-shaped text rendered from lineitem: twelve date layouts, junk dates and junk sales by fixed rules.
LAYOUTS = (  # DuckDB layout, Spark layout
    ("%Y-%m-%d", "yyyy-MM-dd"), ("%d-%m-%Y", "dd-MM-yyyy"), ("%d/%m/%Y", "dd/MM/yyyy"), ("%Y/%m/%d", "yyyy/MM/dd"),
    ("%d.%m.%Y", "dd.MM.yyyy"), ("%d %B %Y", "dd MMMM yyyy"), ("%b %d, %Y", "MMM dd, yyyy"), ("%d/%m/%y", "dd/MM/yy"),
    ("%Y%m%d", "yyyyMMdd"), ("%d %b %Y", "dd MMM yyyy"), ("%m-%d-%Y", "MM-dd-yyyy"), ("%m/%d/%Y 10:30 AM", "MM/dd/yyyy '10:30 AM'"),
)
RAW_CTE = """raw AS (
  SELECT store AS "Store_ID",
         CASE WHEN order_key % 31 = 0 THEN 'bad-date'
              """ + "\n              ".join(f"WHEN (order_key + line_number) % {len(LAYOUTS)} = {i} THEN strftime(date, '{x}')" for i, (x, _) in enumerate(LAYOUTS)) + """ END AS "Date ",
         CASE WHEN (order_key + line_number) % 37 = 0 THEN 'n/a' ELSE printf('%.2f', sales) END AS " Weekly_Sales",
         CAST(CAST(quantity AS BIGINT) AS VARCHAR) AS "Quantity",
         CAST(order_key AS VARCHAR) AS "Order_Key", CAST(line_number AS VARCHAR) AS "Line"
  FROM fact)"""
PARSE_SQL = r"""CAST(CASE WHEN regexp_full_match(t, '\d{{1,2}}/\d{{1,2}}/\d{{2}}') THEN COALESCE(try_strptime(t, '%d/%m/%y'), try_strptime(t, '%m/%d/%y'))
       WHEN regexp_full_match(t, '\d{{8}}') THEN try_strptime(t, '%Y%m%d')
       ELSE COALESCE(try_strptime(t, '%Y-%m-%d'), try_strptime(t, '%Y/%m/%d'), try_strptime(t, '%d-%m-%Y'),
       try_strptime(t, '%d/%m/%Y'), try_strptime(t, '%d.%m.%Y'), try_strptime(t, '%d %b %Y'), try_strptime(t, '%d %B %Y'),
       try_strptime(t, '%b %d, %Y'), try_strptime(t, '%B %d, %Y'), try_strptime(t, '%m-%d-%Y'), try_strptime(t, '%m/%d/%Y')) END AS DATE)""".replace("{{", "{").replace("}}", "}")
TYPED_CTE = """typed AS (
  SELECT trim("Store_ID") AS store, {parse} AS date, TRY_CAST(trim(" Weekly_Sales") AS DOUBLE) AS sales, "Date " AS raw_date,
         "Quantity" AS quantity, "Order_Key" AS order_key, "Line" AS line
  FROM (SELECT *, replace(trim("Date "), ' 10:30 AM', '') AS t FROM raw))""".format(parse=PARSE_SQL)
WR = with_ctes(FACT_CTE, RAW_CTE, TYPED_CTE)


def rendered_upload(spark, sf):
    f = sales_fact(spark, sf)
    k = (F.col("order_key") + F.col("line_number")) % len(LAYOUTS)
    fmt = F.coalesce(*[F.when(k == i, F.date_format("date", x)) for i, (_, x) in enumerate(LAYOUTS)])
    return f.select(
        F.col("store").alias("Store_ID"),
        F.when(F.col("order_key") % 31 == 0, F.lit("bad-date")).otherwise(fmt).alias("Date "),
        F.when((F.col("order_key") + F.col("line_number")) % 37 == 0, F.lit("n/a"))
        .otherwise(F.format_string("%.2f", "sales"))
        .alias(" Weekly_Sales"),
        F.col("quantity").cast("bigint").cast("string").alias("Quantity"),
        F.col("order_key").cast("string").alias("Order_Key"),
        F.col("line_number").cast("string").alias("Line"),
    )


@register(
    "src_validate_csv",
    WR + """SELECT store, date, sales, quantity, order_key, line FROM typed WHERE date IS NOT NULL AND sales IS NOT NULL""",
)
def q_src_validate_csv(spark, sf):
    valid, _, _ = intake.validate_frame(rendered_upload(spark, sf))
    return valid


@register(
    "src_validate_report",
    WR
    + """, c AS (SELECT count(*) AS records_in, count(*) FILTER (WHERE date IS NOT NULL AND sales IS NOT NULL) AS records_valid,
       count(*) FILTER (WHERE date IS NULL) AS unparsed_dates, count(*) FILTER (WHERE sales IS NULL) AS bad_sales FROM typed)
SELECT *, records_in - records_valid AS records_dropped, true AS is_valid,
       printf('CSV validated successfully. %d records available.', records_valid)
       || CASE WHEN records_in - records_valid > 0 THEN printf(' %d invalid rows were removed (bad/missing dates or sales).', records_in - records_valid) ELSE '' END
       || CASE WHEN unparsed_dates > 0 AND unparsed_dates < records_in THEN printf(' Note: %d date values could not be parsed and were removed.', unparsed_dates) ELSE '' END
       AS message FROM c""",
)
def q_src_validate_report(spark, sf):
    _, _, report = intake.validate_frame(rendered_upload(spark, sf))
    return report


@register(
    "src_rejected",
    WR
    + """SELECT store, date, sales, raw_date AS __raw_date, quantity, order_key, line,
       CASE WHEN date IS NULL AND sales IS NULL THEN 'bad date and sales' WHEN date IS NULL THEN 'bad date' ELSE 'bad sales' END AS reason
FROM typed WHERE date IS NULL OR sales IS NULL""",
)
def q_src_rejected(spark, sf):
    _, rejected, _ = intake.validate_frame(rendered_upload(spark, sf))
    return rejected


@register(
    "src_parse_dates",
    WR
    + """, bad AS (SELECT raw_date AS value FROM typed WHERE date IS NULL)
SELECT (SELECT count(*) FROM bad) AS unparsed,
       (SELECT list_sort(list(value)) FROM (SELECT DISTINCT value FROM bad WHERE value IS NOT NULL ORDER BY value LIMIT 5)) AS samples""",
)
def q_src_parse_dates(spark, sf):
    return intake.date_parse_failures(rendered_upload(spark, sf), "Date ")


@register(
    "prj_canonical",
    WR + """SELECT trim("Store_ID") AS store, "Date " AS date_text, " Weekly_Sales" AS sales_text FROM raw""",
)
def q_prj_canonical(spark, sf):
    raw = rendered_upload(spark, sf)
    r = intake.resolve_columns(raw.columns)
    return raw.select(
        F.trim(F.col(f"`{r.store}`")).alias("store"), F.col(f"`{r.date}`").alias("date_text"), F.col(f"`{r.sales}`").alias("sales_text")
    )


@register(
    "prj_coerce_numeric",
    WR + """SELECT order_key, line, sales FROM typed""",
)
def q_prj_coerce_numeric(spark, sf):
    from ..functions.dates import parse_sales

    raw = rendered_upload(spark, sf)
    return raw.select(F.col("Order_Key").alias("order_key"), F.col("Line").alias("line"), parse_sales(F.col(" Weekly_Sales")).alias("sales"))


@register(
    "prj_default",
    WR + """SELECT '1' AS store, count(*) AS records FROM typed WHERE date IS NOT NULL AND sales IS NOT NULL GROUP BY 1""",
)
def q_prj_default(spark, sf):
    raw = rendered_upload(spark, sf).drop("Store_ID")
    valid, _, _ = intake.validate_frame(raw)
    return valid.groupBy("store").agg(F.count(F.lit(1)).alias("records"))


FEATURE_SQL = """CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(week(date) AS INTEGER) AS week,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(quarter(date) AS INTEGER) AS quarter,
       CAST(dayofyear(date) AS INTEGER) AS day_of_year"""
SEASON_SQL = """CASE WHEN month(date) IN (12,1,2) THEN 'Winter' WHEN month(date) IN (3,4,5) THEN 'Spring'
            WHEN month(date) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END"""


@register(
    "prj_temporal",
    W + f"""SELECT DISTINCT date, {FEATURE_SQL}, {SEASON_SQL} AS season FROM fact""",
)
def q_prj_temporal(spark, sf):
    return temporal_features(sales_fact(spark, sf).select("date").distinct())


@register(
    "prj_temporal7",
    W + f"""SELECT DISTINCT date, {FEATURE_SQL}, CAST(day(date) AS INTEGER) AS day FROM fact""",
)
def q_prj_temporal7(spark, sf):
    return temporal_features7(sales_fact(spark, sf).select("date").distinct())


@register("prj_season", W + f"""SELECT DISTINCT CAST(month(date) AS INTEGER) AS month, {SEASON_SQL} AS season FROM fact""")
def q_prj_season(spark, sf):
    return sales_fact(spark, sf).select(F.month("date").alias("month")).distinct().withColumn("season", season("month"))


@register("prj_day_name", W + """SELECT DISTINCT date, dayname(date) AS day_name FROM fact""")
def q_prj_day_name(spark, sf):
    return sales_fact(spark, sf).select("date").distinct().withColumn("day_name", day_name("date"))


@register(
    "flt_store",
    W + """SELECT date, round(sum(sales), 2) AS sales, count(*) AS records FROM fact WHERE store = '1' GROUP BY date""",
)
def q_flt_store(spark, sf):
    from ..operators.series import store_series

    return rnd(store_series(sales_fact(spark, sf), "1"))


@register(
    "flt_positive",
    W
    + """SELECT date, round(sum(sales * (discount - 0.05)), 2) AS value FROM fact GROUP BY date
HAVING sum(sales * (discount - 0.05)) > 0""",
)
def q_flt_positive(spark, sf):
    from ..operators.series import positive_only

    s = sales_fact(spark, sf).groupBy("date").agg(F.sum(F.col("sales") * (F.col("discount") - 0.05)).alias("value"))
    return rnd(positive_only(s))


@register("cln_dropna", WG + """SELECT * FROM gaps WHERE sales IS NOT NULL""")
def q_cln_dropna(spark, sf):
    return clean.dropna(sales_fact_with_gaps(spark, sf), ["sales"])


@register("cln_dedupe_rows", W + """SELECT DISTINCT store, date, quantity FROM fact""")
def q_cln_dedupe_rows(spark, sf):
    return clean.dedupe_rows(sales_fact(spark, sf).select("store", "date", "quantity"))


TIEBREAK = ["order_key", "line_number", "product", "quantity", "sales"]
DEDUP_SQL = """QUALIFY row_number() OVER (PARTITION BY store, date ORDER BY order_key, line_number, product, quantity, sales NULLS FIRST) = 1"""


@register("cln_dedupe_key", W + f"""SELECT * FROM fact {DEDUP_SQL}""")
def q_cln_dedupe_key(spark, sf):
    return clean.dedupe_key(sales_fact(spark, sf), ["store", "date"], TIEBREAK)


FILL_W = "OVER (PARTITION BY store ORDER BY date ROWS BETWEEN {a} AND {b})"
FF = "last_value(sales IGNORE NULLS) " + FILL_W.format(a="UNBOUNDED PRECEDING", b="CURRENT ROW")
BF = "first_value(sales IGNORE NULLS) " + FILL_W.format(a="CURRENT ROW", b="UNBOUNDED FOLLOWING")
DEDUPED_GAPS = f"d AS (SELECT store, date, sales FROM gaps {DEDUP_SQL})"


@register("cln_fill_ffill", WG + f", {DEDUPED_GAPS} SELECT store, date, coalesce(sales, {FF}, {BF}) AS sales FROM d")
def q_cln_fill_ffill(spark, sf):
    d = clean.dedupe_key(sales_fact_with_gaps(spark, sf), ["store", "date"], TIEBREAK).select("store", "date", "sales")
    return clean.forward_fill(d)


@register("cln_fill_bfill", WG + f", {DEDUPED_GAPS} SELECT store, date, coalesce(sales, {BF}, {FF}) AS sales FROM d")
def q_cln_fill_bfill(spark, sf):
    d = clean.dedupe_key(sales_fact_with_gaps(spark, sf), ["store", "date"], TIEBREAK).select("store", "date", "sales")
    return clean.backward_fill(d)


@register(
    "cln_fill_mean",
    WG
    + """SELECT store, date, round(coalesce(sales, avg(sales) OVER (PARTITION BY store)), 2) AS sales, order_key, line_number FROM gaps""",
)
def q_cln_fill_mean(spark, sf):
    g = sales_fact_with_gaps(spark, sf).select("store", "date", "sales", "order_key", "line_number")
    return rnd(clean.mean_fill(g))


@register(
    "cln_fill_column_mean",
    WG + """SELECT order_key, line_number, round(coalesce(sales, avg(sales) OVER ()), 2) AS sales, quantity FROM gaps""",
)
def q_cln_fill_column_mean(spark, sf):
    g = sales_fact_with_gaps(spark, sf).select("order_key", "line_number", "sales", "quantity")
    return rnd(clean.column_mean_fill(g, ["sales", "quantity"]))


@register("cln_strategy", WG + """SELECT * FROM gaps WHERE sales IS NOT NULL""")
def q_cln_strategy(spark, sf):
    return clean.handle_missing(sales_fact_with_gaps(spark, sf), strategy="no-such-strategy")


@register("cln_sort", W + """SELECT store, date, sales FROM fact ORDER BY store, date""")
def q_cln_sort(spark, sf):
    return clean.sort_fact(sales_fact(spark, sf).select("store", "date", "sales"))


@register(
    "cln_rf_clean",
    WG + """SELECT date, round(sum(sales), 2) AS sales FROM (SELECT DISTINCT store, date, sales, quantity FROM gaps WHERE sales IS NOT NULL) GROUP BY date""",
)
def q_cln_rf_clean(spark, sf):
    g = sales_fact_with_gaps(spark, sf).select("store", "date", "sales", "quantity")
    return rnd(clean.rf_clean(g))


PRE_SQL = f""", d AS (SELECT * FROM gaps {DEDUP_SQL}),
p AS (SELECT store, date, coalesce(sales, {FF}, {BF}) AS sales, quantity, discount, tax, product, order_key, line_number FROM d)
"""


@register(
    "cln_preprocess",
    WG + PRE_SQL + f"""SELECT *, {FEATURE_SQL}, {SEASON_SQL} AS season FROM p""",
)
def q_cln_preprocess(spark, sf):
    return clean.preprocess(sales_fact_with_gaps(spark, sf), tiebreak=TIEBREAK)


@register(
    "cln_stats",
    WG
    + PRE_SQL
    + """SELECT (SELECT count(*) FROM gaps) AS records_before, (SELECT count(*) FILTER (WHERE sales IS NULL) FROM gaps) AS missing_values_before,
       count(*) AS records_after, count(*) FILTER (WHERE sales IS NULL) AS missing_values_after, min(date) AS start_date, max(date) AS end_date,
       (SELECT count(*) FROM gaps) - count(*) AS records_removed, CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) AS date_range
FROM p""",
)
def q_cln_stats(spark, sf):
    g = sales_fact_with_gaps(spark, sf)
    return clean.preprocessing_stats(g, clean.preprocess(g, extract_features=False, tiebreak=TIEBREAK))


@register(
    "cln_min_rows",
    W + """SELECT store, count(*) AS points FROM fact GROUP BY store HAVING count(*) >= 600""",
)
def q_cln_min_rows(spark, sf):
    return clean.eligible_series(sales_fact(spark, sf), ["store"], 600)


@register(
    "cln_daily_features",
    WR
    + f""", d AS (SELECT date, sum(sales) AS sales FROM typed WHERE date IS NOT NULL AND sales IS NOT NULL GROUP BY date)
SELECT date, round(sales, 2) AS sales, {FEATURE_SQL}, CAST(day(date) AS INTEGER) AS day FROM d WHERE sales IS NOT NULL ORDER BY date""",
)
def q_cln_daily_features(spark, sf):
    from .workflows import daily_feature_table

    valid, _, _ = intake.validate_frame(rendered_upload(spark, sf))
    return rnd(daily_feature_table(valid.select("store", "date", "sales")))


FF_ROWS = "OVER (PARTITION BY store ORDER BY date, order_key, line_number, product, quantity, sales NULLS FIRST ROWS BETWEEN {a} AND {b})"


@register(
    "cln_fill_rows",
    WG
    + """SELECT store, date, order_key, line_number, product, quantity,
       coalesce(sales, last_value(sales IGNORE NULLS) """ + FF_ROWS.format(a="UNBOUNDED PRECEDING", b="CURRENT ROW") + """,
                first_value(sales IGNORE NULLS) """ + FF_ROWS.format(a="UNBOUNDED PRECEDING", b="UNBOUNDED FOLLOWING") + """) AS sales
FROM gaps""",
)
def q_cln_fill_rows(spark, sf):
    """Forward fill over every raw row (several per store and day), skew-safe range blocks."""
    g = sales_fact_with_gaps(spark, sf).select("store", "date", "order_key", "line_number", "product", "quantity", "sales")
    return clean.forward_fill_rows(g, "sales", ["store"], ["date"], ["order_key", "line_number", "product", "quantity", "sales"])


ROWS = ["store", "date", "order_key", "line_number", "product", "quantity", "sales"]


@register(
    "cln_strategy_forward",
    WG
    + """SELECT store, date, order_key, line_number, product, quantity,
       coalesce(sales, last_value(sales IGNORE NULLS) """ + FF_ROWS.format(a="UNBOUNDED PRECEDING", b="CURRENT ROW") + """,
                first_value(sales IGNORE NULLS) """ + FF_ROWS.format(a="UNBOUNDED PRECEDING", b="UNBOUNDED FOLLOWING") + """) AS sales
FROM gaps""",
)
def q_cln_strategy_forward(spark, sf):
    return clean.handle_missing(sales_fact_with_gaps(spark, sf).select(*ROWS), "forward_fill")


@register(
    "cln_strategy_backward",
    WG
    + """SELECT store, date, order_key, line_number, product, quantity,
       coalesce(sales, first_value(sales IGNORE NULLS) """ + FF_ROWS.format(a="CURRENT ROW", b="UNBOUNDED FOLLOWING") + """,
                last_value(sales IGNORE NULLS) """ + FF_ROWS.format(a="UNBOUNDED PRECEDING", b="UNBOUNDED FOLLOWING") + """) AS sales
FROM gaps""",
)
def q_cln_strategy_backward(spark, sf):
    return clean.handle_missing(sales_fact_with_gaps(spark, sf).select(*ROWS), "backward_fill")


@register(
    "cln_strategy_mean",
    WG + """SELECT store, date, round(coalesce(sales, avg(sales) OVER (PARTITION BY store)), 2) AS sales, order_key, line_number FROM gaps""",
)
def q_cln_strategy_mean(spark, sf):
    return rnd(clean.handle_missing(sales_fact_with_gaps(spark, sf).select("store", "date", "sales", "order_key", "line_number"), "mean"))


@register(
    "cln_strategy_column_mean",
    WG + """SELECT store, round(coalesce(sales, avg(sales) OVER ()), 2) AS sales, quantity FROM gaps""",
)
def q_cln_strategy_column_mean(spark, sf):
    return rnd(clean.handle_missing(sales_fact_with_gaps(spark, sf).select("store", "sales", "quantity"), "column_mean"))
