"""Queries for the bundles (agg_eda_bundle, §2.13 chart data, first-30 preview, store labels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..operators import series as ts
from ..sources.testdata import ENRICHED_CTE, FACT_CTE, sales_fact, table
from .q_forecast import PROFILE_CTE
from .registry import register, rnd, with_ctes
from .workflows import chart_bundle, eda_bundle


def _contents(bundle, items):
    """(section, item, measure, value) of every section; ``items``: what names a row of it."""
    out = None
    for name, df in bundle.items():
        item, skip = items.get(name, (F.lit("all"), ()))
        numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "integer", "long", "decimal") and f.name not in skip]
        texts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("date", "string") and f.name in ("date_range_start", "date_range_end", "best_performer")]
        rows = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("label")) for c in numbers]
        rows += [F.struct(F.lit(c).alias("measure"), F.lit(None).cast("double").alias("value"), F.col(c).cast("string").alias("label")) for c in texts]
        part = df.select(F.lit(name).alias("section"), item.cast("string").alias("item"), F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    return rnd(out)


def _long_sql(section: str, item: str, source: str, numbers: str, texts: str = "") -> str:
    """The same rows of one section from a SQL table."""
    n, t = numbers.split(), texts.split()
    names = ", ".join(f"'{c}'" for c in [*n, *t])
    values = ", ".join([f"CAST({c} AS DOUBLE)" for c in n] + ["NULL"] * len(t))
    labels = ", ".join(["NULL"] * len(n) + [f"CAST({c} AS VARCHAR)" for c in t])
    return f"SELECT '{section}' AS section, {item} AS item, unnest([{names}]) AS measure, unnest([{values}]) AS value, unnest(CAST([{labels}] AS VARCHAR[])) AS label FROM {source}"


SECTIONS_SQL = """, m AS (SELECT strftime(date, '%Y-%m') AS month, sum(sales) AS total_sales, avg(sales) AS avg_sales, count(sales) AS record_count FROM fact GROUP BY 1),
se AS (SELECT season, avg(sales) AS avg_sales, sum(sales) AS total_sales, count(sales) AS records, stddev_samp(sales) AS std_dev,
       CASE season WHEN 'Winter' THEN 0 WHEN 'Spring' THEN 1 WHEN 'Summer' THEN 2 ELSE 3 END AS season_order FROM efact GROUP BY season),
st AS (SELECT stddev_samp(avg_sales) AS season_mean_std, sum(total_sales) / sum(records) AS overall_mean, count(*) AS seasons,
       stddev_samp(avg_sales) / (sum(total_sales) / sum(records)) * 100 AS seasonality_strength FROM se),
o AS (SELECT sum(sales) AS total_sales, avg(sales) AS avg_sales, stddev_samp(sales) AS std_dev, min(sales) AS min_sales, max(sales) AS max_sales, count(*) AS total_records,
      count(DISTINCT store) AS total_stores, min(date) AS date_range_start, max(date) AS date_range_end, quantile_cont(sales, 0.5) AS median_sales FROM fact),
pk AS (SELECT month, total_sales, row_number() OVER (ORDER BY total_sales DESC, month) AS rank, 'peak' AS kind FROM m QUALIFY rank <= 5
       UNION ALL SELECT month, total_sales, row_number() OVER (ORDER BY total_sales, month DESC) AS rank, 'low' AS kind FROM m QUALIFY rank <= 5),
pl AS (SELECT *, avg(total_sales) OVER (PARTITION BY kind) AS kind_average FROM pk),
sm AS (SELECT store, avg(sales) AS avg_sales, sum(sales) AS total_sales, stddev_samp(sales) AS std_dev FROM fact GROUP BY store),
sc AS (SELECT *, 100 - least(greatest(std_dev / nullif(avg_sales, 0) * 100, 0), 100) AS consistency FROM sm),
sr AS (SELECT *, row_number() OVER (ORDER BY avg_sales DESC, store) AS rank, 'top' AS kind FROM sc QUALIFY rank <= 10
       UNION ALL SELECT *, row_number() OVER (ORDER BY avg_sales, store) AS rank, 'bottom' AS kind FROM sc QUALIFY rank <= 10),
so AS (SELECT count(*) AS total_stores, avg(avg_sales) AS avg_store_sales, arg_min(store, (-avg_sales, store)) AS best_performer, max(avg_sales) AS best_performer_sales FROM sc),
wd AS (SELECT isodow(date) - 1 AS day_of_week, avg(sales) AS avg_sales, sum(sales) AS total_sales, count(sales) AS record_count FROM fact GROUP BY 1),
ye AS (SELECT year(date) AS year, sum(sales) AS total_sales, avg(sales) AS avg_sales, count(sales) AS record_count FROM fact GROUP BY 1)
"""

CORRELATED = ["quantity", "discount", "tax", "product", "order_key", "line_number", "year", "month", "week", "day_of_week", "quarter", "day_of_year"]

CORR_SQL = """cw AS (SELECT {cols} FROM efact),
cu AS (UNPIVOT cw ON COLUMNS(*) INTO NAME variable VALUE r),
cl AS (SELECT variable, round(r, 3) AS correlation FROM cu WHERE r IS NOT NULL AND NOT isnan(r)),
co AS (SELECT *, row_number() OVER (ORDER BY abs(correlation) DESC, variable) AS abs_rank FROM cl)
""".format(cols=", ".join(f"corr(sales, {c}) AS {c}" for c in CORRELATED))

BOX_SQL = """hr AS (SELECT min(sales) AS lo, max(sales) AS hi FROM fact),
hb AS (SELECT CAST(CASE WHEN (hi - lo) / 50 = 0 THEN 0 ELSE least(floor((sales - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin FROM fact, hr WHERE sales IS NOT NULL),
hc AS (SELECT bin, count(*) AS count FROM hb GROUP BY bin),
he AS (SELECT lo, hi, CAST(unnest(range(50)) AS INTEGER) AS bin FROM hr WHERE lo IS NOT NULL),
hg AS (SELECT he.bin, lo + he.bin * (hi - lo) / 50 AS bin_start, lo + (he.bin + 1) * (hi - lo) / 50 AS bin_end, coalesce(hc.count, 0) AS count FROM he LEFT JOIN hc USING (bin)),
bq AS (SELECT quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.5) AS median, quantile_cont(sales, 0.75) AS q3 FROM fact),
bf AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM bq),
bx AS (SELECT q1, median, q3, iqr, min(CASE WHEN sales BETWEEN lo AND hi THEN sales END) AS lower_whisker, max(CASE WHEN sales BETWEEN lo AND hi THEN sales END) AS upper_whisker,
       count(*) FILTER (WHERE NOT (sales BETWEEN lo AND hi)) AS outliers FROM fact, bf WHERE sales IS NOT NULL GROUP BY q1, median, q3, iqr)
"""


def _rounded(*parts: str) -> str:
    return "SELECT section, item, measure, round(value, 2) AS value, label FROM (" + " UNION ALL ".join(parts) + ")"


@register(
    "agg_eda_bundle",
    with_ctes(FACT_CTE, ENRICHED_CTE)
    + SECTIONS_SQL
    + ", "
    + CORR_SQL
    + _rounded(
        _long_sql("overall_stats", "'all'", "o", "total_sales avg_sales std_dev min_sales max_sales total_records total_stores median_sales", "date_range_start date_range_end"),
        _long_sql("monthly_trends", "month", "m", "total_sales avg_sales record_count"),
        _long_sql("seasonal_patterns", "season", "se", "avg_sales total_sales records std_dev season_order"),
        _long_sql("seasonality_strength", "'all'", "st", "season_mean_std overall_mean seasons seasonality_strength"),
        _long_sql("peak_low_periods", "kind || ' ' || month", "pl", "total_sales rank kind_average"),
        _long_sql("store_analysis", "kind || ' ' || store", "sr", "avg_sales total_sales consistency rank"),
        _long_sql("store_overview", "'all'", "so", "total_stores avg_store_sales best_performer_sales", "best_performer"),
        _long_sql("day_of_week", "CAST(day_of_week AS VARCHAR)", "wd", "avg_sales total_sales record_count"),
        _long_sql("year_analysis", "CAST(year AS VARCHAR)", "ye", "total_sales avg_sales record_count"),
        _long_sql("correlations", "variable", "co", "correlation abs_rank"),
    ),
)
def q_agg_eda_bundle(spark, sf):
    return _contents(
        eda_bundle(sales_fact(spark, sf)),
        {
            "monthly_trends": (F.col("month"), ()),
            "seasonal_patterns": (F.col("season"), ()),
            "peak_low_periods": (F.concat_ws(" ", "kind", "month"), ()),
            "store_analysis": (F.concat_ws(" ", "kind", "store"), ()),
            "day_of_week": (F.col("day_of_week"), ("day_of_week",)),
            "year_analysis": (F.col("year"), ("year",)),
            "correlations": (F.col("variable"), ()),
        },
    )


@register(
    "chart_bundle",
    with_ctes(FACT_CTE, ENRICHED_CTE)
    + SECTIONS_SQL
    + ", "
    + BOX_SQL
    + _rounded(
        _long_sql("chart_sales_over_time", "CAST(date AS VARCHAR)", "(SELECT date, sum(sales) AS sales FROM fact GROUP BY date)", "sales"),
        _long_sql("chart_seasonality", "month", "m", "total_sales avg_sales record_count"),
        _long_sql("chart_season", "season", "se", "avg_sales total_sales records std_dev season_order"),
        _long_sql("chart_store", "kind || ' ' || store", "sr", "avg_sales total_sales consistency rank"),
        _long_sql("chart_year", "CAST(year AS VARCHAR)", "ye", "total_sales avg_sales record_count"),
        _long_sql("chart_distribution", "CAST(bin AS VARCHAR)", "hg", "bin_start bin_end count"),
        _long_sql("chart_box", "'all'", "bx", "q1 median q3 iqr lower_whisker upper_whisker outliers"),
    ),
)
def q_chart_bundle(spark, sf):
    return _contents(
        chart_bundle(sales_fact(spark, sf)),
        {
            "chart_sales_over_time": (F.col("date"), ()),
            "chart_seasonality": (F.col("month"), ()),
            "chart_season": (F.col("season"), ()),
            "chart_store": (F.concat_ws(" ", "kind", "store"), ()),
            "chart_year": (F.col("year"), ("year",)),
            "chart_distribution": (F.col("bin"), ("bin",)),
        },
    )


@register(
    "pred_preview",
    with_ctes(FACT_CTE, PROFILE_CTE) + """SELECT step, date, round(predicted_sales, 2) AS predicted_sales FROM pred ORDER BY date LIMIT 30""",
)
def q_pred_preview(spark, sf):
    """First 30 predictions by date (the preview is the feature: a top-k by date)."""
    d = ts.aggregate(sales_fact(spark, sf), "D", positive=False).withColumnRenamed("period", "date").withColumnRenamed("value", "sales")
    return rnd(fc.profile_forecast(d, 365).orderBy("date").limit(30))


@register(
    "fmt_store_label",
    with_ctes(FACT_CTE)
    + """, s AS (SELECT n.n_name AS nation, list_sort(list(DISTINCT f.store)) AS stores FROM fact f
       JOIN supplier su ON CAST(su.s_suppkey AS VARCHAR) = f.store JOIN nation n ON n.n_nationkey = su.s_nationkey GROUP BY 1)
SELECT nation, stores, CASE WHEN len(stores) = 1 THEN 'Store ' || stores[1] ELSE printf('Combined (%d stores)', len(stores)) END AS store_label FROM s""",
)
def q_fmt_store_label(spark, sf):
    from ..functions.text import store_label

    f = sales_fact(spark, sf)
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("store"), F.col("s_nationkey").alias("n_nationkey"))
    nat = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    g = f.select("store").distinct().join(sup, "store").join(nat, "n_nationkey").groupBy("nation").agg(F.sort_array(F.collect_set("store")).alias("stores"))
    return g.withColumn("store_label", store_label("stores"))
