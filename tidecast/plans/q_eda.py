"""Checked queries for the descriptive analytics (§2.4) over the lineitem sales fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import temporal_features
from ..functions.numeric import round_half_up
from ..operators import eda
from ..sources.testdata import ENRICHED_CTE, FACT_CTE, TENANT_CTE, sales_fact, tenant_fact
from .registry import register, rnd, with_ctes

W = with_ctes(FACT_CTE)
WE = with_ctes(FACT_CTE, ENRICHED_CTE)
WT = with_ctes(TENANT_CTE)


@register(
    "agg_monthly",
    W
    + """SELECT strftime(date, '%Y-%m') AS month, round(sum(sales), 2) AS total_sales,
       round(avg(sales), 2) AS avg_sales, count(sales) AS record_count
FROM fact GROUP BY 1""",
)
def q_agg_monthly(spark, sf):
    return rnd(eda.monthly_trends(sales_fact(spark, sf)))


@register(
    "agg_season",
    W
    + """SELECT season, round(avg(sales), 2) AS avg_sales, round(sum(sales), 2) AS total_sales, count(sales) AS records,
       round(stddev_samp(sales), 2) AS std_dev,
       CAST(CASE season WHEN 'Winter' THEN 0 WHEN 'Spring' THEN 1 WHEN 'Summer' THEN 2 ELSE 3 END AS INTEGER) AS season_order
FROM (SELECT *, CASE WHEN month(date) IN (12,1,2) THEN 'Winter' WHEN month(date) IN (3,4,5) THEN 'Spring'
                     WHEN month(date) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END AS season FROM fact) GROUP BY season""",
)
def q_agg_season(spark, sf):
    return rnd(eda.seasonal_patterns(sales_fact(spark, sf)))


@register(
    "agg_season_strength",
    WE
    + """, s AS (SELECT season, avg(sales) AS avg_sales, sum(sales) AS total_sales, count(sales) AS records FROM efact GROUP BY season)
SELECT round(stddev_samp(avg_sales), 2) AS season_mean_std, round(sum(total_sales) / sum(records), 2) AS overall_mean,
       count(*) AS seasons,
       CASE WHEN sum(total_sales) / sum(records) > 0 THEN round(round(stddev_samp(avg_sales) / (sum(total_sales) / sum(records)) * 100, 2), 2) ELSE 0.0 END AS seasonality_strength
FROM s""",
)
def q_agg_season_strength(spark, sf):
    return rnd(eda.seasonality_strength(sales_fact(spark, sf)))


@register(
    "agg_peak_low",
    W
    + """, m AS (SELECT strftime(date, '%Y-%m') AS month, sum(sales) AS total_sales FROM fact GROUP BY 1),
r AS (SELECT month, total_sales, CAST(row_number() OVER (ORDER BY total_sales DESC, month ASC) AS INTEGER) AS rank, 'peak' AS kind FROM m
      QUALIFY rank <= 5
      UNION ALL
      SELECT month, total_sales, CAST(row_number() OVER (ORDER BY total_sales ASC, month DESC) AS INTEGER) AS rank, 'low' AS kind FROM m
      QUALIFY rank <= 5)
SELECT month, round(total_sales, 2) AS total_sales, rank, kind, round(avg(total_sales) OVER (PARTITION BY kind), 2) AS kind_average FROM r""",
)
def q_agg_peak_low(spark, sf):
    return rnd(eda.peak_low_periods(sales_fact(spark, sf)))


@register(
    "agg_peak_gap",
    W
    + """, m AS (SELECT strftime(date, '%Y-%m') AS month, sum(sales) AS total_sales FROM fact GROUP BY 1),
p AS (SELECT avg(total_sales) AS a FROM (SELECT total_sales FROM m ORDER BY total_sales DESC, month ASC LIMIT 5)),
l AS (SELECT avg(total_sales) AS a FROM (SELECT total_sales FROM m ORDER BY total_sales ASC, month DESC LIMIT 5))
SELECT round(p.a, 2) AS peak_average, round(l.a, 2) AS low_average, round(p.a - l.a, 2) AS gap,
       round((p.a - l.a) / nullif(l.a, 0) * 100, 2) AS gap_pct FROM p, l""",
)
def q_agg_peak_gap(spark, sf):
    return rnd(eda.peak_gap(sales_fact(spark, sf)))


STORE_SQL = """, sm AS (SELECT store, avg(sales) AS avg_sales, sum(sales) AS total_sales, stddev_samp(sales) AS std_dev,
       min(sales) AS min_sales, max(sales) AS max_sales, count(sales) AS records FROM fact GROUP BY store),
sc AS (SELECT *, 100 - least(greatest(std_dev / nullif(avg_sales, 0) * 100, 0), 100) AS consistency FROM sm)
"""


@register(
    "agg_store",
    W
    + STORE_SQL
    + """SELECT store, round(avg_sales, 2) AS avg_sales, round(total_sales, 2) AS total_sales, round(std_dev, 2) AS std_dev,
       round(min_sales, 2) AS min_sales, round(max_sales, 2) AS max_sales, records, round(consistency, 2) AS consistency FROM sc""",
)
def q_agg_store(spark, sf):
    return rnd(eda.store_metrics(sales_fact(spark, sf)))


@register(
    "agg_store_rank",
    W
    + STORE_SQL
    + """SELECT store, round(avg_sales, 2) AS avg_sales, round(total_sales, 2) AS total_sales, round(consistency, 2) AS consistency,
       rank, kind FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY avg_sales DESC, store ASC) AS INTEGER) AS rank, 'top' AS kind FROM sc QUALIFY rank <= 10
  UNION ALL
  SELECT *, CAST(row_number() OVER (ORDER BY avg_sales ASC, store ASC) AS INTEGER) AS rank, 'bottom' AS kind FROM sc QUALIFY rank <= 10)""",
)
def q_agg_store_rank(spark, sf):
    return rnd(eda.store_ranking(sales_fact(spark, sf)))


@register(
    "agg_store_overview",
    W
    + STORE_SQL
    + """SELECT count(*) AS total_stores, round(avg(avg_sales), 2) AS avg_store_sales,
       arg_min(store, (-avg_sales, store)) AS best_performer, round(max(avg_sales), 2) AS best_performer_sales FROM sc""",
)
def q_agg_store_overview(spark, sf):
    return rnd(eda.store_overview(sales_fact(spark, sf)))


@register(
    "agg_store_summary",
    W
    + """SELECT store, round(avg(sales), 2) AS mean, round(min(sales), 2) AS min, round(max(sales), 2) AS max,
       round(stddev_samp(sales), 2) AS std FROM fact GROUP BY store""",
)
def q_agg_store_summary(spark, sf):
    return rnd(eda.store_summary(sales_fact(spark, sf)))


@register(
    "agg_store_volatility",
    W
    + STORE_SQL
    + """SELECT store, CAST(row_number() OVER (ORDER BY avg_sales DESC, store ASC) AS INTEGER) AS rank, round(std_dev, 2) AS std_dev,
       round(max_sales - min_sales, 2) AS sales_range FROM sc QUALIFY rank <= 5""",
)
def q_agg_store_volatility(spark, sf):
    return rnd(eda.store_volatility(sales_fact(spark, sf)))


@register(
    "agg_weekday",
    W
    + """SELECT CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, round(avg(sales), 2) AS avg_sales, round(sum(sales), 2) AS total_sales,
       count(sales) AS record_count, dayname(any_value(date)) AS day_name FROM fact GROUP BY 1""",
)
def q_agg_weekday(spark, sf):
    return rnd(eda.weekday_analysis(sales_fact(spark, sf)))


@register(
    "agg_year",
    W
    + """SELECT CAST(year(date) AS INTEGER) AS year, round(sum(sales), 2) AS total_sales, round(avg(sales), 2) AS avg_sales,
       count(sales) AS record_count FROM fact GROUP BY 1""",
)
def q_agg_year(spark, sf):
    return rnd(eda.year_analysis(sales_fact(spark, sf)))


@register(
    "agg_overall",
    W
    + """SELECT round(sum(sales), 2) AS total_sales, round(avg(sales), 2) AS avg_sales, round(stddev_samp(sales), 2) AS std_dev,
       round(min(sales), 2) AS min_sales, round(max(sales), 2) AS max_sales, count(*) AS total_records,
       count(DISTINCT store) AS total_stores, min(date) AS date_range_start, max(date) AS date_range_end,
       round(quantile_cont(sales, 0.5), 2) AS median_sales FROM fact""",
)
def q_agg_overall(spark, sf):
    return rnd(eda.overall_statistics(sales_fact(spark, sf)))


@register(
    "agg_data_stats",
    W
    + """SELECT count(DISTINCT store) AS stores, count(*) AS records, round(avg(sales), 2) AS mean_sales, round(max(sales), 2) AS max_sales,
       round(min(sales), 2) AS min_sales, round(stddev_samp(sales), 2) AS std_sales, min(date) AS start_date, max(date) AS end_date,
       CAST(floor((max(date) - min(date)) / 7) AS BIGINT) AS weeks FROM fact""",
)
def q_agg_data_stats(spark, sf):
    return rnd(eda.data_stats(sales_fact(spark, sf)))


@register(
    "agg_frame_summary",
    W
    + """SELECT count(*) AS records, min(date) AS start_date, max(date) AS end_date, round(sum(sales), 2) AS total_sales,
       round(avg(sales), 2) AS avg_sales, round(min(sales), 2) AS min_sales, round(max(sales), 2) AS max_sales,
       round(stddev_samp(sales), 2) AS std_sales FROM fact""",
)
def q_agg_frame_summary(spark, sf):
    return rnd(eda.frame_summary(sales_fact(spark, sf)))


CORR_COLS = ["quantity", "discount", "tax", "year", "month", "week", "day_of_week", "quarter", "day_of_year"]


@register(
    "agg_corr",
    WE
    + """, c AS (SELECT {cols} FROM efact),
u AS (UNPIVOT c ON COLUMNS(*) INTO NAME variable VALUE r),
l AS (SELECT variable, round(r, 3) AS correlation FROM u WHERE r IS NOT NULL AND NOT isnan(r)),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(correlation) DESC, variable ASC) AS INTEGER) AS abs_rank FROM l)
SELECT variable, correlation, abs_rank,
       CASE WHEN abs_rank <= 3 AND abs(correlation) > 0.5 THEN
         printf('sales: %s clearly with %s', CASE WHEN correlation > 0 THEN 'rises' ELSE 'falls' END, variable) END AS insight
FROM k""".format(cols=", ".join(f"corr(sales, {c}) AS {c}" for c in CORR_COLS)),
)
def q_agg_corr(spark, sf):
    f = temporal_features(sales_fact(spark, sf))
    return eda.correlation_analysis(f, columns=CORR_COLS)


@register(
    "agg_daily",
    W + """SELECT date, round(sum(sales), 2) AS sales FROM fact GROUP BY date""",
)
def q_agg_daily(spark, sf):
    return rnd(eda.daily_totals(sales_fact(spark, sf)))


@register(
    "agg_quartiles",
    W
    + """, d AS (SELECT date, sum(sales) AS s FROM fact GROUP BY date)
SELECT round(avg(s), 2) AS mean, round(stddev_samp(s), 2) AS std, round(min(s), 2) AS min, round(max(s), 2) AS max, count(*) AS days,
       round(quantile_cont(s, 0.25), 2) AS q25, round(quantile_cont(s, 0.5), 2) AS median, round(quantile_cont(s, 0.75), 2) AS q75 FROM d""",
)
def q_agg_quartiles(spark, sf):
    return rnd(eda.daily_quartiles(sales_fact(spark, sf)))


@register(
    "agg_tenant_summary",
    WT
    + """SELECT user_id, count(*) AS total_records, count(DISTINCT store_id) AS total_stores, min(date) AS min_date, max(date) AS max_date
FROM tfact GROUP BY user_id""",
)
def q_agg_tenant_summary(spark, sf):
    return eda.tenant_summary(tenant_fact(spark, sf))


@register(
    "agg_db_stats",
    WT + """SELECT count(DISTINCT user_id) AS total_users, count(*) AS total_records, count(DISTINCT store_id) AS total_stores FROM tfact""",
)
def q_agg_db_stats(spark, sf):
    return eda.db_stats(tenant_fact(spark, sf))


DESCRIBE_COLS = ["sales", "quantity", "discount", "tax"]


@register(
    "agg_describe",
    W
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev,
       round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM fact"""
        for c in DESCRIBE_COLS
    ),
)
def q_agg_describe(spark, sf):
    return rnd(eda.describe(sales_fact(spark, sf), DESCRIBE_COLS), 4)


@register(
    "agg_unified",
    W
    + """SELECT strftime(date, '%Y-%m') AS month, store, round(avg(sales), 2) AS avg_sales, round(max(sales), 2) AS max_sales,
       round(min(sales), 2) AS min_sales, count(sales) AS records, round(sum(sales), 2) AS total_sales,
       CASE grouping(strftime(date, '%Y-%m'), store) WHEN 1 THEN 'month' WHEN 2 THEN 'store' ELSE 'total' END AS level
FROM fact GROUP BY GROUPING SETS ((strftime(date, '%Y-%m')), (store), ())""",
)
def q_agg_unified(spark, sf):
    return rnd(eda.unified_analysis(sales_fact(spark, sf)))


@register(
    "agg_histogram",
    W
    + """, r AS (SELECT min(sales) AS lo, max(sales) AS hi FROM fact),
b AS (SELECT CAST(CASE WHEN (hi - lo) / 50 = 0 THEN 0 ELSE least(floor((sales - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin, lo, hi
      FROM fact, r WHERE sales IS NOT NULL),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
e AS (SELECT lo, hi, CAST(unnest(range(50)) AS INTEGER) AS bin FROM r WHERE lo IS NOT NULL)
SELECT e.bin, round(lo + e.bin * (hi - lo) / 50, 2) AS bin_start, round(lo + (e.bin + 1) * (hi - lo) / 50, 2) AS bin_end, coalesce(c.count, 0) AS count
FROM e LEFT JOIN c USING (bin)""",
)
def q_agg_histogram(spark, sf):
    return rnd(eda.histogram(sales_fact(spark, sf)))


@register(
    "agg_histogram_fixed",
    W
    + """, c AS (SELECT CAST(floor(sales / 2000.0) AS BIGINT) AS bin, count(*) AS count FROM fact WHERE sales IS NOT NULL GROUP BY 1),
e AS (SELECT unnest(generate_series(lo, hi)) AS bin FROM (SELECT min(bin) AS lo, max(bin) AS hi FROM c))
SELECT e.bin, coalesce(c.count, 0) AS count, e.bin * 2000.0 AS bin_start, (e.bin + 1) * 2000.0 AS bin_end FROM e LEFT JOIN c USING (bin)""",
)
def q_agg_histogram_fixed(spark, sf):
    return rnd(eda.fixed_width_histogram(sales_fact(spark, sf)))


@register(
    "agg_box",
    W
    + """, q AS (SELECT quantile_cont(sales, 0.25) AS q1, quantile_cont(sales, 0.5) AS median, quantile_cont(sales, 0.75) AS q3 FROM fact),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT round(q1, 2) AS q1, round(median, 2) AS median, round(q3, 2) AS q3, round(iqr, 2) AS iqr,
       round(min(CASE WHEN sales BETWEEN lo AND hi THEN sales END), 2) AS lower_whisker,
       round(max(CASE WHEN sales BETWEEN lo AND hi THEN sales END), 2) AS upper_whisker,
       count(*) FILTER (WHERE NOT (sales BETWEEN lo AND hi)) AS outliers
FROM fact, f WHERE sales IS NOT NULL GROUP BY q1, median, q3, iqr""",
)
def q_agg_box(spark, sf):
    return rnd(eda.box_plot(sales_fact(spark, sf)))


STORE_VALUES_SQL = """, sv AS (SELECT store, min(sales) AS mn, avg(sales) AS av, max(sales) AS mx FROM fact GROUP BY store),
vals AS (SELECT unnest([mn, av, mx]) AS value FROM sv)
"""


@register(
    "agg_store_bands",
    W
    + STORE_VALUES_SQL
    + """SELECT * FROM (VALUES (0, '<5000'), (1, '5000-10000'), (2, '10000-15000'), (3, '15000-20000'), (4, '>=20000')) b(band, label)
JOIN (SELECT count(*) FILTER (WHERE value < 5000) AS c0, count(*) FILTER (WHERE value >= 5000 AND value < 10000) AS c1,
             count(*) FILTER (WHERE value >= 10000 AND value < 15000) AS c2, count(*) FILTER (WHERE value >= 15000 AND value < 20000) AS c3,
             count(*) FILTER (WHERE value >= 20000) AS c4 FROM vals) c ON true""".replace(
        "SELECT * FROM", "SELECT band, label, CASE band WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 ELSE c4 END AS count FROM"
    ),
)
def q_agg_store_bands(spark, sf):
    return eda.store_value_bands(sales_fact(spark, sf))


@register(
    "agg_store_histogram",
    W
    + STORE_VALUES_SQL
    + """, b AS (SELECT CAST(floor(value / 2000.0) AS BIGINT) AS bin FROM vals),
c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
g AS (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT CAST(ceil(max(value) / 2000.0) AS BIGINT) FROM vals))) AS bin)
SELECT g.bin, CAST(g.bin * 2000.0 AS DOUBLE) AS range_start, CAST((g.bin + 1) * 2000.0 AS DOUBLE) AS range_end, printf('$%.0fK-$%.0fK', g.bin * 2.0, (g.bin + 1) * 2.0) AS label,
       coalesce(c.count, 0) AS count FROM g LEFT JOIN c USING (bin)""",
)
def q_agg_store_histogram(spark, sf):
    return eda.store_value_histogram(sales_fact(spark, sf))


# --- the same operators where a column is constant, a store has one row, a forecast is flat, a value lies far out -------
# Fixed rules, identical on both engines: one row has a store of its own, and one a value far beyond all others.
ODD_CTE = """odd AS (
  SELECT CASE WHEN order_key = (SELECT min(order_key) FROM fact) AND line_number = 1 THEN 'alone' ELSE store END AS store, date,
         CASE WHEN order_key = (SELECT max(order_key) FROM fact) AND line_number = 1 THEN sales * 1e9 ELSE sales END AS sales,
         quantity, discount, 7.25 AS flat, CASE WHEN CAST(store AS BIGINT) % 3 = 0 THEN 100.0 ELSE quantity * 1000 END AS predicted, order_key, line_number
  FROM fact)"""


def odd_fact(spark, sf):
    f = sales_fact(spark, sf)
    ends = f.agg(F.min("order_key").alias("least"), F.max("order_key").alias("most"))
    at = lambda c: (F.col("order_key") == ends.select(c).scalar()) & (F.col("line_number") == 1)
    return f.select(
        F.when(at("least"), "alone").otherwise(F.col("store")).alias("store"),
        "date",
        F.when(at("most"), F.col("sales") * 1e9).otherwise(F.col("sales")).alias("sales"),
        "quantity",
        "discount",
        F.lit(7.25).alias("flat"),
        F.when(F.col("store").cast("long") % 3 == 0, 100.0).otherwise(F.col("quantity") * 1000).alias("predicted"),
    )


ODD_CORR = ["quantity", "discount", "flat"]


@register(
    "agg_corr_by_store",
    with_ctes(FACT_CTE, ODD_CTE)
    + """, c AS (SELECT store, {cols} FROM odd GROUP BY store),
u AS (UNPIVOT c ON {names} INTO NAME variable VALUE r),
l AS (SELECT store, variable, round(r, 3) AS correlation FROM u WHERE r IS NOT NULL AND NOT isnan(r))
SELECT store, variable, correlation, CAST(row_number() OVER (PARTITION BY store ORDER BY abs(correlation) DESC, variable) AS INTEGER) AS abs_rank FROM l""".format(
        cols=", ".join(f"corr(sales, {c}) AS {c}" for c in ODD_CORR), names=", ".join(ODD_CORR)
    ),
)
def q_agg_corr_by_store(spark, sf):
    return eda.correlation_analysis(odd_fact(spark, sf), columns=ODD_CORR, keys=["store"]).drop("insight")


@register(
    "agg_moments_merged",
    with_ctes(FACT_CTE, ODD_CTE)
    + """SELECT store, count(*) AS n, round(avg(sales), 2) AS mean_sales, round(avg(quantity), 4) AS mean_quantity, round(stddev_samp(sales), 2) AS std_sales,
       CASE WHEN isnan(corr(sales, quantity)) THEN NULL ELSE round(corr(sales, quantity), 3) END AS correlation FROM odd WHERE store <> '1' AND sales < 1e9 GROUP BY store""",
)
def q_agg_moments_merged(spark, sf):
    """Days of a store, stored as states, merged into the store."""
    from ..operators import moments

    days = odd_fact(spark, sf).where("store <> '1' and sales < 1e9").groupBy("store", "date").agg(*moments.pair_state(F.col("sales"), F.col("quantity")))
    merged = moments.merge(days, ["store"], pairs=[""])
    return merged.select(
        "store",
        "n",
        round_half_up("mx", 2).alias("mean_sales"),
        round_half_up("my", 4).alias("mean_quantity"),
        round_half_up(moments.stddev_samp(F.col("xx"), F.col("n")), 2).alias("std_sales"),
        round_half_up(moments.pearson(), 3).alias("correlation"),
    )


@register(
    "agg_histogram_outlier",
    with_ctes(FACT_CTE, ODD_CTE)
    + """, c AS (SELECT CAST(floor(sales / 2000.0) AS BIGINT) AS bin, count(*) AS count FROM odd WHERE sales IS NOT NULL GROUP BY 1),
n AS (SELECT bin, count, lead(bin) OVER (ORDER BY bin) AS following FROM c),
g AS (SELECT bin, CAST(1 AS BIGINT) AS bins, count FROM n
      UNION ALL SELECT unnest(generate_series(bin + 1, following - 1)), 1, 0 FROM n WHERE following - bin - 1 BETWEEN 1 AND 1000
      UNION ALL SELECT bin + 1, following - bin - 1, 0 FROM n WHERE following - bin - 1 > 1000)
SELECT bin, count, bin * 2000.0 AS bin_start, (bin + bins) * 2000.0 AS bin_end FROM g""",
)
def q_agg_histogram_outlier(spark, sf):
    return eda.fixed_width_histogram(odd_fact(spark, sf))


@register(
    "fc_metrics_flat",
    with_ctes(FACT_CTE, ODD_CTE)
    + """SELECT store, round(sqrt(avg((quantity * 900 - predicted) * (quantity * 900 - predicted))), 2) AS rmse, round(avg(abs(quantity * 900 - predicted)), 2) AS mae,
       round(avg(abs((quantity * 900 - predicted) / nullif(quantity * 900, 0) * 100)), 2) AS mape, round(avg((quantity * 900 - predicted) / nullif(quantity * 900, 0) * 100), 2) AS mpe,
       CASE WHEN isnan(corr(quantity * 900, predicted)) THEN NULL ELSE round(corr(quantity * 900, predicted), 2) END AS correlation, count(*) AS n_observations
FROM odd GROUP BY store""",
)
def q_fc_metrics_flat(spark, sf):
    from ..operators import forecast

    return rnd(forecast.metrics(odd_fact(spark, sf).withColumn("actual", F.col("quantity") * 900), keys=["store"]))
