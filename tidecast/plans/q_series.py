"""Checked queries for joins (§2.3), windows (§2.5) and series preparation (§2.9 SQL rows).

Multi-series queries run per store (100 series at sf0.01) so every window is
partitioned by its series key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import season, season_order, weekday0
from ..functions.numeric import pct_change
from ..operators import series as ts
from ..operators import windows as win
from ..sources.testdata import FACT_CTE, sales_fact
from .registry import register, rnd, with_ctes

W = with_ctes(FACT_CTE)
MONTHLY = """, ms AS (SELECT store, CAST(date_trunc('month', date) AS DATE) AS period, sum(sales) AS value FROM fact GROUP BY 1, 2)
"""
DAILY = """, ds AS (SELECT store, date AS period, sum(sales) AS value FROM fact GROUP BY 1, 2)
"""
K = ["store"]


def monthly(spark, sf):
    return ts.aggregate(sales_fact(spark, sf), "MS", K)


def daily(spark, sf):
    return ts.aggregate(sales_fact(spark, sf), "D", K)


# --- §2.9 aggregation to periods ---------------------------------------------------------------
@register("ts_index", W + """SELECT store, date AS period, sales AS value FROM fact""")
def q_ts_index(spark, sf):
    return ts.index_series(sales_fact(spark, sf), keys=K)


@register("ts_daily", W + DAILY + """SELECT store, period, round(value, 2) AS value FROM ds WHERE value > 0""")
def q_ts_daily(spark, sf):
    return rnd(daily(spark, sf))


@register(
    "ts_weekly",
    W
    + """SELECT store, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS period, round(sum(sales), 2) AS value
FROM fact GROUP BY 1, 2 HAVING sum(sales) > 0""",
)
def q_ts_weekly(spark, sf):
    return rnd(ts.aggregate(sales_fact(spark, sf), "W", K))


@register("ts_monthly", W + MONTHLY + """SELECT store, period, round(value, 2) AS value FROM ms WHERE value > 0""")
def q_ts_monthly(spark, sf):
    return rnd(monthly(spark, sf))


CAL_M = """, b AS (SELECT store, min(period) AS lo, max(period) AS hi FROM ms GROUP BY store),
cal AS (SELECT store, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM b)
"""


@register(
    "ts_monthly_zero",
    W + MONTHLY + CAL_M + """SELECT cal.store, cal.period, round(coalesce(ms.value, 0.0), 2) AS value
FROM cal LEFT JOIN ms ON cal.store = ms.store AND cal.period = ms.period""",
)
def q_ts_monthly_zero(spark, sf):
    s = ts.aggregate(sales_fact(spark, sf), "MS", K, positive=False)
    return rnd(ts.complete(s, "MS", K, fill_value=0.0))


@register(
    "ts_series_stats",
    W
    + MONTHLY
    + """SELECT store, count(value) AS periods, min(period) AS date_range_start, max(period) AS date_range_end,
       round((max(period) - min(period)) / 7.0, 2) AS total_weeks, round(avg(value), 2) AS avg_sales, round(stddev_samp(value), 2) AS std_sales,
       round(min(value), 2) AS min_sales, round(max(value), 2) AS max_sales FROM ms WHERE value > 0 GROUP BY store""",
)
def q_ts_series_stats(spark, sf):
    return rnd(ts.series_stats(monthly(spark, sf), K))


CAL_D = """, b AS (SELECT store, min(period) AS lo, max(period) AS hi FROM ds GROUP BY store),
cal AS (SELECT store, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS period FROM b),
j AS (SELECT cal.store, cal.period, ds.value, ds.value IS NULL AS filled FROM cal LEFT JOIN ds ON cal.store = ds.store AND cal.period = ds.period)
"""


@register(
    "jn_calendar",
    W + DAILY + CAL_D + """SELECT store, period, round(value, 2) AS value FROM j""",
)
def q_jn_calendar(spark, sf):
    return rnd(ts.complete(daily(spark, sf), "D", K))


FIXED_SQL = """SELECT store, period, round(coalesce(value,
    last_value(value IGNORE NULLS) OVER (PARTITION BY store ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(value IGNORE NULLS) OVER (PARTITION BY store ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 2) AS value,
    filled FROM j"""


@register("ts_fixed", W + DAILY + CAL_D + FIXED_SQL)
def q_ts_fixed(spark, sf):
    return rnd(ts.fixed_intervals(daily(spark, sf), "D", K))


@register(
    "ts_fill_stats",
    W
    + DAILY
    + CAL_D
    + """SELECT store, count(*) FILTER (WHERE NOT filled) AS original_length, count(*) AS final_length,
       count(*) FILTER (WHERE filled) AS missing_periods_filled, 'D' AS frequency, min(period) AS date_range_start, max(period) AS date_range_end
FROM j GROUP BY store""",
)
def q_ts_fill_stats(spark, sf):
    return ts.fill_stats(ts.fixed_intervals(daily(spark, sf), "D", K), "D", K)


@register(
    "ts_validate",
    W
    + MONTHLY
    + """, s AS (SELECT * FROM ms WHERE value > 0),
g AS (SELECT *, period - lag(period) OVER (PARTITION BY store ORDER BY period) AS gap FROM s),
base AS (SELECT store, count(*) AS length, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS nan_count, avg(value) AS mean,
         stddev_samp(value) AS std, min(value) AS min, max(value) AS max, min(period) AS start_date, max(period) AS end_date,
         count(DISTINCT gap) AS distinct_intervals FROM g GROUP BY store),
o AS (SELECT s.store, count(*) FILTER (WHERE abs(value - mean) > 5 * std) AS outliers FROM s JOIN base USING (store) GROUP BY s.store),
r AS (SELECT base.*, o.outliers, nan_count * 100.0 / length AS nan_pct FROM base LEFT JOIN o USING (store))
SELECT store, length, nan_count, round(mean, 2) AS mean, round(std, 2) AS std, round(min, 2) AS min, round(max, 2) AS max, start_date, end_date,
       distinct_intervals, outliers,
       list_filter([CASE WHEN length < 10 THEN printf('Series length (%d) is less than minimum (%d)', length, 10) END,
                    CASE WHEN nan_pct > 20 THEN printf('Too many NaN values (%.1f%%)', nan_pct) END,
                    CASE WHEN std = 0 THEN 'Series has no variation (constant values)' END], lambda x: x IS NOT NULL) AS issues,
       list_filter([CASE WHEN nan_pct > 0 AND nan_pct <= 20 THEN printf('Series has %d NaN values (%.1f%%)', nan_count, nan_pct) END,
                    CASE WHEN outliers > 0 THEN printf('Found %d potential outliers (%.1f%%)', outliers, outliers * 100.0 / length) END,
                    CASE WHEN distinct_intervals > 1 THEN printf('Series has %d different time intervals', distinct_intervals) END], lambda x: x IS NOT NULL) AS warnings,
       NOT (length < 10 OR nan_pct > 20 OR coalesce(std = 0, false)) AS is_valid
FROM r""",
)
def q_ts_validate(spark, sf):
    return rnd(ts.validate(monthly(spark, sf), K))


VALIDATE_BODY = """
g AS (SELECT *, period - lag(period) OVER (PARTITION BY store ORDER BY period) AS gap FROM s),
base AS (SELECT store, count(*) AS length, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS nan_count, avg(value) AS mean,
         stddev_samp(value) AS std, min(value) AS min, max(value) AS max, min(period) AS start_date, max(period) AS end_date,
         count(DISTINCT gap) AS distinct_intervals FROM g GROUP BY store),
o AS (SELECT s.store, count(*) FILTER (WHERE abs(value - mean) > 5 * std) AS outliers FROM s JOIN base USING (store) GROUP BY s.store),
r AS (SELECT base.*, o.outliers, nan_count * 100.0 / length AS nan_pct FROM base LEFT JOIN o USING (store))
SELECT store, length, nan_count, round(mean, 2) AS mean, round(std, 2) AS std, round(min, 2) AS min, round(max, 2) AS max, start_date, end_date,
       distinct_intervals, outliers,
       list_filter([CASE WHEN length < 10 THEN printf('Series length (%d) is less than minimum (%d)', length, 10) END,
                    CASE WHEN nan_pct > 20 THEN printf('Too many NaN values (%.1f%%)', nan_pct) END,
                    CASE WHEN std = 0 THEN 'Series has no variation (constant values)' END], lambda x: x IS NOT NULL) AS issues,
       list_filter([CASE WHEN nan_pct > 0 AND nan_pct <= 20 THEN printf('Series has %d NaN values (%.1f%%)', nan_count, nan_pct) END,
                    CASE WHEN outliers > 0 THEN printf('Found %d potential outliers (%.1f%%)', outliers, outliers * 100.0 / length) END,
                    CASE WHEN distinct_intervals > 1 THEN printf('Series has %d different time intervals', distinct_intervals) END], lambda x: x IS NOT NULL) AS warnings,
       NOT (length < 10 OR nan_pct > 20 OR coalesce(std = 0, false)) AS is_valid
FROM r"""

PREP_CTE = """, pos AS (SELECT * FROM ms WHERE value > 0),
pb AS (SELECT store, min(period) AS lo, max(period) AS hi FROM pos GROUP BY store),
pc AS (SELECT store, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM pb),
pj AS (SELECT pc.store, pc.period, pos.value FROM pc LEFT JOIN pos USING (store, period)),
filled AS (SELECT store, period, coalesce(value,
    last_value(value IGNORE NULLS) OVER (PARTITION BY store ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(value IGNORE NULLS) OVER (PARTITION BY store ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM pj)
"""


# --- §2.3 joins ---------------------------------------------------------------------------------
@register(
    "jn_scalar",
    W
    + """, d AS (SELECT date, sum(sales) AS sales FROM fact GROUP BY date), m AS (SELECT avg(sales) AS overall_mean FROM d)
SELECT date, round(sales, 2) AS sales, round(overall_mean, 2) AS overall_mean, round((sales - overall_mean) / nullif(overall_mean, 0) * 100, 2) AS pct_vs_mean,
       sales > overall_mean AS above_mean FROM d, m""",
)
def q_jn_scalar(spark, sf):
    from ..functions.attach import attach_row as _attach
    from ..operators.eda import daily_totals

    d = daily_totals(sales_fact(spark, sf))
    m = d.agg(F.avg("sales").alias("overall_mean"))
    j = _attach(d, m)
    return rnd(j.withColumns({"pct_vs_mean": pct_change("sales", "overall_mean"), "above_mean": F.col("sales") > F.col("overall_mean")}))


@register(
    "jn_order_map",
    W
    + """SELECT CASE WHEN month(date) IN (12,1,2) THEN 'Winter' WHEN month(date) IN (3,4,5) THEN 'Spring' WHEN month(date) IN (6,7,8) THEN 'Summer' ELSE 'Fall' END AS season,
       CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, round(sum(sales), 2) AS total_sales,
       CAST(CASE WHEN month(date) IN (12,1,2) THEN 0 WHEN month(date) IN (3,4,5) THEN 1 WHEN month(date) IN (6,7,8) THEN 2 ELSE 3 END AS INTEGER) AS season_order,
       dayname(any_value(date)) AS day_name
FROM fact GROUP BY 1, 2, 4""",
)
def q_jn_order_map(spark, sf):
    from ..functions.calendar import DAY_NAMES

    f = sales_fact(spark, sf)
    g = f.groupBy(season(F.month("date")).alias("season"), weekday0("date").alias("day_of_week")).agg(F.sum("sales").alias("total_sales"))
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return rnd(g.withColumns({"season_order": season_order("season"), "day_name": F.element_at(names, F.col("day_of_week") + 1)}))


# --- §2.5 windows -------------------------------------------------------------------------------
@register(
    "win_trend",
    W
    + """, m AS (SELECT store, strftime(date, '%Y-%m') AS month, avg(sales) AS avg_sales FROM fact GROUP BY 1, 2),
t AS (SELECT *, lag(avg_sales) OVER (PARTITION BY store ORDER BY month) AS prev FROM m),
c AS (SELECT store, month, avg_sales, round(CASE WHEN prev IS NULL THEN 0.0 ELSE coalesce((avg_sales - prev) / nullif(prev, 0) * 100, 0.0) END, 2) AS change_pct FROM t)
SELECT store, month, round(avg_sales, 2) AS avg_sales, change_pct, CASE WHEN change_pct > 2 THEN '↑' WHEN change_pct < -2 THEN '↓' ELSE '→' END AS direction FROM c""",
)
def q_win_trend(spark, sf):
    m = sales_fact(spark, sf).groupBy("store", F.date_format("date", "yyyy-MM").alias("month")).agg(F.avg("sales").alias("avg_sales"))
    return rnd(win.period_trend(m, order="month", value="avg_sales", keys=K))


@register(
    "win_month_growth",
    W
    + """, p AS (SELECT store, CAST(month(date) AS INTEGER) AS month_num, avg(sales) AS mean FROM fact GROUP BY 1, 2)
SELECT store, month_num, round(mean, 2) AS mean,
       round((mean - lag(mean) OVER (PARTITION BY store ORDER BY month_num)) / nullif(lag(mean) OVER (PARTITION BY store ORDER BY month_num), 0) * 100, 4) AS growth_rate FROM p""",
)
def q_win_month_growth(spark, sf):
    p = sales_fact(spark, sf).groupBy("store", F.month("date").alias("month_num")).agg(F.avg("sales").alias("mean"))
    return rnd(win.month_growth(p, keys=K), overrides={"growth_rate": 4})


@register(
    "win_pred_trend",
    W
    + """, d AS (SELECT date, sum(sales) AS predicted_sales FROM fact GROUP BY date), b AS (SELECT avg(predicted_sales) AS base FROM d),
t AS (SELECT date, predicted_sales, base, coalesce(lag(predicted_sales) OVER (ORDER BY date), base) AS prev FROM d, b),
p AS (SELECT *, CASE WHEN prev > 0 THEN (predicted_sales - prev) / prev * 100 ELSE 0.0 END AS trend_pct FROM t)
SELECT date, round(predicted_sales, 2) AS predicted_sales, round(base, 2) AS base, round(trend_pct, 4) AS trend_pct,
       CASE WHEN trend_pct > 2 THEN 'Up' WHEN trend_pct < -2 THEN 'Down' ELSE 'Stable' END AS trend_direction FROM p""",
)
def q_win_pred_trend(spark, sf):
    from ..functions.attach import attach_row as _attach

    d = sales_fact(spark, sf).groupBy("date").agg(F.sum("sales").alias("predicted_sales"))
    b = d.agg(F.avg("predicted_sales").alias("base"))
    return rnd(win.prediction_trend(_attach(d, b), base="base"), overrides={"trend_pct": 4})


@register(
    "win_lags",
    W
    + MONTHLY
    + "SELECT store, period, round(value, 2) AS value, "
    + ", ".join(f"round(lag(value, {i}) OVER (PARTITION BY store ORDER BY period), 2) AS lag_{i}" for i in range(1, 13))
    + " FROM ms",
)
def q_win_lags(spark, sf):
    return rnd(win.lags(ts.aggregate(sales_fact(spark, sf), "MS", K, positive=False), 12, keys=K))


@register(
    "win_diff",
    W
    + MONTHLY
    + """, d1 AS (SELECT *, value - lag(value) OVER (PARTITION BY store ORDER BY period) AS d1,
                        row_number() OVER (PARTITION BY store ORDER BY period) AS rn FROM ms),
d2 AS (SELECT *, d1 - lag(d1) OVER (PARTITION BY store ORDER BY period) AS diff FROM d1)
SELECT store, period, round(value, 2) AS value, round(diff, 2) AS diff FROM d2 WHERE rn > 2""",
)
def q_win_diff(spark, sf):
    s = ts.aggregate(sales_fact(spark, sf), "MS", K, positive=False)
    return rnd(win.difference(s, 2, keys=K))


@register(
    "win_sdiff",
    W
    + MONTHLY
    + """, x AS (SELECT *, value - lag(value, 12) OVER (PARTITION BY store ORDER BY period) AS sdiff, count(*) OVER (PARTITION BY store) AS n FROM ms)
SELECT store, period, round(value, 2) AS value, round(sdiff, 2) AS sdiff FROM x WHERE sdiff IS NOT NULL AND n >= 24""",
)
def q_win_sdiff(spark, sf):
    s = ts.aggregate(sales_fact(spark, sf), "MS", K, positive=False)
    return rnd(win.seasonal_difference(s, 12, keys=K))


@register(
    "win_pct_change",
    W
    + MONTHLY
    + """, x AS (SELECT *, lag(value) OVER (PARTITION BY store ORDER BY period) AS prev FROM ms)
SELECT store, period, round(value, 2) AS value, round((value - prev) / nullif(prev, 0) * 100, 4) AS pct_change FROM x WHERE prev IS NOT NULL""",
)
def q_win_pct_change(spark, sf):
    s = ts.aggregate(sales_fact(spark, sf), "MS", K, positive=False)
    return rnd(win.step_pct_change(s, keys=K), overrides={"pct_change": 4})


@register(
    "win_halves",
    W
    + MONTHLY
    + """SELECT store, period, round(value, 2) AS value,
       CASE WHEN row_number() OVER (PARTITION BY store ORDER BY period) <= floor(count(*) OVER (PARTITION BY store) / 2) THEN 1 ELSE 2 END AS half FROM ms""",
)
def q_win_halves(spark, sf):
    return rnd(win.halves(ts.aggregate(sales_fact(spark, sf), "MS", K, positive=False), keys=K))


@register(
    "win_train_test",
    W
    + MONTHLY
    + """SELECT store, period, round(value, 2) AS value,
       CASE WHEN row_number() OVER (PARTITION BY store ORDER BY period) <= floor(count(*) OVER (PARTITION BY store) * 0.8) THEN 'train' ELSE 'test' END AS split FROM ms""",
)
def q_win_train_test(spark, sf):
    return rnd(win.train_test_split(ts.aggregate(sales_fact(spark, sf), "MS", K, positive=False), 0.8, keys=K))


@register(
    "win_first_last",
    W
    + MONTHLY
    + """, x AS (SELECT store, arg_min(value, period) AS first_value, arg_max(value, period) AS last_value FROM ms GROUP BY store)
SELECT store, round(first_value, 2) AS first_value, round(last_value, 2) AS last_value, round(last_value - first_value, 2) AS change,
       round((last_value - first_value) / nullif(first_value, 0) * 100, 2) AS change_pct,
       CASE WHEN last_value > first_value THEN 'increasing' ELSE 'decreasing' END AS trend FROM x""",
)
def q_win_first_last(spark, sf):
    return rnd(win.first_last(ts.aggregate(sales_fact(spark, sf), "MS", K, positive=False), keys=K))


@register(
    "win_intervals",
    W
    + DAILY
    + """, g AS (SELECT store, period - lag(period) OVER (PARTITION BY store ORDER BY period) AS gap_days FROM ds)
SELECT store, count(DISTINCT gap_days) AS distinct_gaps, CAST(min(gap_days) AS INTEGER) AS min_gap, CAST(max(gap_days) AS INTEGER) AS max_gap,
       list_sort(list(DISTINCT CAST(gap_days AS INTEGER))) AS gaps
FROM g WHERE gap_days IS NOT NULL GROUP BY store""",
)
def q_win_intervals(spark, sf):
    return win.intervals(daily(spark, sf), keys=K)


@register(
    "ts_weekly_stats",
    W
    + """, ws AS (SELECT store, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS period, sum(sales) AS value FROM fact GROUP BY 1, 2
       HAVING sum(sales) > 0)
SELECT store, count(value) AS periods, min(period) AS date_range_start, max(period) AS date_range_end,
       round((max(period) - min(period)) / 7.0, 2) AS total_weeks, round(avg(value), 2) AS avg_sales, round(stddev_samp(value), 2) AS std_sales,
       round(min(value), 2) AS min_sales, round(max(value), 2) AS max_sales FROM ws GROUP BY store""",
)
def q_ts_weekly_stats(spark, sf):
    return rnd(ts.series_stats(ts.aggregate(sales_fact(spark, sf), "W", K), K))
