"""Checked queries for forecast-table operators (§2.11 SQL rows, agg_forecast_summary, agg_pred_*).

The forecast tables come from the SQL-expressible baselines (seasonal naive per
store on monthly totals; a (month, weekday) profile forecaster on daily totals),
so every derived operator has an exact oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..operators import series as ts
from ..sources.testdata import FACT_CTE, sales_fact
from .registry import register, rnd, with_ctes

K = ["store"]

NAIVE_CTE = """ms AS (SELECT store, CAST(date_trunc('month', date) AS DATE) AS period, sum(sales) AS value FROM fact GROUP BY 1, 2 HAVING sum(sales) > 0),
mcal AS (SELECT store, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS period FROM (SELECT store, min(period) AS lo, max(period) AS hi FROM ms GROUP BY store)),
mf AS (SELECT c.store, c.period, last_value(m.value IGNORE NULLS) OVER (PARTITION BY c.store ORDER BY c.period) AS value
       FROM mcal c LEFT JOIN ms m ON m.store = c.store AND m.period = c.period),
rk AS (SELECT f.*, row_number() OVER (PARTITION BY f.store ORDER BY f.period) AS rn, count(*) OVER (PARTITION BY f.store) AS n,
       f.value - y.value AS sd FROM mf f LEFT JOIN mf y ON y.store = f.store AND y.period = f.period - INTERVAL 12 MONTH),
sg AS (SELECT store, stddev_samp(sd) AS sigma, max(period) AS last, max(n) AS n FROM rk GROUP BY store),
st AS (SELECT store, sigma, last, n, unnest(generate_series(1, 12)) AS step FROM sg),
fct AS (SELECT st.store, CAST(st.step AS INTEGER) AS step, CAST(st.last + to_months(CAST(st.step AS INTEGER)) AS DATE) AS period,
        coalesce(s.value, z.value) AS forecast, CASE WHEN s.value IS NULL THEN 'short history' ELSE 'seasonal' END AS status,
        1.96 * sigma * sqrt(ceil(st.step / 12)) AS half FROM st JOIN mf z ON z.store = st.store AND z.period = st.last
        LEFT JOIN mf s ON s.store = st.store AND s.period = CAST(st.last + to_months(CAST((st.step - 1) % 12 - 11 AS INTEGER)) AS DATE)),
fc AS (SELECT store, step, period, forecast, forecast - half AS lower_ci, forecast + half AS upper_ci, 2 * half AS ci_width, status FROM fct)"""
WN = with_ctes(FACT_CTE, NAIVE_CTE)

PROFILE_CTE = """d AS (SELECT date, sum(sales) AS sales FROM fact GROUP BY date),
lst AS (SELECT max(date) AS last, avg(sales) AS m FROM d),
cal AS (SELECT CAST(unnest(generate_series(1, 365)) AS INTEGER) AS step, last, m FROM lst),
cal2 AS (SELECT step, CAST(last + step AS DATE) AS date, m FROM cal),
prof AS (SELECT month(date) AS month, isodow(date) - 1 AS dow, avg(sales) AS p FROM d GROUP BY 1, 2),
pred AS (SELECT step, date, coalesce(p, m) AS predicted_sales FROM cal2 LEFT JOIN prof ON prof.month = month(cal2.date) AND prof.dow = isodow(cal2.date) - 1),
hp AS (SELECT avg(sales) AS hist_mean, max(sales) AS hist_max, min(sales) AS hist_min, quantile_cont(sales, 0.5) AS hist_median,
       quantile_cont(sales, 0.75) AS hist_q75 FROM d),
mav AS (SELECT month(date) AS mm, avg(sales) AS monthly_average FROM d GROUP BY 1)"""
WP = with_ctes(FACT_CTE, PROFILE_CTE)


def monthly(spark, sf):
    return ts.aggregate(sales_fact(spark, sf), "MS", K)


def naive(spark, sf):
    return fc.seasonal_naive(monthly(spark, sf), 12, 12, K)


def daily(spark, sf):
    return ts.aggregate(sales_fact(spark, sf), "D", positive=False).withColumnRenamed("period", "date").withColumnRenamed("value", "sales")


def profile(spark, sf):
    return fc.profile_forecast(daily(spark, sf), 365)


@register(
    "fc_seasonal_naive",
    WN + """SELECT store, step, period, round(forecast, 2) AS forecast, round(lower_ci, 2) AS lower_ci, round(upper_ci, 2) AS upper_ci,
       round(ci_width, 2) AS ci_width, status FROM fc""",
)
def q_fc_seasonal_naive(spark, sf):
    return rnd(naive(spark, sf))


@register(
    "fc_calendar",
    with_ctes(FACT_CTE)
    + """, l AS (SELECT store, max(date) AS last FROM fact GROUP BY store),
c AS (SELECT store, CAST(unnest(generate_series(1, 30)) AS INTEGER) AS step, last FROM l),
c2 AS (SELECT store, step, CAST(last + step AS DATE) AS date FROM c)
SELECT store, step, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day,
       CAST(week(date) AS INTEGER) AS week, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(quarter(date) AS INTEGER) AS quarter,
       CAST(dayofyear(date) AS INTEGER) AS day_of_year FROM c2""",
)
def q_fc_calendar(spark, sf):
    return fc.future_calendar(sales_fact(spark, sf), 30, K)


@register("fc_profile", WP + """SELECT step, date, round(predicted_sales, 2) AS predicted_sales FROM pred""")
def q_fc_profile(spark, sf):
    return rnd(profile(spark, sf))


DECORATE_SQL = """, j AS (SELECT pred.*, coalesce(mav.monthly_average, hp.hist_mean) AS monthly_average, hp.* FROM pred LEFT JOIN mav ON mav.mm = month(pred.date), hp),
k AS (SELECT *, coalesce(lag(predicted_sales) OVER (ORDER BY date), hist_mean) AS prev FROM j),
x AS (SELECT *,
  CASE WHEN hist_mean > 0 THEN (predicted_sales - hist_mean) / hist_mean * 100 ELSE 0.0 END AS pct_vs_average,
  CASE WHEN hist_median > 0 THEN (predicted_sales - hist_median) / hist_median * 100 ELSE 0.0 END AS pct_vs_median,
  CASE WHEN monthly_average > 0 THEN (predicted_sales - monthly_average) / monthly_average * 100 ELSE 0.0 END AS pct_vs_monthly,
  CASE WHEN prev > 0 THEN (predicted_sales - prev) / prev * 100 ELSE 0.0 END AS trend_pct FROM k),
dec AS (SELECT date, dayname(date) AS day_name, strftime(date, '%B %Y') AS month, printf('Week %d', week(date)) AS week, predicted_sales,
  predicted_sales * (1 - 0.15) AS confidence_lower, predicted_sales * (1 + 0.15) AS confidence_upper,
  predicted_sales * (1 + 0.15) - predicted_sales * (1 - 0.15) AS confidence_range, 'Medium' AS risk_level, hist_mean, monthly_average,
  pct_vs_average, pct_vs_median, pct_vs_monthly, trend_pct,
  CASE WHEN trend_pct > 2 THEN 'Up' WHEN trend_pct < -2 THEN 'Down' ELSE 'Stable' END AS trend_direction,
  CASE WHEN predicted_sales > hist_q75 THEN 'Excellent' WHEN predicted_sales > hist_median THEN 'Good' ELSE 'Below Avg' END AS performance,
  CASE WHEN pct_vs_monthly > 10 THEN printf('Peak Season +%.1f%%', pct_vs_monthly) WHEN pct_vs_monthly < -10 THEN printf('Low Season %.1f%%', pct_vs_monthly)
       ELSE 'Normal Seasonal' END AS seasonal_note,
  predicted_sales / nullif(hist_max, 0) * 100 AS pct_of_max, predicted_sales / nullif(hist_min, 0) * 100 AS pct_of_min FROM x)
"""


@register(
    "fc_decorate",
    WP
    + DECORATE_SQL
    + """SELECT date, day_name, month, week, round(predicted_sales, 2) AS predicted_sales, round(confidence_lower, 2) AS confidence_lower,
       round(confidence_upper, 2) AS confidence_upper, round(confidence_range, 2) AS confidence_range, risk_level, round(hist_mean, 2) AS hist_mean,
       round(monthly_average, 2) AS monthly_average, round(pct_vs_average, 2) AS pct_vs_average, round(pct_vs_median, 2) AS pct_vs_median,
       round(pct_vs_monthly, 2) AS pct_vs_monthly, round(trend_pct, 2) AS trend_pct, trend_direction, performance, seasonal_note,
       round(pct_of_max, 2) AS pct_of_max, round(pct_of_min, 2) AS pct_of_min FROM dec""",
)
def q_fc_decorate(spark, sf):
    return rnd(fc.decorate(profile(spark, sf), daily(spark, sf)))


@register(
    "jn_month_avg",
    WP + """SELECT date, round(coalesce(mav.monthly_average, hp.hist_mean), 2) AS monthly_average FROM pred LEFT JOIN mav ON mav.mm = month(pred.date), hp""",
)
def q_jn_month_avg(spark, sf):
    return rnd(fc.decorate(profile(spark, sf), daily(spark, sf)).select("date", "monthly_average"))


@register(
    "agg_pred_risk",
    WP
    + DECORATE_SQL
    + """SELECT count(*) AS total_predictions, round(avg(predicted_sales), 2) AS average_sales, round(max(predicted_sales), 2) AS max_sales,
       round(min(predicted_sales), 2) AS min_sales, round(stddev_pop(predicted_sales), 2) AS std_sales,
       count(*) FILTER (WHERE risk_level = 'High') AS high_risk_count, count(*) FILTER (WHERE risk_level = 'Medium') AS medium_risk_count,
       count(*) FILTER (WHERE risk_level = 'Low') AS low_risk_count FROM dec""",
)
def q_agg_pred_risk(spark, sf):
    return rnd(fc.prediction_risk(fc.decorate(profile(spark, sf), daily(spark, sf))))


@register(
    "agg_pred_monthly",
    WP
    + """, g AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month_start, sum(predicted_sales) AS total_sales, avg(predicted_sales) AS avg_daily_sales,
       min(predicted_sales) AS min_sales, max(predicted_sales) AS max_sales, count(*) AS days_in_month FROM pred GROUP BY 1),
h AS (SELECT g.*, hp.hist_mean AS hm FROM g, hp),
x AS (SELECT *, CASE WHEN hm > 0 THEN (total_sales - hm * days_in_month) / (hm * days_in_month) * 100 ELSE 0.0 END AS pct,
      CASE WHEN total_sales > 0 THEN (max_sales - min_sales) / total_sales * 100 ELSE 0.0 END AS spread FROM h)
SELECT month_start, strftime(month_start, '%B %Y') AS month, round(total_sales, 2) AS total_sales, round(avg_daily_sales, 2) AS avg_daily_sales,
       round(min_sales, 2) AS min_sales, round(max_sales, 2) AS max_sales, days_in_month, printf('%+.1f%%', pct) AS percent_vs_avg,
       CASE WHEN spread > 30 THEN 'High' WHEN spread > 20 THEN 'Medium' ELSE 'Low' END AS risk_level FROM x""",
)
def q_agg_pred_monthly(spark, sf):
    return rnd(fc.prediction_monthly(profile(spark, sf), daily(spark, sf)))


@register(
    "fc_insights",
    WP
    + """, g AS (SELECT avg(predicted_sales) AS average_forecast, max(predicted_sales) AS max_forecast, min(predicted_sales) AS min_forecast,
       stddev_samp(predicted_sales) AS volatility, arg_min(predicted_sales, date) AS f, arg_max(predicted_sales, date) AS l,
       arg_min(date, (-predicted_sales, date)) AS peak_date, arg_min(date, (predicted_sales, date)) AS low_date FROM pred),
t AS (SELECT *, CASE WHEN l > f THEN 'increasing' ELSE 'decreasing' END AS trend, CASE WHEN f <> 0 THEN (l - f) / f * 100 ELSE 0.0 END AS trend_value FROM g)
SELECT round(average_forecast, 2) AS average_forecast, round(max_forecast, 2) AS max_forecast, round(min_forecast, 2) AS min_forecast, trend,
       round(trend_value, 4) AS trend_value, round(volatility, 2) AS volatility, peak_date, low_date, monthname(peak_date) AS peak_month,
       printf('Highest day: %s, about $%,.2f. Plan extra stock and staff for it.', CAST(peak_date AS VARCHAR), max_forecast) AS peak_advice,
       printf('Lowest day: %s, about $%,.2f. Order less ahead of it.', CAST(low_date AS VARCHAR), min_forecast) AS low_advice,
       printf('Sales are %s over the horizon (%.2f%%).', trend, trend_value) AS trend_advice
FROM t""",
)
def q_fc_insights(spark, sf):
    return rnd(fc.insights(profile(spark, sf)), overrides={"trend_value": 4})


@register(
    "fc_interactive",
    WN
    + """, h AS (SELECT store, avg(value) AS historical_avg, count(value) AS history_points FROM ms GROUP BY store),
f AS (SELECT store, avg(forecast) AS forecast_avg, stddev_pop(forecast) AS sd, arg_min(period, (-forecast, period)) AS peak_period,
      arg_min(period, (forecast, period)) AS low_period FROM fc GROUP BY store),
j AS (SELECT f.*, h.historical_avg, h.history_points, (forecast_avg - historical_avg) / nullif(historical_avg, 0) * 100 AS trend,
      sd / nullif(forecast_avg, 0) * 100 AS cv FROM f JOIN h USING (store))
SELECT store, round(historical_avg, 2) AS historical_avg, round(forecast_avg, 2) AS forecast_avg, round(trend, 1) AS trend_pct,
       CASE WHEN trend > 5 THEN 'growth' WHEN trend < -5 THEN 'decline' ELSE 'stable' END AS outlook, round(cv, 1) AS volatility_pct, cv > 15 AS volatile,
       peak_period, low_period, history_points FROM j""",
)
def q_fc_interactive(spark, sf):
    return rnd(fc.interactive_insights(monthly(spark, sf), naive(spark, sf), K), overrides={"trend_pct": 1, "volatility_pct": 1})


@register(
    "fc_scenario",
    WN
    + """, sc AS (SELECT fc.*, s.scenario FROM fc, (VALUES ('baseline'), ('pessimistic'), ('optimistic')) AS s(scenario))
SELECT store, step, period, scenario,
       round(forecast * CASE scenario WHEN 'pessimistic' THEN 0.95 WHEN 'optimistic' THEN 1.05 ELSE 1.0 END * (1 + 0.03), 2) AS forecast FROM sc""",
)
def q_fc_scenario(spark, sf):
    return rnd(fc.scenarios(naive(spark, sf), growth_rate=0.03, keys=K))


@register(
    "fc_scenario_interval",
    WN
    + """, sc AS (SELECT fc.*, s.scenario FROM fc, (VALUES ('baseline'), ('pessimistic'), ('optimistic')) AS s(scenario)),
v AS (SELECT store, step, period, scenario, ci_width,
      CASE scenario WHEN 'pessimistic' THEN lower_ci * (1 + -0.04) WHEN 'optimistic' THEN upper_ci * (1 + 0.0) ELSE forecast * (1 + -0.04) END AS f FROM sc)
SELECT store, step, period, scenario, round(f, 2) AS forecast, round(f - ci_width / 2, 2) AS lower_ci, round(f + ci_width / 2, 2) AS upper_ci FROM v""",
)
def q_fc_scenario_interval(spark, sf):
    return rnd(fc.scenarios(naive(spark, sf), growth_rate=-0.04, mode="interval", keys=K))


@register(
    "agg_forecast_summary",
    WN
    + """SELECT store, round(avg(forecast), 2) AS mean, round(quantile_cont(forecast, 0.5), 2) AS median, round(stddev_samp(forecast), 2) AS std,
       round(min(forecast), 2) AS min, round(max(forecast), 2) AS max, round(max(forecast) - min(forecast), 2) AS range, count(forecast) AS count
FROM fc GROUP BY store""",
)
def q_agg_forecast_summary(spark, sf):
    return rnd(fc.forecast_summary(naive(spark, sf), K))


@register(
    "fc_horizon",
    with_ctes(FACT_CTE)
    + """, ws AS (SELECT store, CAST(date_trunc('week', date) + INTERVAL 6 DAY AS DATE) AS period, sum(sales) AS value FROM fact GROUP BY 1, 2 HAVING sum(sales) > 0),
wcal AS (SELECT store, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS period FROM (SELECT store, min(period) AS lo, max(period) AS hi FROM ws GROUP BY store)),
wf AS (SELECT c.store, c.period, last_value(w.value IGNORE NULLS) OVER (PARTITION BY c.store ORDER BY c.period) AS value
       FROM wcal c LEFT JOIN ws w ON w.store = c.store AND w.period = c.period),
sg AS (SELECT store, max(period) AS last FROM wf GROUP BY store),
st AS (SELECT store, last, unnest(generate_series(1, 26)) AS step FROM sg),
f AS (SELECT st.store, coalesce(s.value, z.value) AS forecast FROM st JOIN wf z ON z.store = st.store AND z.period = st.last
      LEFT JOIN wf s ON s.store = st.store AND s.period = st.last + CAST(7 * ((st.step - 1) % 52 - 51) AS INTEGER))
SELECT store, round(avg(forecast), 2) AS mean, round(quantile_cont(forecast, 0.5), 2) AS median, round(stddev_samp(forecast), 2) AS std,
       round(min(forecast), 2) AS min, round(max(forecast), 2) AS max, round(max(forecast) - min(forecast), 2) AS range, count(forecast) AS count
FROM f GROUP BY store""",
)
def q_fc_horizon(spark, sf):
    w = ts.aggregate(sales_fact(spark, sf), "W", K)
    return rnd(fc.horizon(w, 26, "weeks", K, summary=True))


@register(
    "fc_metrics",
    WN
    + """, p AS (SELECT store, value AS actual, lag(value, 12) OVER (PARTITION BY store ORDER BY period) AS predicted FROM ms),
q AS (SELECT *, (actual - predicted) / nullif(actual, 0) * 100 AS ratio FROM p WHERE predicted IS NOT NULL)
SELECT store, round(sqrt(avg((actual - predicted) * (actual - predicted))), 2) AS rmse, round(avg(abs(actual - predicted)), 2) AS mae,
       round(avg(abs(ratio)), 4) AS mape, round(avg(ratio), 4) AS mpe, round(corr(actual, predicted), 4) AS correlation, count(*) AS n_observations FROM q GROUP BY store""",
)
def q_fc_metrics(spark, sf):
    from ..operators.windows import lags

    m = lags(monthly(spark, sf), 12, keys=K).select(*K, F.col("value").alias("actual"), F.col("lag_12").alias("predicted"))
    m = m.where(F.col("predicted").isNotNull())
    return rnd(fc.metrics(m, keys=K), overrides={"mape": 4, "mpe": 4, "correlation": 4})


@register(
    "fc_chart_data",
    WN
    + """, sdv AS (SELECT store, stddev_samp(forecast) AS s FROM fc GROUP BY store)
SELECT store, 'history' AS kind, period, round(value, 2) AS value, NULL::DOUBLE AS lower_ci, NULL::DOUBLE AS upper_ci, NULL::DOUBLE AS ci_width,
       NULL::DOUBLE AS band_lower, NULL::DOUBLE AS band_upper FROM ms
UNION ALL
SELECT store, 'forecast', period, round(forecast, 2), round(lower_ci, 2), round(upper_ci, 2), round(upper_ci - lower_ci, 2), round(forecast - s, 2),
       round(forecast + s, 2) FROM fc JOIN sdv USING (store)""",
)
def q_fc_chart_data(spark, sf):
    return rnd(fc.chart_data(monthly(spark, sf), naive(spark, sf), K))


@register(
    "fc_chart_stats",
    WN
    + """, f AS (SELECT store, avg(forecast) AS forecast_mean, stddev_samp(forecast) AS forecast_std, min(forecast) AS forecast_min, max(forecast) AS forecast_max,
       avg(upper_ci - lower_ci) AS ci_avg_width FROM fc GROUP BY store), h AS (SELECT store, avg(value) AS historical_mean FROM ms GROUP BY store)
SELECT store, round(forecast_mean, 2) AS forecast_mean, round(forecast_std, 2) AS forecast_std, round(forecast_min, 2) AS forecast_min,
       round(forecast_max, 2) AS forecast_max, round(ci_avg_width, 2) AS ci_avg_width, round(historical_mean, 2) AS historical_mean FROM f JOIN h USING (store)""",
)
def q_fc_chart_stats(spark, sf):
    return rnd(fc.chart_statistics(monthly(spark, sf), naive(spark, sf), K))


@register(
    "fc_histogram",
    WN
    + """, r AS (SELECT store, min(forecast) AS lo, max(forecast) AS hi FROM fc GROUP BY store)
, c AS (
SELECT store, CAST(CASE WHEN (hi - lo) / 6 = 0 THEN 0 ELSE least(floor((forecast - lo) / ((hi - lo) / 6)), 5) END AS INTEGER) AS bin, count(*) AS count
FROM fc JOIN r USING (store) GROUP BY 1, 2),
e AS (SELECT store, CAST(unnest(range(6)) AS INTEGER) AS bin FROM r)
SELECT e.store, e.bin, coalesce(c.count, 0) AS count FROM e LEFT JOIN c ON c.store = e.store AND c.bin = e.bin""",
)
def q_fc_histogram(spark, sf):
    return fc.forecast_histogram(naive(spark, sf), 6, K)


@register(
    "fc_scenario_summary",
    WN
    + """, sc AS (SELECT fc.*, s.scenario FROM fc, (VALUES ('baseline'), ('pessimistic'), ('optimistic')) AS s(scenario)),
v AS (SELECT store, scenario, forecast * CASE scenario WHEN 'pessimistic' THEN 0.95 WHEN 'optimistic' THEN 1.05 ELSE 1.0 END * (1 + 0.03) AS f FROM sc)
SELECT store, scenario, round(avg(f), 2) AS mean_forecast, count(*) AS n_periods FROM v GROUP BY store, scenario""",
)
def q_fc_scenario_summary(spark, sf):
    return rnd(fc.scenario_summary(fc.scenarios(naive(spark, sf), growth_rate=0.03, keys=K), K))
