"""Checked queries for the data-quality checks Q1-Q8 (§2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as fc
from ..operators import quality as dq
from ..operators import series as ts
from ..sources.testdata import FACT_CTE, TENANT_CTE, sales_fact, tenant_fact
from .q_forecast import NAIVE_CTE
from .registry import register, rnd, with_ctes

K = ["store"]
WN = with_ctes(FACT_CTE, NAIVE_CTE)


def monthly(spark, sf):
    return ts.aggregate(sales_fact(spark, sf), "MS", K)


def naive(spark, sf):
    return fc.seasonal_naive(monthly(spark, sf), 12, 12, K)


@register(
    "dq_tenant_isolation",
    with_ctes(TENANT_CTE) + """SELECT CAST(floor(event_id / 2) AS BIGINT) AS upload_id, count(DISTINCT user_id) AS tenants FROM tfact
GROUP BY 1 HAVING count(DISTINCT user_id) > 1""",
)
def q_dq_tenant_isolation(spark, sf):
    """Uploads of two events each: most mix tenants, so the rule fires."""
    return dq.tenant_isolation(tenant_fact(spark, sf).withColumn("upload_id", F.floor(F.col("event_id") / 2)), ["upload_id"])


BOUNDS_SQL = """, h AS (SELECT store, avg(value) AS mu, stddev_samp(value) AS sdv FROM ms GROUP BY store),
b AS (SELECT fc.store, fc.step, fc.forecast, (fc.forecast - h.mu) / nullif(h.sdv, 0) AS z FROM fc LEFT JOIN h USING (store)),
bv AS (SELECT *, CASE WHEN forecast IS NULL OR isnan(forecast) OR isinf(forecast) THEN 'not finite' WHEN forecast < 0 THEN 'negative'
       WHEN abs(z) >= 3 THEN 'outside 3 sigma' END AS reason FROM b)
"""


PLANTED_SQL = """, fcp AS (SELECT store, step, period,
      CASE step WHEN 3 THEN -forecast WHEN 7 THEN forecast * 50 WHEN 9 THEN NULL ELSE forecast END AS forecast,
      CASE step WHEN 4 THEN upper_ci WHEN 8 THEN forecast - ci_width / 4 ELSE lower_ci END AS lower_ci,
      CASE step WHEN 4 THEN lower_ci WHEN 8 THEN forecast + ci_width / 4 ELSE upper_ci END AS upper_ci FROM fc)"""


def planted(spark, sf):
    """The naive forecasts with a negative, a huge and a missing value, a swapped and a shrunken interval per store."""
    f, s, v = naive(spark, sf), F.col("step"), F.col("forecast")
    quarter = F.col("ci_width") / 4
    return f.select(
        "store", "step", "period",
        F.when(s == 3, -v).when(s == 7, v * 50).when(s == 9, F.lit(None)).otherwise(v).alias("forecast"),
        F.when(s == 4, F.col("upper_ci")).when(s == 8, v - quarter).otherwise(F.col("lower_ci")).alias("lower_ci"),
        F.when(s == 4, F.col("lower_ci")).when(s == 8, v + quarter).otherwise(F.col("upper_ci")).alias("upper_ci"),
    )


@register("dq_forecast_bounds", WN + PLANTED_SQL + BOUNDS_SQL.replace("FROM fc LEFT", "FROM fcp fc LEFT") + """SELECT store, step, round(forecast, 2) AS forecast, round(z, 4) AS z, reason FROM bv WHERE reason IS NOT NULL""")
def q_dq_forecast_bounds(spark, sf):
    return rnd(dq.forecast_bounds(planted(spark, sf), monthly(spark, sf), K), overrides={"z": 4})


CI_SQL = """, cw AS (SELECT store, step, forecast, lower_ci, upper_ci, upper_ci - lower_ci AS w,
       lag(upper_ci - lower_ci) OVER (PARTITION BY store ORDER BY step) AS pw FROM fc),
cv AS (SELECT store, step, CASE WHEN lower_ci > forecast THEN 'lower above forecast' WHEN forecast > upper_ci THEN 'forecast above upper'
       WHEN w < pw - 1e-9 * abs(pw) THEN 'width shrinks' END AS reason FROM cw)
"""


@register("dq_ci", WN + PLANTED_SQL + CI_SQL.replace("FROM fc)", "FROM fcp)") + "SELECT store, step, reason FROM cv WHERE reason IS NOT NULL")
def q_dq_ci(spark, sf):
    return dq.ci_consistency(planted(spark, sf), K)


@register(
    "dq_seasonality",
    WN
    + """, mm AS (SELECT store, month(period) AS month, sum(value) AS s, count(value) AS n FROM ms GROUP BY 1, 2),
g AS (SELECT store, sum(s / n) AS ssum, sum(s) / sum(n) AS mu, count(*) AS months FROM mm GROUP BY store)
SELECT store, months, round(ssum / nullif(mu, 0), 4) AS index_sum, abs(ssum / nullif(mu, 0) - months) <= 0.25 AS passed FROM g""",
)
def q_dq_seasonality(spark, sf):
    return rnd(dq.seasonality_indices(monthly(spark, sf), K), overrides={"index_sum": 4})


@register(
    "dq_series_complete",
    with_ctes(FACT_CTE)
    + """, ds AS (SELECT store, date AS period, sum(sales) AS value FROM fact GROUP BY 1, 2),
b AS (SELECT store, min(period) AS lo, max(period) AS hi FROM ds GROUP BY store),
cal AS (SELECT store, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS period FROM b),
mi AS (SELECT store, count(*) AS missing_periods FROM cal ANTI JOIN ds USING (store, period) GROUP BY store),
nu AS (SELECT store, count(*) FILTER (WHERE value IS NULL) AS null_values, count(*) AS points FROM ds GROUP BY store)
SELECT nu.store, null_values, points, coalesce(missing_periods, 0) AS missing_periods, coalesce(missing_periods, 0) = 0 AND null_values = 0 AS passed
FROM nu LEFT JOIN mi USING (store)""",
)
def q_dq_series_complete(spark, sf):
    d = ts.aggregate(sales_fact(spark, sf), "D", K, positive=False)
    return dq.series_completeness(d, "D", K)


@register("dq_range", with_ctes(FACT_CTE) + """SELECT * FROM fact WHERE sales < 1000 OR sales > 100000 OR sales IS NULL""")
def q_dq_range(spark, sf):
    return dq.value_range(sales_fact(spark, sf), "sales", 1000.0, 100000.0)


@register(
    "dq_report",
    WN
    + BOUNDS_SQL
    + CI_SQL
    + """, t AS (SELECT count(*) AS c FROM (SELECT event_id FROM events GROUP BY event_id HAVING count(DISTINCT user_id) > 1)),
r AS (SELECT (SELECT count(*) FROM bv WHERE reason IS NOT NULL) = 0 AS passed
      UNION ALL SELECT (SELECT count(*) FROM cv WHERE reason IS NOT NULL) = 0
      UNION ALL SELECT (SELECT c FROM t) = 0
      UNION ALL SELECT (SELECT count(*) FROM fact WHERE sales < 1000 OR sales > 100000 OR sales IS NULL) = 0)
SELECT count(*) AS total_checks, count(*) FILTER (WHERE passed) AS passed_checks, count(*) FILTER (WHERE NOT passed) AS failed_checks,
       round(count(*) FILTER (WHERE passed) * 100.0 / count(*), 2) AS pass_rate FROM r""",
)
def q_dq_report(spark, sf):
    f, m = naive(spark, sf), monthly(spark, sf)
    results = [
        dq.check_result("forecast_bounds", f, dq.forecast_bounds(f, m, K)),
        dq.check_result("confidence_intervals", f, dq.ci_consistency(f, K)),
        dq.check_result("tenant_isolation", tenant_fact(spark, sf), dq.tenant_isolation(tenant_fact(spark, sf), ["event_id"])),
        dq.check_result("sales_range", sales_fact(spark, sf), dq.value_range(sales_fact(spark, sf), "sales", 1000.0, 100000.0)),
    ]
    return dq.report(results)
