"""Queries for stationarity tests (§2.9) and ARIMA / SARIMA forecasting (§2.11).

SQL oracles: regressions by sweeping a cross-product matrix in a recursive query (ARIMA of order (1, 1, 1): a long
autoregression by recursion, then every candidate order by sweeping), lag products by lists. Order searches and seasonal orders are tested against least squares in
``tests/test_models.py``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arima, lagged
from ..operators import quality as dq
from ..operators import series as ts
from ..operators import stationarity as st
from ..operators import windows as win
from ..sources.testdata import FACT_CTE, sales_fact
from .q_series import PREP_CTE, VALIDATE_BODY
from .registry import register, rnd, with_ctes

K = ["store"]
W = with_ctes(FACT_CTE)
MONTHLY = """, ms AS (SELECT store, CAST(date_trunc('month', date) AS DATE) AS period, sum(sales) AS value FROM fact GROUP BY 1, 2 HAVING sum(sales) > 0)
"""


def monthly(spark, sf):
    return ts.aggregate(sales_fact(spark, sf), "MS", K)


def adf_sql(name: str, source: str, keys: str) -> str:
    """CTEs that end in ``name``: the ADF figures of each series (``keys``) of ``source`` (keys, period, value)."""

    def swept(out: str, grams: str, carried: str) -> str:
        cell = (
            "CASE WHEN i = p + 1 AND j = p + 1 THEN 1 / m[p + 1][p + 1] WHEN i = p + 1 THEN m[p + 1][j] / m[p + 1][p + 1] "
            "WHEN j = p + 1 THEN -m[i][p + 1] / m[p + 1][p + 1] ELSE m[i][j] - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1] END"
        )
        return f""", {out} AS (
  SELECT {keys}, {carried}, k, 0 AS p, g AS m FROM {grams}
  UNION ALL SELECT {keys}, {carried}, k, p + 1, list_transform(range(1, k + 1), lambda i: list_transform(range(1, k + 1), lambda j: {cell})) FROM {out} WHERE p < k - 1)"""

    def gram(out: str, source: str, skip: str, lags: str) -> str:
        return f""", {out}c AS (SELECT *, list_concat(list_concat([list_transform(range(n - 1 - {skip}), lambda t: 1.0), x[{skip} + 1 : n - 1]],
    list_transform(range(1, {lags} + 1), lambda j: dx[{skip} + 1 - j : n - 1 - j])), [dx[{skip} + 1 : n - 1]]) AS c FROM {source}),
{out} AS (SELECT * EXCLUDE (c), {lags} + 3 AS k, list_transform(c, lambda a: list_transform(c, lambda b: list_inner_product(a, b))) AS g FROM {out}c)"""

    return (
        f""", {name}_s AS (SELECT {keys}, list(value ORDER BY period) AS v, CAST(count(value) AS INTEGER) AS n, avg(value) AS mean, stddev_pop(value) AS dev
  FROM {source} WHERE value IS NOT NULL GROUP BY {keys} HAVING count(value) >= 4 AND stddev_pop(value) > 0),
{name}_x AS (SELECT * EXCLUDE (v), list_transform(v, lambda y: (y - mean) / dev) AS x FROM {name}_s),
{name}_d AS (SELECT *, list_transform(range(1, n), lambda i: x[i + 1] - x[i]) AS dx, CAST(least(greatest(n // 2 - 2, 0), ceil(12.0 * pow(n / 100.0, 0.25))) AS INTEGER) AS most FROM {name}_x)"""
        + gram(f"{name}_g", f"{name}_d", "most", "most")
        + swept(f"{name}_w", f"{name}_g", "n, most")
        + f""", {name}_a AS (SELECT {keys}, p - 2 AS lags, (n - 1 - most) * (ln(2 * pi()) + ln(m[k][k] / (n - 1 - most)) + 1) + 2 * p AS aic FROM {name}_w
  WHERE p >= 2 AND n - 1 - most > p),
{name}_b AS (SELECT * FROM {name}_a QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY aic, lags) = 1),
{name}_o AS (SELECT {name}_d.* EXCLUDE (most), lags FROM {name}_d JOIN {name}_b USING ({keys}))"""
        + gram(f"{name}_h", f"{name}_o", "lags", "lags")
        + swept(f"{name}_v", f"{name}_h", "n, lags")
        + f""", {name}_t AS (SELECT {keys}, CAST(lags AS INTEGER) AS lags, n - 1 - lags AS nobs, m[2][k] / sqrt(m[k][k] / (n - 1 - lags - (lags + 2)) * m[2][2]) AS adf_stat FROM {name}_v WHERE p = k - 1),
{name}_u AS (SELECT *, CASE WHEN adf_stat <= -1.61 THEN 2.1659 + 1.4412 * adf_stat + 0.038269 * adf_stat ** 2
                            ELSE 1.7339 + 0.93202 * adf_stat - 0.12745 * adf_stat ** 2 - 0.010368 * adf_stat ** 3 END AS y FROM {name}_t),
{name}_z AS (SELECT *, least(greatest(y, -8), 8) AS z FROM {name}_u),
{name}_q AS (SELECT *, 0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(121), lambda k: sign(z) * exp((2 * k + 1) * ln(greatest(abs(z), 1e-300))
    - list_sum(list_transform(range(k + 1), lambda j: ln(2 * j + 1))))) ) AS phi FROM {name}_z),
{name} AS (SELECT {keys}, adf_stat, CASE WHEN adf_stat > 2.74 THEN 1.0 WHEN adf_stat < -18.83 THEN 0.0 ELSE round(least(greatest(phi, 0), 1), 12) END AS p_value, lags, CAST(nobs AS INTEGER) AS nobs,
  -3.43035 - 6.5393 / nobs - 16.786 / nobs ** 2 - 79.433 / nobs ** 3 AS crit_1, -2.86154 - 2.8903 / nobs - 4.234 / nobs ** 2 - 40.040 / nobs ** 3 AS crit_5,
  -2.56677 - 1.5384 / nobs - 2.809 / nobs ** 2 AS crit_10 FROM {name}_q)"""
    )


def kpss_sql(name: str, source: str, keys: str) -> str:
    """CTEs that end in ``name``: the KPSS figures of each series of ``source``."""
    dot = "list_inner_product(e[k + 1 : n], e[1 : n - k])"
    return f""", {name}_s AS (SELECT {keys}, list(value ORDER BY period) AS v, CAST(count(value) AS INTEGER) AS n, avg(value) AS mean FROM {source} WHERE value IS NOT NULL GROUP BY {keys}),
{name}_e AS (SELECT {keys}, n, list_transform(v, lambda y: y - mean) AS e FROM {name}_s),
{name}_f AS (SELECT *, list_inner_product(e, e) AS s, CAST(floor(pow(n, 2.0 / 9)) AS INTEGER) AS firsts FROM {name}_e),
{name}_r AS (SELECT *, list_sum(list_transform(range(1, firsts + 1), lambda k: {dot})) AS plain, list_sum(list_transform(range(1, firsts + 1), lambda k: k * {dot})) AS graded FROM {name}_f),
{name}_l AS (SELECT *, CAST(least(floor(1.1447 * pow(pow(2 * graded / (s + 2 * plain), 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS INTEGER) AS lags FROM {name}_r),
{name}_v AS (SELECT *, (s + 2 * coalesce(list_sum(list_transform(range(1, lags + 1), lambda k: (1 - k / (lags + 1.0)) * {dot})), 0)) / n AS variance,
  list_sum(list_transform(range(1, n + 1), lambda t: list_sum(e[1 : t]) ** 2)) / (n * n) AS eta FROM {name}_l),
{name}_k AS (SELECT {keys}, eta / variance AS kpss_stat, lags FROM {name}_v),
{name} AS (SELECT {keys}, kpss_stat, CASE WHEN kpss_stat <= 0.347 THEN 0.10 WHEN kpss_stat <= 0.463 THEN 0.10 + (kpss_stat - 0.347) / 0.116 * -0.05
  WHEN kpss_stat <= 0.574 THEN 0.05 + (kpss_stat - 0.463) / 0.111 * -0.025 WHEN kpss_stat <= 0.739 THEN 0.025 + (kpss_stat - 0.574) / 0.165 * -0.015 ELSE 0.01 END AS p_value, lags FROM {name}_k)"""


R = "WITH RECURSIVE " + FACT_CTE + "\n" + MONTHLY
ADF_SAYS = """CASE WHEN p_value < 0.01 THEN 'Highly stationary (p < 0.01)' WHEN p_value < 0.05 THEN 'Stationary (p < 0.05)'
  WHEN p_value < 0.10 THEN 'Weakly stationary (p < 0.10)' ELSE 'Non-stationary (p >= 0.10)' END"""
KPSS_SAYS = """CASE WHEN p_value > 0.10 THEN 'Stationary (p > 0.10)' WHEN p_value > 0.05 THEN 'Likely stationary (p > 0.05)'
  WHEN p_value > 0.01 THEN 'Weakly stationary (p > 0.01)' ELSE 'Non-stationary (p <= 0.01)' END"""
#: Every series as it is, and differenced once and twice.
VERSIONS = """, v1 AS (SELECT store, period, value - lag(value) OVER (PARTITION BY store ORDER BY period) AS value FROM ms QUALIFY row_number() OVER (PARTITION BY store ORDER BY period) > 1),
v2 AS (SELECT store, period, value - lag(value) OVER (PARTITION BY store ORDER BY period) AS value FROM v1 QUALIFY row_number() OVER (PARTITION BY store ORDER BY period) > 1),
versions AS (SELECT store, 0 AS d, period, value FROM ms UNION ALL SELECT store, 1, period, value FROM v1 UNION ALL SELECT store, 2, period, value FROM v2)"""
ORDER = """, orders AS (SELECT store, min(d) FILTER (WHERE p_value < 0.05) AS first, count(*) AS orders_tested FROM adf GROUP BY store),
chosen AS (SELECT store, CAST(coalesce(first, 2) AS INTEGER) AS d, first IS NOT NULL AS is_stationary FROM orders)"""
P4 = {"p_value": 4, "adf_stat": 4, "crit_1": 4, "crit_5": 4, "crit_10": 4, "kpss_stat": 4}


@register(
    "ts_adf",
    R + adf_sql("adf", "ms", "store")
    + f""" SELECT store, round(adf_stat, 4) AS adf_stat, round(p_value, 4) AS p_value, lags, nobs, round(crit_1, 4) AS crit_1, round(crit_5, 4) AS crit_5, round(crit_10, 4) AS crit_10,
       p_value < 0.05 AS is_stationary, {ADF_SAYS} AS interpretation FROM adf""",
)
def q_ts_adf(spark, sf):
    return rnd(st.adf_test(monthly(spark, sf), K), overrides=P4)


@register(
    "ts_kpss",
    R + kpss_sql("kpss", "ms", "store")
    + f""" SELECT store, round(kpss_stat, 4) AS kpss_stat, round(p_value, 4) AS p_value, lags, p_value > 0.05 AS is_stationary, {KPSS_SAYS} AS interpretation FROM kpss""",
)
def q_ts_kpss(spark, sf):
    return rnd(st.kpss_test(monthly(spark, sf), K), overrides=P4)


@register(
    "ts_residual_acf",
    W + MONTHLY
    + """, f AS (SELECT store, period, value - lag(value, 12) OVER (PARTITION BY store ORDER BY period) AS residual, row_number() OVER (PARTITION BY store ORDER BY period) AS i FROM ms),
g AS (SELECT store, period, residual FROM f WHERE i > 12),
e AS (SELECT store, list(residual - mean ORDER BY period) AS e, CAST(count(*) AS INTEGER) AS n FROM g JOIN (SELECT store, avg(residual) AS mean FROM g GROUP BY store) USING (store) GROUP BY store),
r AS (SELECT store, n, CAST(unnest(range(1, 11)) AS INTEGER) AS lag, e FROM e),
c AS (SELECT store, n, lag, coalesce(list_inner_product(e[lag + 1 : n], e[1 : n - lag]), 0) / list_inner_product(e, e) AS r FROM r WHERE n > 10),
q AS (SELECT store, n * (n + 2) * sum(r * r / (n - lag)) AS q FROM c GROUP BY store, n)
SELECT store, lag, round(r, 4) AS r, round(q, 4) AS q, round(exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24), 4) AS p_value, n FROM c JOIN q USING (store)""",
)
def q_ts_residual_acf(spark, sf):
    """Residuals of the forecast that a month is as it was twelve before."""
    m = win.seasonal_difference(monthly(spark, sf), 12, keys=K, out="residual").select("store", "period", "residual")
    out = lagged.residual_autocorrelation(m, K)
    return rnd(out.where("n > 10"), 4)


def _powers(table, r: str) -> str:
    top, bottom = (" + ".join(f"{c!r} * pow({r}, {i})" for i, c in enumerate(part)) for part in table)
    return f"({top}) / ({bottom})"


#: From ``g`` (store, e, n, r: residuals about their mean, their count and rank) to ``o`` (store, n, w_stat, p_value).
FRANCIA = f"""s AS (SELECT *, (r - 0.375) / (n + 0.25) AS p, (r - 0.375) / (n + 0.25) - 0.5 AS q, sqrt(-ln(least((r - 0.375) / (n + 0.25), 1 - (r - 0.375) / (n + 0.25)))) AS t FROM g),
m AS (SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {_powers(lagged.QUANTILE_MIDDLE, "(0.180625 - q * q)")}
  WHEN t <= 5 THEN sign(q) * {_powers(lagged.QUANTILE_TAIL, "(t - 1.6)")} ELSE sign(q) * {_powers(lagged.QUANTILE_FAR, "(t - 5)")} END AS m FROM s),
w AS (SELECT store, count(*) AS n, CASE WHEN max(e) > min(e) THEN sum(m * e) ** 2 / (sum(m * m) * sum(e * e)) END AS w_stat FROM m GROUP BY store),
u AS (SELECT *, (ln(1 - w_stat) - (-1.2725 + 1.0521 * (ln(ln(n)) - ln(n)))) / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))) AS y FROM w WHERE n >= 5),
z AS (SELECT *, least(greatest(y, -8), 8) AS z FROM u),
o AS (SELECT store, n, w_stat, 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(121), lambda k: sign(z) * exp((2 * k + 1) * ln(greatest(abs(z), 1e-300))
    - list_sum(list_transform(range(k + 1), lambda j: ln(2 * j + 1)))))) AS p_value FROM z)"""


@register(
    "ts_residual_normality",
    W + MONTHLY
    + """, f AS (SELECT store, value - lag(value, 12) OVER (PARTITION BY store ORDER BY period) AS v, row_number() OVER (PARTITION BY store ORDER BY period) AS i FROM ms),
g AS (SELECT store, v - avg(v) OVER (PARTITION BY store) AS e, count(*) OVER (PARTITION BY store) AS n, row_number() OVER (PARTITION BY store ORDER BY v) AS r FROM f WHERE i > 12),
"""
    + FRANCIA
    + """
SELECT store, n, round(w_stat, 4) AS w_stat, round(least(greatest(p_value, 0), 1), 4) AS p_value, p_value > 0.05 AS is_normal FROM o""",
)
def q_ts_residual_normality(spark, sf):
    """The same residuals: are they normal?"""
    m = win.seasonal_difference(monthly(spark, sf), 12, keys=K, out="residual").select("store", "period", "residual")
    return rnd(lagged.residual_normality(m, K).where("n >= 5"), 4)


@register(
    "ts_var_ratio",
    W
    + MONTHLY
    + """, h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY store ORDER BY period) <= floor(count(*) OVER (PARTITION BY store) / 2) THEN 1 ELSE 2 END AS half FROM ms),
g AS (SELECT store, var_samp(value) FILTER (WHERE half = 1) AS vf, var_samp(value) FILTER (WHERE half = 2) AS vs FROM h GROUP BY store),
r AS (SELECT store, CASE WHEN vf > 0 THEN vs / vf ELSE 1.0 END AS variance_ratio FROM g)
SELECT store, round(variance_ratio, 6) AS variance_ratio,
       CAST(CASE WHEN abs(variance_ratio - 1) < 0.3 THEN 0.01 WHEN abs(variance_ratio - 1) < 0.5 THEN 0.05 ELSE 0.1 END AS DOUBLE) AS p_value,
       abs(variance_ratio - 1) < 0.5 AS is_stationary,
       CASE WHEN abs(variance_ratio - 1) < 0.3 THEN 'Likely stationary (variance stable)'
            WHEN abs(variance_ratio - 1) < 0.5 THEN 'Possibly stationary (variance moderately stable)'
            ELSE 'Likely non-stationary (variance unstable)' END AS interpretation FROM r""",
)
def q_ts_var_ratio(spark, sf):
    return rnd(st.variance_ratio(monthly(spark, sf), K), dp=6, exclude=("p_value",))


VR = """, h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY store ORDER BY period) <= floor(count(*) OVER (PARTITION BY store) / 2) THEN 1 ELSE 2 END AS half FROM ms),
hg AS (SELECT store, var_samp(value) FILTER (WHERE half = 1) AS vf, var_samp(value) FILTER (WHERE half = 2) AS vs FROM h GROUP BY store),
vr AS (SELECT store, CASE WHEN vf > 0 THEN vs / vf ELSE 1.0 END AS variance_ratio FROM hg)"""


@register(
    "ts_consensus",
    R + adf_sql("adf", "ms", "store") + kpss_sql("kpss", "ms", "store") + VR
    + """, j AS (SELECT store, adf.p_value < 0.05 AS adf_stationary, adf.p_value AS adf_p, kpss.p_value > 0.05 AS kpss_stationary, kpss.p_value AS kpss_p,
  abs(variance_ratio - 1) < 0.5 AS vr_stationary, variance_ratio FROM adf JOIN kpss USING (store) JOIN vr USING (store)),
t AS (SELECT *, CAST(adf_stationary AS INTEGER) + CAST(kpss_stationary AS INTEGER) + CAST(vr_stationary AS INTEGER) AS votes FROM j)
SELECT store, adf_stationary, round(adf_p, 4) AS adf_p, kpss_stationary, round(kpss_p, 4) AS kpss_p, vr_stationary, round(variance_ratio, 4) AS variance_ratio, votes, votes >= 2 AS consensus_stationary,
  votes || '/3' AS test_agreement, CASE WHEN votes >= 2 THEN 'CONSENSUS: Series is STATIONARY (' || votes || '/3 tests agree)' ELSE 'MIXED RESULTS: (' || votes || '/3 tests say stationary)' END AS summary FROM t""",
)
def q_ts_consensus(spark, sf):
    return rnd(st.consensus(monthly(spark, sf), K), 4)


@register(
    "ts_order_d",
    R + VERSIONS + adf_sql("adf", "versions", "store, d") + ORDER
    + """ SELECT store, d, is_stationary, CASE WHEN is_stationary THEN 'Series becomes stationary at d=' || d ELSE 'Series not fully stationary even at d=' || d || ' (reached max_d)' END AS explanation,
  'Use d=' || d || ' in ARIMA(p, ' || d || ', q)' AS recommendation FROM chosen""",
)
def q_ts_order_d(spark, sf):
    return st.differencing_order(monthly(spark, sf), K, 2, "adf")


@register(
    "ts_validate_diff",
    W
    + MONTHLY
    + """, d AS (SELECT store, value - lag(value) OVER (PARTITION BY store ORDER BY period) AS value,
       row_number() OVER (PARTITION BY store ORDER BY period) AS rn FROM ms),
dd AS (SELECT * FROM d WHERE rn > 1),
o AS (SELECT store, count(value) AS original_length, avg(value) AS original_mean, stddev_samp(value) AS original_std, var_samp(value) AS ov FROM ms GROUP BY store),
x AS (SELECT store, count(*) AS differenced_length, count(*) FILTER (WHERE value IS NULL) AS nn, avg(value) AS differenced_mean,
      stddev_samp(value) AS differenced_std, var_samp(value) AS dv FROM dd GROUP BY store)
SELECT store, original_length, round(original_mean, 2) AS original_mean, round(original_std, 2) AS original_std, differenced_length,
       round(differenced_mean, 2) AS differenced_mean, round(differenced_std, 2) AS differenced_std, original_length - 1 = differenced_length AS order_correct,
       nn = 0 AS no_nans, abs(differenced_mean) < abs(original_mean) AS mean_near_zero, dv < ov AS variance_reduced,
       original_length - 1 = differenced_length AND nn = 0 AS is_valid FROM o JOIN x USING (store)""",
)
def q_ts_validate_diff(spark, sf):
    m = monthly(spark, sf)
    d = win.difference(m, 1, keys=K, out="__d").select(*K, "period", F.col("__d").alias("value"))
    return rnd(st.validate_differencing(m, d, 1, K))


@register(
    "ts_prepare",
    W + MONTHLY + PREP_CTE + """, s AS (SELECT * FROM filled),""" + VALIDATE_BODY,
)
def q_ts_prepare(spark, sf):
    _, validation = ts.prepare(sales_fact(spark, sf), "MS", K)
    return rnd(validation)


@register(
    "ts_prepare_stat",
    R + VERSIONS + adf_sql("adf", "versions", "store, d") + ORDER
    + """, prepared AS (SELECT store, period, value - lag(value, 12) OVER (PARTITION BY store ORDER BY period) AS value FROM versions JOIN chosen USING (store, d)
  QUALIFY row_number() OVER (PARTITION BY store ORDER BY period) > 12)"""
    + adf_sql("after", "prepared", "store")
    + """ SELECT store, chosen.d, round(adf.p_value, 4) AS original_p_value, adf.p_value < 0.05 AS original_stationary, round("after".p_value, 4) AS final_p_value, "after".p_value < 0.05 AS is_ready,
  true AS seasonal_differencing, 12 AS seasonal_period FROM chosen LEFT JOIN (SELECT * FROM adf WHERE d = 0) AS adf USING (store) LEFT JOIN "after" USING (store)""",
)
def q_ts_prepare_stat(spark, sf):
    _, report = st.prepare_stationary(monthly(spark, sf), K, 2, apply_seasonal=True, seasonal_period=12)
    return rnd(report, 4)


@register(
    "ts_compare_stat",
    R + VERSIONS + adf_sql("adf", "versions", "store, d")
    + """, o AS (SELECT store, count(value) AS original_length, avg(value) AS original_mean, stddev_samp(value) AS original_std FROM ms GROUP BY store),
x AS (SELECT store, count(*) AS differenced_length, avg(value) AS differenced_mean, stddev_samp(value) AS differenced_std FROM v1 GROUP BY store),
a AS (SELECT * FROM adf WHERE d = 0), b AS (SELECT * FROM adf WHERE d = 1)
SELECT store, round(a.adf_stat, 4) AS adf_before, round(a.p_value, 4) AS p_before, round(b.adf_stat, 4) AS adf_after, round(b.p_value, 4) AS p_after,
  original_length, round(original_mean, 4) AS original_mean, round(original_std, 4) AS original_std, differenced_length, round(differenced_mean, 4) AS differenced_mean, round(differenced_std, 4) AS differenced_std,
  original_length - 1 = differenced_length AS order_correct, true AS no_nans, abs(differenced_mean) < abs(original_mean) AS mean_near_zero, differenced_std < original_std AS variance_reduced,
  original_length - 1 = differenced_length AS is_valid, 1 AS d_order, b.p_value < a.p_value AS p_value_improved, b.adf_stat < a.adf_stat AS statistic_improved, a.p_value >= 0.05 AND b.p_value < 0.05 AS became_stationary
FROM a JOIN b USING (store) JOIN o USING (store) JOIN x USING (store)""",
)
def q_ts_compare_stat(spark, sf):
    m = monthly(spark, sf)
    d = win.difference(m, 1, keys=K, out="__d").select(*K, "period", F.col("__d").alias("value"))
    return rnd(st.compare_before_after(m, d, 1, K), 4)


@register(
    "ts_recommend_arima",
    R + VERSIONS + adf_sql("adf", "versions", "store, d") + ORDER
    + """ SELECT store, 1 AS p, d, 1 AS q, 1 AS seasonal_p, 0 AS seasonal_d, 1 AS seasonal_q, 12 AS seasonal_s, 'ARIMA(1,' || d || ',1)' AS recommended_order,
  'SARIMA(1,' || d || ',1)(1,0,1,12)' AS recommended_seasonal_order FROM chosen""",
)
def q_ts_recommend_arima(spark, sf):
    return st.recommend_arima(monthly(spark, sf), K)


#: Order (1, 1, 1) of every store, to ``fit``: long autoregression by recursion, the two coefficients by Cramer's rule.
ARIMA_111 = """, ia AS (SELECT store, list(value ORDER BY period) AS x, CAST(count(*) AS INTEGER) AS n, max(period) AS last FROM ms GROUP BY store),
iw AS (SELECT *, n - 1 AS size, list_transform(range(1, n), lambda i: x[i + 1] - x[i]) AS w FROM ia WHERE n > 1),
iz AS (SELECT *, sqrt(list_inner_product(w, w) / size) AS scale, CAST(least(size // 3, greatest(1, ceil(10 * log10(size)))) AS INTEGER) AS long FROM iw),
ir AS (SELECT * EXCLUDE (w), list_transform(w, lambda v: v / scale) AS z FROM iz WHERE size - long - 1 > 3),
il AS (SELECT *, list_transform(range(0, long + 1), lambda k: list_inner_product(z[k + 1 : size], z[1 : size - k])) AS r FROM ir),
lev AS (SELECT store, r, long, 0 AS k, CAST([] AS DOUBLE[]) AS phi, r[1] AS v FROM il
  UNION ALL SELECT store, r, long, k + 1, CASE WHEN k = 0 THEN [a] ELSE list_append(list_transform(range(1, k + 1), lambda i: phi[i] - a * phi[k + 1 - i]), a) END, v * (1 - a * a)
  FROM (SELECT *, (r[k + 2] - CASE WHEN k = 0 THEN 0 ELSE list_inner_product(phi, list_reverse(r[2 : k + 1])) END) / v AS a FROM lev WHERE k < long)),
ie AS (SELECT il.*, list_transform(range(long, size), lambda t: z[t + 1] - list_inner_product(phi, list_reverse(z[t - long + 1 : t]))) AS e
  FROM il JOIN (SELECT store, phi FROM lev WHERE k = long) USING (store)),
ic AS (SELECT *, size - long - 1 AS rows, z[long + 2 : size] AS y, z[long + 1 : size - 1] AS c1, e[1 : size - long - 1] AS c2 FROM ie),
ig AS (SELECT *, list_inner_product(c1, c1) AS aa, list_inner_product(c2, c2) AS mm, list_inner_product(c1, c2) AS am, list_inner_product(c1, y) AS ay, list_inner_product(c2, y) AS my FROM ic),
ib AS (SELECT *, (ay * mm - my * am) / (aa * mm - am * am) AS ar, (my * aa - ay * am) / (aa * mm - am * am) AS ma FROM ig),
il2 AS (SELECT *, list_transform(range(1, rows + 1), lambda i: (y[i] - ar * c1[i] - ma * c2[i]) * scale) AS resid FROM ib),
fit AS (SELECT *, list_inner_product(resid, resid) / rows AS sigma2 FROM il2)"""
ORDER_111 = "1 AS p, 1 AS d, 1 AS q, 0 AS sp, 0 AS sd, 0 AS sq, 0 AS s"


@register(
    "fc_arima",
    R + ARIMA_111
    + f""", st AS (SELECT *, CAST(unnest(range(1, 13)) AS INTEGER) AS step FROM fit),
sf AS (SELECT store, last, step, x[n] + scale * (ar * z[size] + ma * e[size - long]) * list_sum(list_transform(range(0, step), lambda i: pow(ar, i))) AS f,
  sqrt(sigma2 * list_sum(list_transform(range(0, step), lambda j: pow(1 + (ar + ma) * coalesce(list_sum(list_transform(range(0, j), lambda i: pow(ar, i))), 0), 2)))) AS se FROM st)
SELECT store, {ORDER_111}, step, CAST(last + to_months(step) AS DATE) AS period, round(f, 2) AS forecast, round(f - 1.96 * se, 2) AS lower_ci, round(f + 1.96 * se, 2) AS upper_ci,
  round(2 * 1.96 * se, 2) AS ci_width, 'fitted' AS status FROM sf
UNION ALL SELECT store, {ORDER_111}, NULL, NULL, NULL, NULL, NULL, NULL, 'not fitted: series too short for this order' FROM ia WHERE store NOT IN (SELECT store FROM fit)""",
)
def q_fc_arima(spark, sf):
    return rnd(arima.forecast(monthly(spark, sf), 12, K, order=(1, 1, 1)), 2)


@register("fc_sarima")
def q_fc_sarima(spark, sf):
    return arima.sarima_forecast(monthly(spark, sf), 12, K)


@register("fc_auto_arima")
def q_fc_auto_arima(spark, sf):
    return arima.auto_order(monthly(spark, sf), K)


@register(
    "fc_compare",
    R + ARIMA_111
    + """, cand AS (SELECT unnest([{'p': 0, 'q': 1}, {'p': 1, 'q': 0}, {'p': 1, 'q': 1}, {'p': 2, 'q': 1}, {'p': 1, 'q': 2}], recursive := true)),
cc AS (SELECT store, p, q, p + q + 1 AS k, size - long - 2 AS rows, scale, list_concat(list_concat(list_transform(range(1, p + 1), lambda l: z[long + 3 - l : size - l]),
  list_transform(range(1, q + 1), lambda l: e[3 - l : size - l - long])), [z[long + 3 : size]]) AS c FROM ie, cand WHERE size - long - 2 > p + q + 1),
cw AS (SELECT store, p, q, k, rows, scale, 0 AS swept, list_transform(c, lambda a: list_transform(c, lambda b: list_inner_product(a, b))) AS m FROM cc
  UNION ALL SELECT store, p, q, k, rows, scale, swept + 1, list_transform(range(1, k + 1), lambda i: list_transform(range(1, k + 1), lambda j:
    CASE WHEN i = swept + 1 AND j = swept + 1 THEN 1 / m[swept + 1][swept + 1] WHEN i = swept + 1 THEN m[swept + 1][j] / m[swept + 1][swept + 1]
         WHEN j = swept + 1 THEN -m[i][swept + 1] / m[swept + 1][swept + 1] ELSE m[i][j] - m[i][swept + 1] * m[swept + 1][j] / m[swept + 1][swept + 1] END)) FROM cw WHERE swept < k - 1),
cs AS (SELECT *, m[k][k] / rows * scale * scale AS sigma2, rows * (ln(2 * pi() * m[k][k] / rows * scale * scale) + 1) AS dev FROM cw WHERE swept = k - 1),
ca AS (SELECT store, p, q, sigma2, rows, dev + 2 * k AS aic, dev + ln(rows) * k AS bic FROM cs),
cf AS (SELECT ia.store, cand.p, cand.q, sigma2, rows, aic, bic FROM ia CROSS JOIN cand LEFT JOIN ca ON ca.store = ia.store AND ca.p = cand.p AND ca.q = cand.q)
SELECT store, p, 1 AS d, q, 0 AS sp, 0 AS sd, 0 AS sq, 0 AS s, round(aic, 4) AS aic, round(bic, 4) AS bic, round(sigma2, 2) AS sigma2, CAST(rows AS INTEGER) AS nobs, aic IS NOT NULL AS converged,
  CASE WHEN aic IS NULL THEN 'not fitted: series too short for this order' ELSE 'fitted' END AS status,
  CASE WHEN aic IS NOT NULL THEN CAST(rank() OVER (PARTITION BY store ORDER BY aic NULLS LAST, p, q) AS INTEGER) END AS aic_rank,
  CASE WHEN aic IS NOT NULL THEN CAST(rank() OVER (PARTITION BY store ORDER BY bic NULLS LAST, p, q) AS INTEGER) END AS bic_rank FROM cf""",
)
def q_fc_compare(spark, sf):
    return rnd(arima.compare_orders(monthly(spark, sf), K).drop("ar", "ma"), 4, overrides={"sigma2": 2})


@register(
    "fc_diagnostics",
    R + ARIMA_111
    + """, dm AS (SELECT store, rows AS n, list_sum(resid) / rows AS mean, resid FROM fit),
dc AS (SELECT *, list_transform(resid, lambda v: v - mean) AS c FROM dm),
dd AS (SELECT *, list_inner_product(c, c) AS ss, list_sum(list_transform(c, lambda v: pow(v, 3))) / n AS m3, list_sum(list_transform(c, lambda v: pow(v, 4))) / n AS m4 FROM dc),
dq AS (SELECT *, CASE WHEN n > 10 THEN n * (n + 2) * list_sum(list_transform(range(1, 11), lambda k: pow(list_inner_product(c[k + 1 : n], c[1 : n - k]) / ss, 2) / (n - k))) END AS lb,
  n / 6.0 * (m3 * m3 / pow(ss / n, 3) + pow(m4 / pow(ss / n, 2) - 3, 2) / 4) AS jb FROM dd),
g AS (SELECT store, n, e, row_number() OVER (PARTITION BY store ORDER BY e) AS r FROM (SELECT store, n, unnest(c) AS e FROM dc)),
"""
    + FRANCIA
    + f""", dv AS (SELECT store, mean, sqrt(ss / dq.n) AS dev, lb, exp(-lb / 2) * (1 + lb / 2 + pow(lb / 2, 2) / 2 + pow(lb / 2, 3) / 6 + pow(lb / 2, 4) / 24) AS lp, jb, w_stat, p_value FROM dq LEFT JOIN o USING (store))
SELECT store, {ORDER_111}, round(mean, 4) AS resid_mean, round(dev, 4) AS resid_std, round(lb, 4) AS ljung_box_q, round(lp, 4) AS ljung_box_p, round(jb, 4) AS jarque_bera, round(exp(-jb / 2), 4) AS jarque_bera_p,
  round(w_stat, 4) AS w_stat, round(least(greatest(p_value, 0), 1), 4) AS w_p, 'fitted' AS status, abs(mean) < 0.1 * dev AS mean_ok, lp > 0.05 AS no_autocorrelation, p_value > 0.05 AS normal_residuals,
  abs(mean) < 0.1 * dev AND lp > 0.05 AS passed FROM dv
UNION ALL SELECT store, {ORDER_111}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not fitted: series too short for this order', NULL, NULL, NULL, NULL FROM ia WHERE store NOT IN (SELECT store FROM fit)""",
)
def q_fc_diagnostics(spark, sf):
    return rnd(arima.diagnostics(monthly(spark, sf), K, order=(1, 1, 1)), 4)


@register("fc_arima_holdout")
def q_fc_arima_holdout(spark, sf):
    return arima.holdout_evaluation(monthly(spark, sf), K, order=(1, 1, 1))


@register("dq_arima_order")
def q_dq_arima_order(spark, sf):
    return dq.arima_order_range(arima.auto_order(monthly(spark, sf), K))


@register("fc_arima_workflow")
def q_fc_arima_workflow(spark, sf):
    """Refit-on-all forecast of the split → evaluate → refit → forecast → diagnose workflow, with each series'
    test accuracy and diagnostic verdict attached to its forecast rows."""
    parts = arima.train_evaluate_forecast(monthly(spark, sf), K, order=(1, 1, 1))
    m = parts["test_metrics"].select(*K, F.col("rmse").alias("test_rmse"), F.col("mape").alias("test_mape"))
    d = parts["diagnostics"].select(*K, F.col("passed").alias("diagnostics_passed"))
    return parts["forecast"].join(m, K, "left").join(d, K, "left")
