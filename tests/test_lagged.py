"""Regressions on lags, long-run variances and tails, against plain numpy and closed forms."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import lagged
from tidecast.operators import stationarity as st


def adf_by_least_squares(x):
    n = len(x)
    most = max(0, min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25)))
    x = (x - x.mean()) / x.std()
    d = np.diff(x)

    def fit(lags, skip):
        y = d[skip:]
        cols = [np.ones(len(y)), x[skip : len(x) - 1]] + [d[skip - j : len(d) - j] for j in range(1, lags + 1)]
        a = np.column_stack(cols)
        beta = np.linalg.lstsq(a, y, rcond=None)[0]
        return beta, a, float(((y - a @ beta) ** 2).sum()), len(y)

    def aic(lags):
        _, _, left, m = fit(lags, most)
        return m * (math.log(2 * math.pi) + math.log(left / m) + 1) + 2 * (lags + 2) if m > lags + 2 else math.inf

    lags = min(range(most + 1), key=lambda j: (aic(j), j))
    beta, a, left, m = fit(lags, lags)
    return beta[1] / math.sqrt(left / (m - lags - 2) * np.linalg.inv(a.T @ a)[1, 1]), lags, m


def kpss_by_sums(x):
    n, e = len(x), x - x.mean()
    g = lambda k: float(e[k:] @ e[: n - k])
    first = int(n ** (2 / 9))
    zero, one = g(0) / n + 2 / n * sum(g(k) for k in range(1, first + 1)), 2 / n * sum(k * g(k) for k in range(1, first + 1))
    lags = min(int(1.1447 * ((one / zero) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    return (np.cumsum(e) ** 2).sum() / n**2 / ((g(0) + 2 * sum((1 - k / (lags + 1)) * g(k) for k in range(1, lags + 1))) / n), lags


def series(spark, named):
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=i), None if v is None else float(v)) for k, x in named.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "d string, period date, value double")


@pytest.fixture(scope="module")
def named():
    rng = np.random.default_rng(3)
    out = {f"noise{n}": 1e5 + 1e4 * rng.normal(size=n) for n in (8, 12, 36, 84, 300)}
    out |= {f"walk{n}": 1e7 + np.cumsum(rng.normal(size=n)) * 1e2 for n in (9, 24, 84, 300)}
    return out


def test_against_least_squares_far_from_zero(spark, named):
    df = series(spark, named)
    for r in st.adf_test(df, ["d"]).collect():
        stat, lags, m = adf_by_least_squares(named[r.d])
        assert (r.lags, r.nobs) == (lags, m) and r.adf_stat == pytest.approx(stat, rel=1e-5)
    for r in st.kpss_test(df, ["d"]).collect():
        stat, lags = kpss_by_sums(named[r.d])
        assert r.lags == lags and r.kpss_stat == pytest.approx(stat, rel=1e-8)


def test_ungrouped_is_one_series(spark, named):
    df = series(spark, {"walk84": named["walk84"]})
    one, grouped = st.adf_test(df.drop("d")).first(), st.adf_test(df, ["d"]).first()
    assert one.adf_stat == grouped.adf_stat and "d" not in one and st.kpss_test(df.drop("d")).count() == 1


def test_series_that_cannot_be_tested(spark):
    df = series(spark, {"one": [4.0], "three": [1, 2, 4], "flat": [5.0] * 30, "line": np.arange(40) * 3 + 2, "nulls": [None] * 9, "gaps": [1, None, 5, 2, float("nan"), 9, 1, 4, 4, 7]})
    adf = {r.d: (r.adf_stat, r.p_value, r.interpretation) for r in st.adf_test(df, ["d"]).collect()}
    assert all(adf[k] == (None, None, "Not testable") for k in ("one", "three", "flat", "line", "nulls"))
    assert adf["gaps"][0] is not None
    kpss = {r.d: r.kpss_stat for r in st.kpss_test(df, ["d"]).collect()}
    assert kpss["flat"] is None and kpss["nulls"] is None and kpss["gaps"] is not None
    assert st.consensus(df, ["d"]).count() == 6 and st.adf_test(df.limit(0), ["d"]).count() == 0


def test_no_python_worker(spark, named):
    df = series(spark, named)
    for out in (st.adf_test(df, ["d"]), st.kpss_test(df, ["d"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_normal_and_chi_square_tails(spark):
    z = [-9.0, -6.0, -3.0, -1.5, -0.2, 0.0, 0.7, 2.0, 4.0, 7.9, None]
    df = spark.createDataFrame([(v,) for v in z], "z double").select("z", lagged.normal_cdf(F.col("z")).alias("p"), lagged.chi_square_tail(F.abs("z") * 5, 10).alias("q"))
    for r in df.collect():
        if r.z is None:
            assert r.p is None
            continue
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=2e-15)
        x = abs(r.z) * 5
        assert r.q == pytest.approx(math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(5)), rel=1e-12)


def test_residual_autocorrelation(spark):
    rng = np.random.default_rng(8)
    e = rng.normal(size=60)
    rows = [("a", i, float(v)) for i, v in enumerate(e)] + [("flat", i, 1.0) for i in range(20)] + [("short", i, float(i % 2)) for i in range(4)] + [("a", 99, None)]
    out = lagged.residual_autocorrelation(spark.createDataFrame(rows, "k string, period int, residual double"), ["k"])
    got = {(r.k, r.lag): r for r in out.collect()}
    c = e - e.mean()
    acf = [float(c[k:] @ c[:-k]) / float(c @ c) for k in range(1, 11)]
    q = 60 * 62 * sum(r * r / (60 - k) for k, r in enumerate(acf, 1))
    assert [got["a", k].r for k in range(1, 11)] == pytest.approx(acf, rel=1e-9) and got["a", 1].q == pytest.approx(q, rel=1e-9)
    assert got["flat", 1].r is None and got["flat", 1].p_value is None and got["short", 1].r is not None


def francia(values):
    """W' and its p-value by plain sums and the standard library's normal distribution."""
    normal, x = statistics.NormalDist(), sorted(values)
    n, mean = len(x), statistics.fmean(x)
    m = [normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    w = sum(a * (b - mean) for a, b in zip(m, x)) ** 2 / (sum(a * a for a in m) * sum((b - mean) ** 2 for b in x))
    u = math.log(n)
    z = (math.log(1 - w) + 1.2725 - 1.0521 * (math.log(u) - u)) / (1.0308 - 0.26758 * (math.log(u) + 2 / u))
    return w, 1 - normal.cdf(z)


def test_normal_quantile(spark):
    at = [1e-12, 1e-6, 0.01, 0.075, 0.0751, 0.3, 0.5, 0.9, 0.925, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in at], "p double").select("p", lagged.normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(statistics.NormalDist().inv_cdf(r.p), abs=2e-6)


def test_residual_normality(spark):
    rng = np.random.default_rng(8)
    # the weights of eleven men of Shapiro and Wilk (1965): not normal at 5 %
    named = {"men": [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], "flat": [0.1] * 9, "four": [1, 2, 3, 9], "two": [1, 2], "ties": [1, 1, 1, 2, 2, 5, 5]}
    named |= {f"n{i}": rng.normal(1e6, 3, 60) for i in range(60)} | {f"e{i}": rng.exponential(5, 60) for i in range(60)}
    named["holes"] = [None, 4.0, float("nan"), 1.0, 2.5, 3.0, 8.0]
    got = {r.d: r for r in lagged.residual_normality(series(spark, named), ["d"], "value").collect()}
    for k in ("men", "ties", "n0", "n59", "e0", "e59"):
        w, p = francia([float(x) for x in named[k]])
        assert got[k].w_stat == pytest.approx(w, abs=1e-6) and got[k].p_value == pytest.approx(p, abs=1e-5)
    assert got["men"].p_value < 0.05 and not got["men"].is_normal
    assert got["flat"].w_stat is None and got["flat"].p_value is None and got["four"].p_value is None and got["two"].w_stat == pytest.approx(1)
    assert got["holes"].n == 5
    assert sum(got[f"n{i}"].is_normal for i in range(60)) >= 52 and sum(got[f"e{i}"].is_normal for i in range(60)) <= 3
    one = lagged.residual_normality(series(spark, {"men": named["men"]}).drop("d"), value="value").collect()
    assert len(one) == 1 and one[0].w_stat == pytest.approx(got["men"].w_stat)
    assert lagged.residual_normality(series(spark, {"men": []}), ["d"], "value").count() == 0


def test_lag_search_works_out_one_factor(spark, named):
    """What the lag counts share isn't named within the function that scores each of them."""
    plan = st.adf_test(series(spark, named), ["d"])._jdf.queryExecution().optimizedPlan().toString()
    scored = next(line for line in plan.split("\n") if "AS __lags#" in line)
    assert "aggregate(" not in scored.split("aic", 1)[1]


def test_order_search_and_report_against_single_tests(spark, named):
    """Versions by arrays are those of the windows; every series is gathered once."""
    rows = named | {"one": [4.0], "flat": [5.0] * 30, "nulls": [None] * 9, "short": [1, 5, 2, 9, 1, 4, 4, 7], "gaps": [None if i % 11 == 4 else v for i, v in enumerate(named["walk84"])]}
    df = series(spark, rows).withColumnRenamed("d", "k")
    prepared, report = st.prepare_stationary(df, ["k"], 2, apply_seasonal=True, seasonal_period=12)
    tests = {(r.k, r.d): r for r in st.adf_test(st.differenced_versions(df, 2, ["k"]), ["k", "d"]).collect()}
    after = {r.k: r.p_value for r in st.adf_test(prepared, ["k"]).collect()}
    order = {r.k: r for r in st.differencing_order(df, ["k"]).collect()}
    got = {r.k: r for r in report.collect()}
    assert set(got) == set(order) == set(rows)
    for k, r in got.items():
        d = next((d for d in range(3) if (k, d) in tests and tests[k, d].is_stationary), None)
        assert (order[k].d, order[k].is_stationary) == (2 if d is None else d, d is not None) and r.d == order[k].d
        assert r.original_p_value == tests[k, 0].p_value and r.original_stationary == tests[k, 0].is_stationary
        assert r.final_p_value == pytest.approx(after.get(k), rel=1e-9) if after.get(k) is not None else r.final_p_value is None and r.is_ready is None
    assert report._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    one = df.where("k = 'walk84'").drop("k")
    assert st.prepare_stationary(one, (), 2, True)[1].first().final_p_value == pytest.approx(got["walk84"].final_p_value) and st.differencing_order(one, test="kpss").count() == 1
