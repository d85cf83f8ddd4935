"""Property tests for the per-series kernels and their Spark wrappers (no SQL oracle exists for them)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import arima, quality as dq, stationarity as st


def _monthly(spark, series: dict[str, np.ndarray]):
    rows = []
    for k, ys in series.items():
        for i, y in enumerate(ys):
            rows.append((k, dt.date(2010 + i // 12, i % 12 + 1, 1), float(y)))
    return spark.createDataFrame(rows, "sid string, period date, value double")


@pytest.fixture(scope="module")
def sims():
    rng = np.random.default_rng(7)
    n = 96
    noise = rng.normal(0, 1, n) + 50
    walk = np.cumsum(rng.normal(0, 1, n)) + 50
    ar = np.zeros(n)
    e = rng.normal(size=n)
    for t in range(1, n):
        ar[t] = 0.7 * ar[t - 1] + e[t]
    seasonal = np.array([200 + 40 * np.sin(2 * np.pi * i / 12) + 0.5 * i + rng.normal(0, 3) for i in range(n)])
    return {"noise": noise, "walk": walk, "ar": ar + 100, "seasonal": seasonal}


def test_adf_separates_noise_from_walk(spark, sims):
    p = {r.sid: r.p_value for r in st.adf_test(_monthly(spark, sims), ["sid"]).collect()}
    assert p["noise"] < 0.01 and p["walk"] > 0.10


def test_kpss_and_adf_size_and_power(spark):
    """Rejection rates at the 5 % level over 200 simulated series of length 96."""
    series = {}
    for seed in range(200):
        r = np.random.default_rng(seed)
        series[f"n{seed}"], series[f"w{seed}"] = r.normal(size=96), np.cumsum(r.normal(size=96))
    df = _monthly(spark, series)
    kpss = {r.sid: r.p_value < 0.05 for r in st.kpss_test(df, ["sid"]).collect()}
    adf = {r.sid: r.p_value < 0.05 for r in st.adf_test(df, ["sid"]).collect()}
    rate = lambda got, kind: sum(v for k, v in got.items() if k[0] == kind) / 200
    assert rate(kpss, "n") < 0.10 and rate(kpss, "w") > 0.6 and rate(adf, "w") < 0.10


def by_two_regressions(y, p, d, q, first=None):
    """(ar, ma, sigma2, rows, forecasts of twelve steps, their errors) by numpy's least squares and Toeplitz systems."""
    w = np.diff(y, d)
    mu = w.mean() if d == 0 else 0.0
    z, n = w - mu, len(w)
    long = min(n // 3, max(p, q, math.ceil(10 * math.log10(n)))) if q else 0
    r = [z[k:] @ z[: n - k] for k in range(long + 1)]
    phi = np.linalg.solve([[r[abs(i - j)] for j in range(long)] for i in range(long)], r[1:]) if q else np.zeros(0)
    e = np.array([z[t] - sum(phi[j] * z[t - 1 - j] for j in range(long)) for t in range(long, n)])
    first = max(p, long + q if q else 0) if first is None else first
    x = np.array([[z[t - i] for i in range(1, p + 1)] + [e[t - i - long] for i in range(1, q + 1)] for t in range(first, n)])
    b = np.linalg.lstsq(x, z[first:], rcond=None)[0] if p + q else np.zeros(0)
    left = z[first:] - (x @ b if p + q else 0)
    s2 = left @ left / len(left)
    ahead, psi = list(z), [1.0]
    for h in range(1, 13):
        ahead.append(sum(b[i] * ahead[-1 - i] for i in range(p)) + sum(b[p + i] * e[h - i - 2] for i in range(h - 1, q)))
        psi.append(sum(b[i] * psi[h - 1 - i] for i in range(min(p, h))) + (b[p + h - 1] if h <= q else 0))
    out, weights = np.array(ahead[n:]) + mu, np.array(psi[:12])
    for k in range(d, 0, -1):
        out, weights = np.diff(y, k - 1)[-1] + np.cumsum(out), np.cumsum(weights)
    return b[:p], b[p:], s2, len(left), out, np.sqrt(s2 * np.cumsum(weights**2))


@pytest.mark.parametrize("order", [(0, 0, 0), (1, 0, 0), (2, 1, 0), (0, 1, 1), (1, 1, 1), (2, 0, 2), (1, 2, 3)])
def test_fit_and_forecast_against_least_squares(spark, sims, order):
    df = _monthly(spark, sims)
    fits = {r.sid: r for r in arima.fit(df, ["sid"], order).collect()}
    fc = {}
    for r in arima.forecast(df, 12, ["sid"], order).orderBy("step").collect():
        fc.setdefault(r.sid, []).append(r)
    for sid, y in sims.items():
        ar, ma, s2, rows, points, errors = by_two_regressions(y, *order)
        assert fits[sid].ar == pytest.approx(ar, abs=1e-6) and fits[sid].ma == pytest.approx(ma, abs=1e-6)
        assert fits[sid].sigma2 == pytest.approx(s2, rel=1e-8) and fits[sid].nobs == rows
        assert [r.forecast for r in fc[sid]] == pytest.approx(points, rel=1e-7)
        assert [r.ci_width for r in fc[sid]] == pytest.approx(2 * 1.96 * errors, rel=1e-6)


def test_seasonal_lags_and_own_horizons(spark, sims):
    y = sims["seasonal"]
    r = arima.fit(_monthly(spark, {"s": y}), ["sid"], (1, 0, 0), (1, 1, 0, 12)).first()
    w = y[12:] - y[:-12]
    x = np.column_stack([w[13 - k : len(w) - k] for k in (1, 12, 13)])
    assert r.ar == pytest.approx(np.linalg.lstsq(x, w[13:], rcond=None)[0], abs=1e-7)
    df = _monthly(spark, {"a": y, "b": y[:50]}).withColumn("h", F.when(F.col("sid") == "a", 2).otherwise(5))
    assert {r.sid: r["count"] for r in arima.forecast(df, 1, ["sid"], steps_col="h").groupBy("sid").count().collect()} == {"a": 2, "b": 5}
    one = arima.forecast(df.where("sid = 'a'").drop("sid"), 2).collect()
    assert [r.forecast for r in one] == pytest.approx([r.forecast for r in arima.forecast(df.where("sid = 'a'"), 2, ["sid"]).collect()])


def test_flat_exact_and_broken_series(spark):
    some = {"flat": np.full(40, 7.0), "line": np.arange(40) * 2.0 + 1}
    fc = arima.forecast(_monthly(spark, some), 2, ["sid"]).orderBy("sid", "step").collect()
    assert [r.forecast for r in fc] == pytest.approx([7, 7, 81, 83]) and all(r.ci_width == 0 and r.status == "fitted" for r in fc)
    best = {r.sid: r for r in arima.auto_order(_monthly(spark, some), ["sid"], 1, 1, 1).collect()}
    assert best["flat"].fallback and best["flat"].orders_fitted == 0
    holes = spark.createDataFrame([("h", dt.date(2020, 1, 1), None), ("h", dt.date(2020, 2, 1), float("nan"))], "sid string, period date, value double")
    assert [r.status for r in arima.forecast(holes, 3, ["sid"]).collect()] == ["not fitted: series too short for this order"]
    assert arima.forecast(holes.limit(0), 3, ["sid"]).count() == 0 and arima.diagnostics(holes.limit(0), ["sid"]).count() == 0


def test_diagnostics_figures(spark, sims):
    r = arima.diagnostics(_monthly(spark, {"ar": sims["ar"]}), ["sid"], (1, 0, 0)).first()
    z = sims["ar"] - sims["ar"].mean()
    e = z[1:] - (z[1:] @ z[:-1]) / (z[:-1] @ z[:-1]) * z[:-1]
    n, c = len(e), e - e.mean()
    q = n * (n + 2) * sum((c[k:] @ c[:-k] / (c @ c)) ** 2 / (n - k) for k in range(1, 11))
    assert r.resid_mean == pytest.approx(e.mean()) and r.resid_std == pytest.approx(e.std()) and r.ljung_box_q == pytest.approx(q)
    jb = n / 6 * ((c**3).mean() ** 2 / (c**2).mean() ** 3 + ((c**4).mean() / (c**2).mean() ** 2 - 3) ** 2 / 4)
    assert r.jarque_bera == pytest.approx(jb) and r.jarque_bera_p == pytest.approx(math.exp(-jb / 2)) and 0.9 < r.w_stat <= 1


def test_spark_stationarity_and_consensus(spark, sims):
    df = _monthly(spark, sims)
    adf = {r.sid: r.is_stationary for r in st.adf_test(df, ["sid"]).collect()}
    assert adf["noise"] is True and adf["walk"] is False
    d = {r.sid: r.d for r in st.differencing_order(df, ["sid"], 2).collect()}
    assert d["noise"] == 0 and d["walk"] >= 1
    c = st.consensus(df, ["sid"]).collect()
    assert len(c) == 4 and all(r.test_agreement.endswith("/3") for r in c)


def test_spark_arima_forecast_invariants(spark, sims):
    df = _monthly(spark, sims)
    fc = arima.forecast(df, 12, ["sid"], order=(1, 1, 1))
    assert fc.groupBy("sid").count().where("count != 12").count() == 0
    assert dq.ci_consistency(fc, ["sid"]).count() == 0
    s = arima.sarima_forecast(df.where("sid = 'seasonal'"), 12, ["sid"])
    vals = [r.forecast for r in s.orderBy("step").collect()]
    hist = sims["seasonal"]
    # the seasonal shape is carried forward: peak month ahead ≈ peak month of the last year
    assert np.argmax(vals) == np.argmax(hist[-12:])


def test_auto_order_in_range(spark, sims):
    df = _monthly(spark, sims)
    best = arima.auto_order(df, ["sid"], 2, 2)
    assert best.count() == 4
    assert dq.arima_order_range(best).count() == 0


def test_diagnostics_on_white_noise(spark, sims):
    df = _monthly(spark, {"noise": sims["noise"]})
    r = arima.diagnostics(df, ["sid"], order=(0, 0, 0)).first()
    assert r.mean_ok and r.ljung_box_p > 0.01


def test_series_that_cannot_be_fitted_have_a_status(spark, sims):
    some = {"long": sims["ar"][:60], "two": np.array([1.0, 2.0]), "one": np.array([3.0]), "flat": np.full(40, 7.0)}
    df = _monthly(spark, some)
    fc = arima.forecast(df, 12, ["sid"], order=(1, 1, 1)).collect()
    assert {r.sid for r in fc} == set(some)
    for r in fc:
        assert (r.status == "fitted") == (r.step is not None) == (r.forecast is not None)
    assert [r.status for r in fc if r.sid in ("one", "two")] == ["not fitted: series too short for this order"] * 2
    dg = {r.sid: r.status for r in arima.diagnostics(df, ["sid"], order=(1, 1, 1)).collect()}
    assert dg.keys() == some.keys() and dg["long"] == "fitted" and dg["one"].startswith("not fitted")
    ho = {r.sid: r for r in arima.holdout_evaluation(df.where("sid <> 'flat'"), ["sid"]).collect()}
    assert ho.keys() == {"long", "two", "one"} and ho["long"].rmse is not None
    assert ho["two"].rmse is None and ho["two"].status.startswith("not fitted") and ho["one"].status.startswith("not fitted")


def test_orders_of_a_series_share_its_row(spark, sims):
    """No row, window or shuffle for each order; figures as if each were fitted alone on the shared periods."""
    df = _monthly(spark, {"ar": sims["ar"], "short": sims["ar"][:9]})
    orders = [(0, 1, 0), (1, 1, 0), (0, 1, 2), (2, 1, 1), (1, 0, 1), (3, 0, 0), (1, 1, 0)]
    grid = spark.createDataFrame([(s, *o) for s in ("ar", "short") for o in orders], "sid string, p int, d int, q int")
    fits = arima.fit(df, ["sid"], orders=grid)
    plan = arima.auto_order(df, ["sid"], 2, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    got = fits.collect()
    assert sorted((r.sid, r.p, r.d, r.q) for r in got) == sorted((s, *o) for s in ("ar", "short") for o in orders)
    n = len(sims["ar"])
    for r in (r for r in got if r.sid == "ar"):
        long = min((n - r.d) // 3, math.ceil(10 * math.log10(n - r.d)))
        ar, ma, s2, rows, _, _ = by_two_regressions(sims["ar"], r.p, r.d, r.q, long + (2 if r.d else 1))
        assert r.nobs == rows and r.sigma2 == pytest.approx(s2, rel=1e-8)
        assert r.ar == pytest.approx(ar, abs=1e-6) and r.ma == pytest.approx(ma, abs=1e-6)
    assert {r.status for r in got if r.sid == "short"} >= {"not fitted: series too short for this order"}
    one = arima.compare_orders(df.where("sid = 'ar'").drop("sid")).collect()
    each = arima.compare_orders(df.where("sid = 'ar'"), ["sid"]).collect()
    assert sorted((r.p, r.q, r.aic, r.aic_rank) for r in one) == sorted((r.p, r.q, r.aic, r.aic_rank) for r in each) and len(one) == 5
