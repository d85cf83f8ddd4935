"""ARIMA / SARIMA fitting and forecasting for every series at once.

A series is one array on one row, with its candidate orders as another; fits, forecasts and diagnostics are expressions on such
rows (``arma``), and ``min_by(order, aic)`` picks the winner per series. A cluster works on the series in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attach import attach_row
from ..functions.numeric import safe_div
from . import arma, lagged
from .arma import FITTED
from .stationarity import differencing_order, spread

PERIOD, VALUE = "period", "value"
ORDER_COLS = ["p", "d", "q", "sp", "sd", "sq", "s"]
DEFAULT_ORDER = (1, 1, 1)


def _with_orders(series: DataFrame, keys: list[str], orders: DataFrame | None, order, seasonal) -> DataFrame:
    """Attach d, sd, s and the orders that share them, as an array: of a per-series order table, or one fixed order."""
    if orders is None:
        lits = {k: F.lit(int(v)).alias(k) for k, v in zip(ORDER_COLS, [*order, *seasonal])}
        return series.withColumns({"d": lits["d"], "sd": lits["sd"], "s": lits["s"], "__orders": F.array(F.struct(*[lits[k] for k in arma.ORDER]))})
    for c in ORDER_COLS:
        if c not in orders.columns:
            orders = orders.withColumn(c, F.lit(0))
    grids = orders.groupBy(*keys, "d", "sd", "s").agg(F.collect_list(F.struct(*arma.ORDER)).alias("__orders"))
    if keys:
        return series.join(grids, keys, "inner")
    # one ungrouped series: the (bounded) candidate lists become an array, exploded per row — no join
    return series.select("*", F.inline(grids.select(F.collect_list(F.struct("d", "sd", "s", "__orders"))).scalar()))


def _fitted(series: DataFrame, keys: list[str], order, seasonal, orders: DataFrame | None, period: str, value: str, extra: Sequence[str] = ()) -> DataFrame:
    """One row per series and order with the fit; NULL and NaN values are left out, ``extra`` columns are constant per series."""
    gkeys = keys or ["__series"]
    src = series if keys else series.withColumn("__series", F.lit(0))
    v = F.col(value).cast("double")
    held = F.collect_list(F.when(v.isNotNull() & ~F.isnan(v), F.struct(F.col(period).alias("p"), v.alias("v"))))
    rows = spread(src.select(*gkeys, period, value, *extra), gkeys).groupBy(*gkeys).agg(F.array_sort(held).alias("__held"), *[F.max(c).alias(c) for c in extra])
    rows = rows.withColumns({"__x": F.transform("__held", lambda s: s["v"]), "__n": F.size("__held"), "last_period": F.get("__held", F.size("__held") - 1)["p"]})
    return arma.fit(_with_orders(rows.drop("__held", *([] if keys else ["__series"])), keys, orders, order, seasonal))


def fit(series: DataFrame, keys: Sequence[str] = (), order=DEFAULT_ORDER, seasonal=(0, 0, 0, 0), orders: DataFrame | None = None,
        period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """Fit statistics (AIC, BIC, σ², n) and coefficients (``ar``, ``ma``, by rising lag) per series and order."""
    keys = list(keys)
    out = _fitted(series, keys, order, seasonal, orders, period, value)
    return out.select(*keys, *ORDER_COLS, "aic", "bic", "sigma2", "nobs", F.col("aic").isNotNull().alias("converged"), F.col("__fit.ar").alias("ar"), F.col("__fit.ma").alias("ma"), "status")


def forecast(
    series: DataFrame, steps: int = 12, keys: Sequence[str] = (), order=DEFAULT_ORDER, seasonal=(0, 0, 0, 0), orders: DataFrame | None = None,
    freq: str = "MS", z: float = 1.96, period: str = PERIOD, value: str = VALUE, steps_col: str | None = None,
) -> DataFrame:
    """fc_arima / fc_sarima: forecast table with 95 % intervals per series (order fixed or per series).

    A series that can't be fitted has one row, without step and figures, whose ``status`` says why.
    ``steps_col`` names a per-series horizon column carried on ``series`` (overrides ``steps``).
    """
    keys = list(keys)
    rows = _fitted(series, keys, order, seasonal, orders, period, value, [steps_col] if steps_col else [])
    rows = arma.forecasts(rows, F.col(steps_col) if steps_col else F.lit(steps))
    out = rows.select(*keys, *ORDER_COLS, "last_period", "status", F.explode_outer("__fc").alias("f")).select("*", "f.*")
    if freq == "MS":
        per = F.add_months("last_period", F.col("step"))
    elif freq == "W":
        per = F.date_add("last_period", F.col("step") * 7)
    else:
        per = F.date_add("last_period", F.col("step"))
    return out.select(
        *keys, *ORDER_COLS, "step", per.alias(PERIOD), "forecast", (F.col("forecast") - z * F.col("se")).alias("lower_ci"),
        (F.col("forecast") + z * F.col("se")).alias("upper_ci"), (2 * z * F.col("se")).alias("ci_width"), "status",
    )


def sarima_forecast(series: DataFrame, steps: int = 12, keys: Sequence[str] = (), order=(1, 1, 1), seasonal=(1, 1, 1, 12), **kw) -> DataFrame:
    """fc_sarima: the default SARIMA(1,1,1)(1,1,1,12)."""
    return forecast(series, steps, keys, order, seasonal, **kw)


def order_grid(series: DataFrame, keys: Sequence[str] = (), max_p: int = 3, max_q: int = 3, d: DataFrame | int | None = None,
               period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """Candidate orders per series: d from the ADF order search (or given), p × q in 0..max."""
    keys = list(keys)
    if d is None:
        dd = differencing_order(series, keys, 2, "adf", period, value).select(*keys, "d")
    elif isinstance(d, int):
        dd = series.select(*keys).distinct().withColumn("d", F.lit(d)) if keys else series.sparkSession.range(1).select(F.lit(d).alias("d"))
    else:
        dd = d
    grid = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in range(max_p + 1) for q in range(max_q + 1)]))
    return dd.select(*keys, "d", grid.alias("o")).select(*keys, "o.p", "d", "o.q").withColumns(
        {"sp": F.lit(0), "sd": F.lit(0), "sq": F.lit(0), "s": F.lit(0)}
    )


def auto_order(series: DataFrame, keys: Sequence[str] = (), max_p: int = 3, max_q: int = 3, d=None, period: str = PERIOD,
               value: str = VALUE) -> DataFrame:
    """fc_auto_arima: AIC-best order per series over the grid; (1,1,1) when nothing converged."""
    keys = list(keys)
    grid = order_grid(series, keys, max_p, max_q, d, period, value)
    fits = fit(series, keys, orders=grid, period=period, value=value)
    # not a filter: pushed below the fit it would compute every fit twice
    rank = F.when(F.col("converged"), F.struct("aic", "p", "q"))
    best = fits.groupBy(*keys).agg(
        F.min_by(F.struct(*ORDER_COLS), rank).alias("o"), F.min("aic").alias("aic"), F.count_if("converged").alias("orders_fitted")
    ).select(*keys, "o.*", "aic", "orders_fitted")
    all_series = series.select(*keys).distinct() if keys else None
    if keys:
        best = all_series.join(best, keys, "left")
        fallback = {"p": DEFAULT_ORDER[0], "d": DEFAULT_ORDER[1], "q": DEFAULT_ORDER[2], "sp": 0, "sd": 0, "sq": 0, "s": 0}
        best = best.withColumn("fallback", F.col("p").isNull()).fillna(fallback)
    return best


def auto_forecast(series: DataFrame, steps: int = 12, keys: Sequence[str] = (), max_p: int = 3, max_q: int = 3, **kw) -> DataFrame:
    keys = list(keys)
    best = auto_order(series, keys, max_p, max_q)
    return forecast(series, steps, keys, orders=best.select(*keys, *ORDER_COLS), **kw)


def compare_orders(series: DataFrame, keys: Sequence[str] = (), candidates=((0, 1, 1), (1, 1, 0), (1, 1, 1), (2, 1, 1), (1, 1, 2)),
                   period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """fc_compare: rank candidate orders per series by AIC (and BIC)."""
    keys = list(keys)
    arr = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q")) for p, d, q in candidates]))
    base = series.select(*keys).distinct() if keys else series.sparkSession.range(1).select()
    grid = base.select(*keys, arr.alias("o")).select(*keys, "o.*").withColumns({"sp": F.lit(0), "sd": F.lit(0), "sq": F.lit(0), "s": F.lit(0)})
    fits = fit(series, keys, orders=grid, period=period, value=value)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return fits.withColumns(
        {
            "aic_rank": F.when(F.col("converged"), F.rank().over(w.orderBy(F.asc_nulls_last("aic"), "p", "q"))),
            "bic_rank": F.when(F.col("converged"), F.rank().over(w.orderBy(F.asc_nulls_last("bic"), "p", "q"))),
        }
    )


def diagnostics(series: DataFrame, keys: Sequence[str] = (), order=DEFAULT_ORDER, seasonal=(0, 0, 0, 0), orders: DataFrame | None = None,
                lags: int = 10, period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """fc_diagnostics: residual mean < 0.1σ, Ljung-Box(10) p > .05, Shapiro-Francia p > .05; Jarque-Bera besides.

    ``lags`` is even. A series that can't be fitted has a row without figures, whose ``status`` says why; one with no
    more residuals than lags has no Ljung-Box figures.
    """
    keys = list(keys)
    rows = _fitted(series, keys, order, seasonal, orders, period, value).select(*keys, *ORDER_COLS, "status", "nobs", "__left")
    rows = rows.withColumn("resid_mean", safe_div(lagged.total(F.col("__left")), F.col("nobs")))
    rows = rows.withColumn("__c", arma.let(F.col("resid_mean"), lambda m: F.transform("__left", lambda v: v - m)))
    moment = lambda k: safe_div(lagged.total(F.transform("__c", lambda v: F.pow(v, F.lit(float(k))))), F.col("nobs"))
    rows = rows.withColumns({f"__m{k}": moment(k) for k in (2, 3, 4)})
    q = arma.let(F.struct("__c", "nobs"), lambda g: F.aggregate(arma.span(1, F.lit(lags)), F.lit(0.0), lambda s, k: s + safe_div(F.pow(lagged.lag_product(g["__c"], g["nobs"], k), F.lit(2.0)), (g["nobs"] - k))))
    squares = F.col("__m2") * F.col("nobs")
    rows = rows.withColumn("ljung_box_q", F.when(F.col("nobs") > lags, F.col("nobs") * (F.col("nobs") + 2.0) * safe_div(q, squares * squares)))
    skew2, tails = safe_div(F.col("__m3") * F.col("__m3"), F.pow("__m2", F.lit(3.0))), safe_div(F.col("__m4"), F.col("__m2") * F.col("__m2")) - 3
    rows = rows.withColumn("jarque_bera", F.col("nobs") / 6 * (skew2 + tails * tails / 4))
    rows = rows.withColumn("w_stat", lagged.francia_of(F.col("__c"), F.col("nobs")))
    rows = rows.select(
        *keys, *ORDER_COLS, "resid_mean", F.sqrt("__m2").alias("resid_std"), "ljung_box_q", lagged.chi_square_tail(F.col("ljung_box_q"), lags).alias("ljung_box_p"),
        "jarque_bera", F.exp(-F.col("jarque_bera") / 2).alias("jarque_bera_p"), "w_stat", lagged.francia_p(F.col("w_stat"), F.col("nobs")).alias("w_p"), "status",
    )
    out = rows.withColumns(
        {
            "mean_ok": F.abs("resid_mean") < 0.1 * F.col("resid_std"),
            "no_autocorrelation": F.col("ljung_box_p") > 0.05,
            "normal_residuals": F.col("w_p") > 0.05,
        }
    )
    return out.withColumn("passed", F.col("mean_ok") & F.col("no_autocorrelation"))


def holdout_evaluation(series: DataFrame, keys: Sequence[str] = (), order=DEFAULT_ORDER, train_fraction: float = 0.8,
                       period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """fc_arima_holdout: chronological split → fit on train → forecast the test span → accuracy metrics per series.

    Every series has a row; ``status`` says why one has no metrics.
    """
    from .forecast import metrics
    from .windows import train_test_split

    keys = list(keys)
    split = train_test_split(series, train_fraction, period, keys)
    train = split.where(F.col("split") == "train").select(*keys, period, value)
    test = split.where(F.col("split") == "test").select(*keys, period, value)
    w = Window.partitionBy(*keys).orderBy(period) if keys else Window.orderBy(period)
    test = test.withColumn("step", F.row_number().over(w))
    horizon = test.groupBy(*keys).agg(F.max("step").alias("h"))
    train = attach_row(train, horizon, keys)
    fc = forecast(train, 1, keys, order, period=period, value=value, steps_col="h")
    j = test.join(fc.select(*keys, "step", "forecast"), keys + ["step"], "inner") if keys else test.join(fc.select("step", "forecast"), ["step"])
    pairs = j.select(*keys, F.col(value).alias("actual"), F.col("forecast").alias("predicted"))
    if not keys:
        return attach_row(metrics(pairs), fc.agg(F.min("status").alias("status")), [])
    status = fc.groupBy(*keys).agg(F.min("status").alias("status"))
    out = series.select(*keys).distinct().join(metrics(pairs, keys=keys), keys, "left").join(horizon, keys, "left").join(status, keys, "left")
    return out.withColumn("status", F.coalesce("status", F.lit(f"not {FITTED}: no test span")))


def train_evaluate_forecast(series: DataFrame, keys: Sequence[str] = (), order=DEFAULT_ORDER, seasonal=(0, 0, 0, 0),
                            train_fraction: float = 0.8, steps: int = 12, freq: str = "MS", period: str = PERIOD,
                            value: str = VALUE) -> dict[str, DataFrame]:
    """The full per-series workflow: chronological split → fit on train → test-span accuracy → refit on
    all points → forecast with intervals → residual diagnostics (each step a grouped job over all series)."""
    keys = list(keys)
    return {
        "test_metrics": holdout_evaluation(series, keys, order, train_fraction, period, value),
        "forecast": forecast(series, steps, keys, order, seasonal, freq=freq, period=period, value=value),
        "fit": fit(series, keys, order, seasonal, period=period, value=value),
        "diagnostics": diagnostics(series, keys, order, seasonal, period=period, value=value),
    }
