"""Stationarity diagnostics per series.

All tests are Spark expressions over the *period* table: the regressions and long-run variances, whose numbers of lags
the data decide, work on one array per series (``lagged``); a series is bounded by its calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attach import attach_row
from ..functions.numeric import safe_div
from . import lagged, windows

PERIOD, VALUE = "period", "value"


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition by the group keys before a CPU-heavy grouped kernel.

    Period tables are small in bytes, so AQE would coalesce their shuffle into a
    single task and serialise every model fit. An explicit ``repartition`` on the
    grouping keys is kept as-is by AQE and also satisfies the grouping's required
    distribution (no second exchange). The count is the larger of the session's
    shuffle partitions and the cluster's default parallelism.
    """
    from ..session import target_parallelism

    return df.repartition(target_parallelism(df.sparkSession), *keys)


def _one_series(series: DataFrame, keys: Sequence[str], period: str, value: str) -> tuple[DataFrame, list[str]]:
    """Arrays per series; an ungrouped input is one series."""
    gkeys = list(keys) or ["__series"]
    src = (series if keys else series.withColumn("__series", F.lit(0))).select(*gkeys, period, value)
    return lagged.series_arrays(spread(src, gkeys), gkeys, period, value), gkeys


# Fixed values (published constants).
# MacKinnon (1994): response surface of the p-value, regression with a constant, one variable.
ADF_TAU_MAX, ADF_TAU_MIN, ADF_TAU_STAR = 2.74, -18.83, -1.61
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
# MacKinnon (2010): critical values b0 + b1/n + b2/n² + b3/n³.
ADF_CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
# Kwiatkowski et al. (1992), level stationarity: critical values and their p-values.
KPSS_CRITICAL = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))
#: A regression that leaves less than this share of the response's squares fits perfectly, and tests nothing.
PERFECT = 1e-12


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def _adf_products(z: Column, d: Column, n: Column, lags: Column) -> Column:
    """Cross products of the regression of changes after the first ``lags``.

    gram: lower triangle of those of constant, level and ``lags`` changes before; with: those with the change; squares: its own.
    A product of changes at lags i + 1, j + 1 is that at i, j but for one term at either end, so that only the products of level
    and change with each lag are sums over the series.
    """
    rows = n - 1 - lags
    cell = lambda a, i: F.get(a, i)
    before = F.sequence(F.lit(0), lags)
    at = lambda j: F.slice(d, lags - j + 1, rows)
    given = F.struct(
        z.alias("z"), lags.alias("lags"), n.alias("n"), F.slice(z, lags + 1, rows).alias("level"), at(F.lit(0)).alias("change"),
        F.transform(before, at).alias("at"), F.reverse(F.slice(d, F.lit(1), lags)).alias("first"), F.reverse(F.slice(d, n - lags, lags)).alias("last"),
    )

    def sums(g):
        return F.struct(
            F.transform(g["at"], lambda a: lagged.dot(a, g["level"])).alias("level"), F.transform(g["at"], lambda a: lagged.dot(a, g["change"])).alias("change"),
            F.transform(F.sequence(F.lit(0), g["lags"]), lambda j: cell(g["z"], g["n"] - 1 - j) - cell(g["z"], g["lags"] - j)).alias("one"),
        )

    def products(g, s):
        def row(held, j):
            ends = lambda old, i: old + cell(g["first"], i) * cell(g["first"], j - 1) - cell(g["last"], i) * cell(g["last"], j - 1)
            return F.concat(held, F.array(F.concat(F.array(cell(s["change"], j)), F.transform(cell(held, j - 1), ends))))

        lagged_rows = F.aggregate(F.filter(F.sequence(F.lit(0), g["lags"]), lambda j: j > 0), F.array(F.array(cell(s["change"], F.lit(0)))), row)
        of_lags = F.transform(lagged_rows, lambda r, j: F.concat(F.array(cell(s["one"], j), cell(s["level"], j)), F.slice(r, F.lit(2), j)))
        start = F.array(F.array((g["n"] - 1 - g["lags"]).cast("double")), F.array(lagged.total(g["level"]), lagged.dot(g["level"], g["level"])))
        return F.struct(
            F.concat(start, F.slice(of_lags, F.lit(2), g["lags"])).alias("gram"),
            F.concat(F.array(cell(s["one"], F.lit(0)), cell(s["level"], F.lit(0))), F.slice(s["change"], F.lit(2), g["lags"])).alias("with"),
            cell(s["change"], F.lit(0)).alias("squares"),
        )

    return _let(given, lambda g: _let(sums(g), lambda s: products(g, s)))


def _let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def adf_test(series: DataFrame, keys: Sequence[str] = (), period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """ts_adf: ADF statistic, p-value, lags, nobs, critical values, stationary if p < 0.05, 4-level label.

    Dickey-Fuller regression with a constant. The number of lags has the least AIC of all up to 12 (n/100)^¼, on the
    sample that the largest leaves; all of them come from one triangular factor per series. Series that don't
    vary, are shorter than four periods or are fitted perfectly are "Not testable".
    """
    s, gkeys = _one_series(series, keys, period, value)
    return _adf_of(s, [k for k in gkeys if k != "__series"])


def _adf_of(s: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The test of every array ``__x`` of ``__n`` values; ``keep``: columns that stay."""
    n = F.col("__n")
    # the statistic doesn't depend on place and scale; numbers near one keep the products precise
    s = s.withColumn("__mean", safe_div(lagged.total(F.col("__x")), n))
    s = s.withColumn("__dev", F.sqrt(safe_div(lagged.total(F.transform("__x", lambda v: (v - F.col("__mean")) * (v - F.col("__mean")))), n)))
    able = (n >= 4) & (F.col("__dev") > 0)
    s = s.withColumn("__z", F.when(able, F.transform("__x", lambda v: (v - F.col("__mean")) / F.col("__dev"))))
    s = s.withColumn("__d", F.zip_with(F.slice("__z", F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice("__z", F.lit(1), F.greatest(n - 1, F.lit(0))), lambda a, b: a - b))
    most = F.least(F.greatest(F.floor(n / 2) - 2, F.lit(0)), F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25)))).cast("int")
    s = s.withColumn("__most", F.when(able, most))
    z, d, most = F.col("__z"), F.col("__d"), F.col("__most")
    s = s.withColumn("__gram", _adf_products(z, d, n, most))
    g = F.col("__gram")
    s = s.withColumn("__own", lagged.forward(lagged.triangle(g["gram"]), g["with"]))
    rows = n - 1 - most
    # residual squares with constant and level, then with a lag more each
    start = F.struct(F.array().cast("array<double>").alias("held"), g["squares"].alias("left"))
    less = lambda s, v: _let(s["left"] - v * v, lambda x: F.struct(F.concat(s["held"], F.array(x)).alias("held"), x.alias("left")))
    left = F.aggregate("__own", start, less, lambda s: s["held"])
    fit = lambda left, j: rows * (math.log(2 * math.pi) + F.log(F.greatest(left, F.lit(1e-300)) / rows) + 1) + 2 * (j + 2)
    # the figures of all lag counts go in as an array: named within a function of one, they would be worked out for each
    figures = F.transform(F.slice(left, F.lit(2), most + 1), lambda x, j: F.when(rows > j + 2, F.struct(fit(x, j).alias("aic"), j.alias("lags"))))
    s = s.withColumn("__lags", F.coalesce(F.array_min(figures)["lags"], F.when(able, F.lit(0))))
    lags = F.col("__lags")
    s = s.withColumn("__gram", _adf_products(z, d, n, lags))
    s = s.withColumn("__factor", lagged.triangle(g["gram"]))
    unit = F.transform(F.sequence(F.lit(0), lags + 1), lambda i: F.when(i == 1, 1.0).otherwise(0.0))
    s = s.withColumns({"__own": lagged.forward(F.col("__factor"), g["with"]), "__unit": lagged.forward(F.col("__factor"), unit)})
    own, unit = F.col("__own"), F.col("__unit")
    # coefficient of the level and its share of the inverse of the cross products
    s = s.withColumns({"__b": lagged.dot(unit, own), "__inverse": lagged.dot(unit, unit), "__squares": g["squares"] - lagged.dot(own, own)})
    nobs = n - 1 - lags
    squares = F.col("__squares")
    free = nobs - (lags + 2)
    tested = able & (free > 0) & (squares > PERFECT * g["squares"]) & (F.col("__inverse") > 0)
    error = F.sqrt(safe_div(F.greatest(squares, F.lit(0.0)), free) * F.col("__inverse"))
    out = s.select(*keep, F.when(tested, safe_div(F.col("__b"), error)).alias("adf_stat"), lags.cast("int").alias("lags"), F.when(able, nobs).cast("int").alias("nobs"))
    stat, seen = F.col("adf_stat"), F.col("nobs")
    surface = F.when(stat <= ADF_TAU_STAR, _polynomial(ADF_SMALL, stat)).otherwise(_polynomial(ADF_LARGE, stat))
    p = F.when(stat > ADF_TAU_MAX, 1.0).when(stat < ADF_TAU_MIN, 0.0).otherwise(lagged.normal_cdf(surface))
    out = out.withColumn("p_value", F.round(p, 12))  # what is less is the series' rounding
    out = out.withColumns({name: _polynomial(c, safe_div(F.lit(1.0), seen)) for name, c in ADF_CRITICAL.items()})
    out = out.select(*keep, "adf_stat", "p_value", "lags", "nobs", "crit_1", "crit_5", "crit_10")
    p = F.col("p_value")
    return out.withColumns(
        {
            "is_stationary": p < 0.05,
            "interpretation": F.when(p < 0.01, "Highly stationary (p < 0.01)")
            .when(p < 0.05, "Stationary (p < 0.05)")
            .when(p < 0.10, "Weakly stationary (p < 0.10)")
            .when(p >= 0.10, "Non-stationary (p >= 0.10)")
            .otherwise("Not testable"),
        }
    )


def kpss_test(series: DataFrame, keys: Sequence[str] = (), period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """ts_kpss: KPSS level test, stationary if p > 0.05 (p clipped to the table range .01–.10).

    The long-run variance takes Bartlett weights over as many lags as Hobijn, Franses and Ooms (1998) choose from the
    series' own first autocovariances.
    """
    s, gkeys = _one_series(series, keys, period, value)
    return _kpss_of(s, [k for k in gkeys if k != "__series"])


def _kpss_of(s: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The test of every array ``__x`` of ``__n`` values; ``keep``: columns that stay."""
    n = F.col("__n")
    s = s.withColumn("__mean", safe_div(lagged.total(F.col("__x")), n))
    s = s.withColumn("__e", F.transform("__x", lambda v: v - F.col("__mean"))).withColumn("__s", lagged.dot(F.col("__e"), F.col("__e")))
    e, squares = F.col("__e"), F.col("__s")
    first = F.floor(F.pow(n.cast("double"), F.lit(2.0 / 9.0))).cast("int")
    s = s.withColumns({
        "__zero": safe_div(squares, n) + safe_div(2 * lagged.weighted_lags(e, n, first, lambda k: F.lit(1.0)), n),
        "__one": safe_div(2 * lagged.weighted_lags(e, n, first, lambda k: k.cast("double")), n),
    })
    ratio = F.coalesce(safe_div(F.col("__one"), F.col("__zero")), F.lit(0.0))
    lags = F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1.0 / 3.0)) * F.pow(n.cast("double"), F.lit(1.0 / 3.0)))
    s = s.withColumn("__lags", F.least(lags, F.greatest(n - 1, F.lit(0))).cast("int"))
    bartlett = lambda k: 1.0 - k / (F.col("__lags") + 1.0)
    s = s.withColumn("__long", safe_div(squares + 2 * lagged.weighted_lags(e, n, F.col("__lags"), bartlett), n))
    stat = safe_div(safe_div(lagged.running_squares(e), n * n), F.when(F.col("__long") > 0, F.col("__long")))
    s = s.withColumn("__stat", stat)
    stat = F.col("__stat")
    p = F.when(stat <= KPSS_CRITICAL[0][0], KPSS_CRITICAL[0][1])
    for (a, pa), (b, pb) in zip(KPSS_CRITICAL, KPSS_CRITICAL[1:]):
        p = p.when(stat <= b, pa + (stat - a) / (b - a) * (pb - pa))
    p = p.when(stat > KPSS_CRITICAL[-1][0], KPSS_CRITICAL[-1][1])
    out = s.select(*keep, stat.alias("kpss_stat"), p.alias("p_value"), F.col("__lags").alias("lags"))
    p = F.col("p_value")
    return out.withColumns(
        {
            "is_stationary": p > 0.05,
            "interpretation": F.when(p > 0.10, "Stationary (p > 0.10)")
            .when(p > 0.05, "Likely stationary (p > 0.05)")
            .when(p > 0.01, "Weakly stationary (p > 0.01)")
            .when(p <= 0.01, "Non-stationary (p <= 0.01)")
            .otherwise("Not testable"),
        }
    )


def variance_ratio(series: DataFrame, keys: Sequence[str] = (), period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """ts_var_ratio: sample variance of the second half ÷ first half (1 when the first is 0)."""
    keys = list(keys)
    h = windows.halves(series, period, keys)
    g = h.groupBy(*keys).agg(
        F.var_samp(F.when(F.col("half") == 1, F.col(value))).alias("var_first"),
        F.var_samp(F.when(F.col("half") == 2, F.col(value))).alias("var_second"),
    )
    ratio = F.when(F.col("var_first") > 0, F.col("var_second") / F.col("var_first")).otherwise(F.lit(1.0))
    g = g.withColumn("variance_ratio", ratio)
    dev = F.abs(F.col("variance_ratio") - 1.0)
    return g.select(
        *keys,
        "variance_ratio",
        F.when(dev < 0.3, 0.01).when(dev < 0.5, 0.05).otherwise(0.1).alias("p_value"),
        (dev < 0.5).alias("is_stationary"),
        F.when(dev < 0.3, "Likely stationary (variance stable)")
        .when(dev < 0.5, "Possibly stationary (variance moderately stable)")
        .otherwise("Likely non-stationary (variance unstable)")
        .alias("interpretation"),
    )


def consensus(series: DataFrame, keys: Sequence[str] = (), period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """ts_consensus: majority of ADF, KPSS and variance-ratio votes, reported as 'k/3'."""
    keys = list(keys)
    a = adf_test(series, keys, period, value).select(*keys, F.col("is_stationary").alias("adf_stationary"), F.col("p_value").alias("adf_p"))
    k = kpss_test(series, keys, period, value).select(*keys, F.col("is_stationary").alias("kpss_stationary"), F.col("p_value").alias("kpss_p"))
    v = variance_ratio(series, keys, period, value).select(*keys, F.col("is_stationary").alias("vr_stationary"), "variance_ratio")
    if keys:
        j = a.join(k, keys, "full").join(v, keys, "full")
    else:
        j = attach_row(attach_row(a, k), v)
    votes = sum(F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("adf_stationary", "kpss_stationary", "vr_stationary"))
    j = j.withColumn("votes", votes)
    return j.withColumns(
        {
            "consensus_stationary": F.col("votes") >= 2,
            "test_agreement": F.format_string("%d/3", F.col("votes")),
            "summary": F.when(F.col("votes") >= 2, F.format_string("CONSENSUS: Series is STATIONARY (%d/3 tests agree)", F.col("votes"))).otherwise(
                F.format_string("MIXED RESULTS: (%d/3 tests say stationary)", F.col("votes"))
            ),
        }
    )


def differenced_versions(series: DataFrame, max_d: int, keys: Sequence[str] = (), period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """Every series at d = 0..max_d, tagged with ``d`` (one union; windows partitioned by series)."""
    keys = list(keys)
    parts = []
    for d in range(max_d + 1):
        if d == 0:
            part = series.select(*keys, period, F.col(value).cast("double").alias(value))
        else:
            part = windows.difference(series.select(*keys, period, value), d, period, value, keys, out="__dv").select(
                *keys, period, F.col("__dv").alias(value)
            )
        parts.append(part.withColumn("d", F.lit(d)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _versions(series: DataFrame, max_d: int, keys: list[str], period: str, value: str, carried: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """One row per series and d = 0..max_d: its array ``__x``, differenced d times, of ``__n`` values; the columns to keep.

    ``carried``: a name for the array as it is, NULLs included.
    """
    gkeys = keys or ["__series"]
    src = (series if keys else series.withColumn("__series", F.lit(0))).select(*gkeys, period, value)
    rows = lagged.whole_arrays(spread(src, gkeys), gkeys, period, value)
    # each once more from the one before; NULL stays NULL on either side of a difference
    step = lambda held, _: F.concat(held, F.array(_changes(F.element_at(held, -1), 1)))
    every = F.aggregate(F.array_repeat(F.lit(0), max_d), F.array("__x"), step)
    rows = rows.select(*gkeys, *[F.col("__x").alias(c) for c in carried], F.posexplode(every).alias("d", "__x"))
    return lagged.present(rows), [*keys, "d", *carried]


def _changes(x: Column, lag: int) -> Column:
    """x less its value ``lag`` before."""
    left = F.greatest(F.size(x) - lag, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(lag + 1), left), F.slice(x, F.lit(1), left), lambda new, old: new - old)


def differencing_order(
    series: DataFrame, keys: Sequence[str] = (), max_d: int = 2, test: str = "adf", period: str = PERIOD, value: str = VALUE
) -> DataFrame:
    """ts_order_d: smallest d ≤ max_d at which the series tests stationary (else max_d)."""
    if test not in ("adf", "kpss", "auto"):
        raise ValueError("test must be 'adf', 'kpss' or 'auto'")
    keys = list(keys)
    res = (_kpss_of if test == "kpss" else _adf_of)(*_versions(series, max_d, keys, period, value))
    g = res.groupBy(*keys).agg(F.min(F.when(F.col("is_stationary"), F.col("d"))).alias("__first"))
    d = F.coalesce(F.col("__first"), F.lit(max_d))
    return g.select(
        *keys,
        d.alias("d"),
        F.col("__first").isNotNull().alias("is_stationary"),
        F.when(F.col("__first").isNotNull(), F.format_string("Series becomes stationary at d=%d", d)).otherwise(
            F.format_string("Series not fully stationary even at d=%d (reached max_d)", d)
        ).alias("explanation"),
        F.format_string("Use d=%d in ARIMA(p, %d, q)", d, d).alias("recommendation"),
    )


def validate_differencing(original: DataFrame, differenced: DataFrame, order: int, keys: Sequence[str] = (), value: str = VALUE) -> DataFrame:
    """ts_validate_diff: length n-d, no NULLs, |mean| and variance reduced; statistics of both."""
    keys = list(keys)
    o = original.groupBy(*keys).agg(
        F.count(value).alias("original_length"), F.avg(value).alias("original_mean"), F.stddev_samp(value).alias("original_std"),
        F.var_samp(value).alias("__ov"),
    )
    d = differenced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("differenced_length"), F.count_if(F.col(value).isNull()).alias("__nulls"),
        F.avg(value).alias("differenced_mean"), F.stddev_samp(value).alias("differenced_std"), F.var_samp(value).alias("__dv"),
    )
    j = attach_row(o, d, keys)
    j = j.withColumns(
        {
            "order_correct": F.col("original_length") - order == F.col("differenced_length"),
            "no_nans": F.col("__nulls") == 0,
            "mean_near_zero": F.abs("differenced_mean") < F.abs("original_mean"),
            "variance_reduced": F.col("__dv") < F.col("__ov"),
        }
    )
    return j.withColumn("is_valid", F.col("order_correct") & F.col("no_nans")).drop("__nulls", "__ov", "__dv")


def prepare_stationary(
    series: DataFrame, keys: Sequence[str] = (), max_d: int = 2, apply_seasonal: bool = False, seasonal_period: int = 12,
    period: str = PERIOD, value: str = VALUE,
):
    """ts_prepare_stat: test → difference at the chosen d (→ optional seasonal difference) → retest.

    Returns ``(prepared_series, report)``; the report has the original and final ADF p-values, d and readiness.
    """
    keys = list(keys)
    order = differencing_order(series, keys, max_d, "adf", period, value).select(*keys, "d")
    versions = differenced_versions(series, max_d, keys, period, value)
    chosen = versions.join(order, keys + ["d"], "inner") if keys else versions.join(F.broadcast(order), ["d"], "inner")
    prepared = chosen.select(*keys, period, value, "d")
    if apply_seasonal:
        prepared = windows.seasonal_difference(prepared, seasonal_period, period, value, keys, out="__sd").select(
            *keys, period, F.col("__sd").alias(value), "d"
        )
    # the report: every version is tested once, and the chosen one again from the same array
    tested = _adf_of(*_versions(series, max_d, keys, period, value, ["__whole"]))
    as_is = lambda c: F.max(F.when(F.col("d") == 0, F.col(c)))
    rep = tested.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(F.col("is_stationary"), F.col("d"))), F.lit(max_d)).alias("d"), as_is("p_value").alias("original_p_value"),
        as_is("is_stationary").alias("original_stationary"), as_is("__whole").alias("__whole"),
    )
    at_d = F.aggregate(F.array_repeat(F.lit(0), F.col("d")), F.col("__whole"), lambda x, _: _changes(x, 1))
    rep = rep.withColumn("__x", at_d)
    if apply_seasonal:
        rep = rep.withColumn("__x", F.when(F.size("__x") >= 2 * seasonal_period, _changes(F.col("__x"), seasonal_period)).otherwise(F.array().cast("array<double>")))
    held = [*keys, "d", "original_p_value", "original_stationary"]
    rep = _adf_of(lagged.present(rep), held).select(*held, F.col("p_value").alias("final_p_value"), F.col("is_stationary").alias("is_ready"))
    rep = rep.withColumns({"seasonal_differencing": F.lit(apply_seasonal), "seasonal_period": F.lit(seasonal_period if apply_seasonal else None).cast("int")})
    return prepared, rep


def compare_before_after(original: DataFrame, differenced: DataFrame, d: int, keys: Sequence[str] = (), period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """ts_compare_stat: ADF and moments before / after differencing with improvement flags."""
    keys = list(keys)
    a0 = adf_test(original, keys, period, value).select(*keys, F.col("adf_stat").alias("adf_before"), F.col("p_value").alias("p_before"))
    a1 = adf_test(differenced, keys, period, value).select(*keys, F.col("adf_stat").alias("adf_after"), F.col("p_value").alias("p_after"))
    v = validate_differencing(original, differenced, d, keys, value)
    if keys:
        j = a0.join(a1, keys, "inner").join(v, keys, "inner")
    else:
        j = attach_row(attach_row(a0, a1), v)
    return j.withColumns(
        {
            "d_order": F.lit(d),
            "p_value_improved": F.col("p_after") < F.col("p_before"),
            "statistic_improved": F.col("adf_after") < F.col("adf_before"),
            "became_stationary": (F.col("p_before") >= 0.05) & (F.col("p_after") < 0.05),
        }
    )


def recommend_arima(series: DataFrame, keys: Sequence[str] = (), period: str = PERIOD, value: str = VALUE, seasonal_period: int = 12) -> DataFrame:
    """ts_recommend_arima: (1, d, 1) with d from the ADF order search; seasonal (1, 0, 1, s)."""
    keys = list(keys)
    o = differencing_order(series, keys, 2, "adf", period, value)
    return o.select(
        *keys,
        F.lit(1).alias("p"), F.col("d"), F.lit(1).alias("q"),
        F.lit(1).alias("seasonal_p"), F.lit(0).alias("seasonal_d"), F.lit(1).alias("seasonal_q"), F.lit(seasonal_period).alias("seasonal_s"),
        F.format_string("ARIMA(1,%d,1)", F.col("d")).alias("recommended_order"),
        F.format_string("SARIMA(1,%d,1)(1,0,1,%d)", F.col("d"), F.lit(seasonal_period)).alias("recommended_seasonal_order"),
    )
