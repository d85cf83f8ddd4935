"""ARIMA by two regressions (Hannan and Rissanen 1982), as expressions over one array per series.

A long autoregression (Yule-Walker equations by the Durbin-Levinson recursion) gives innovations; one least-squares
regression of the differenced series on its own lags and on the innovations' lags then gives all coefficients at once, from a
swept cross-product matrix. Nothing is searched iteratively and no Python worker is involved, so a row may have any
orders: what those of one row share is computed once. A season's lags are i + s j with free coefficients (the product of the two polynomials isn't imposed).
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import safe_div
from . import lagged

FITTED = "fitted"
SHORT = f"not {FITTED}: series too short for this order"
#: A regression that leaves less than this share of the response's squares leaves nothing.
PERFECT = 1e-12
#: An order's own columns; d, sd and s are its series'.
ORDER = ("p", "q", "sp", "sq")


def let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(a, b) -> Column:
    """a, a + 1 … b; empty if b < a."""
    a, b = (F.lit(x) if isinstance(x, int) else x.cast("int") for x in (a, b))
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def differenced(x: Column, lag: Column, times: Column) -> Column:
    """x less its value ``lag`` before, as many times."""

    def once(a, _):
        left = F.greatest(F.size(a) - lag, F.lit(0))
        return F.zip_with(F.slice(a, lag + 1, left), F.slice(a, F.lit(1), left), lambda new, old: new - old)

    return F.aggregate(F.array_repeat(F.lit(0), times), x, once)


def difference_polynomial(polynomial: Column, lag: Column, times: Column) -> Column:
    """Coefficients by rising powers of the backshift, times (1 - B^lag), as many times."""
    none = F.array_repeat(F.lit(0.0), lag)
    return F.aggregate(F.array_repeat(F.lit(0), times), polynomial, lambda a, _: F.zip_with(F.concat(a, none), F.concat(none, a), lambda u, v: u - v))


def lags_of(order: Column, seasonal: Column, s: Column) -> Column:
    """All i + s j but 0, for i up to the order and j up to the seasonal order."""
    both = F.flatten(F.transform(F.sequence(F.lit(0), seasonal), lambda j: F.transform(F.sequence(F.lit(0), order), lambda i: i + s * j)))
    return F.array_sort(F.array_remove(F.array_distinct(both), 0))


def long_autoregression(r: Column, order: Column) -> Column:
    """Coefficients of lags 1 to ``order`` from the lag products r[0], r[1] …"""
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.get(r, F.lit(0)).alias("v"))

    def step(s, k):
        left = F.get(r, k) - lagged.dot(s["phi"], F.reverse(F.slice(r, F.lit(2), k - 1)))
        return let(
            F.coalesce(safe_div(left, s["v"]), F.lit(0.0)),
            lambda a: F.struct(F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda f, g: f - a * g), F.array(a)).alias("phi"), (s["v"] * (1 - a * a)).alias("v")),
        )

    return F.aggregate(span(1, order), start, step, lambda s: s["phi"])


def innovations(z: Column, n: Column, order: Column) -> Column:
    """What the long autoregression leaves of z, from position ``order`` on."""
    r = F.transform(span(0, order), lambda k: lagged.lag_product(z, n, k))
    return let(
        let(r, lambda r: long_autoregression(r, order)),
        lambda phi: F.transform(span(order, n - 1), lambda t: F.get(z, t) - lagged.dot(phi, F.reverse(F.slice(z, t - order + 1, order)))),
    )


def fit(arrays: DataFrame) -> DataFrame:
    """One row per order with the fit's columns, from ``arrays`` (keys, ``__x``, ``__n``, d, sd, s, ``__orders``: p, q, sp, sq).

    Added: aic, bic, sigma2, nobs, status, ``__fit`` (ar, ma: coefficients of ``__ar`` and ``__ma``, the lags), ``__left`` (residuals),
    ``__e`` (innovations), ``__mu``, ``__scale``. The mean is taken off unless the series is differenced. The orders of a row are
    regressed on the same periods, so that their AIC can be compared; those with innovations of one long autoregression share
    these and one matrix of cross products, of which each takes its own lags. A series that is too short has only a status;
    one that is flat, or fitted to the last digit, has sigma2 0 and no AIC.
    """
    c = F.col
    out = arrays.withColumn("__w", differenced(differenced(c("__x"), c("s"), c("sd")), F.lit(1), c("d")))
    out = out.withColumn("__size", F.size("__w"))
    size = c("__size")
    has_mean = (c("d") == 0) & (c("sd") == 0)
    out = out.withColumn("__mu", F.when(has_mean, F.coalesce(safe_div(lagged.total(c("__w")), size), F.lit(0.0))).otherwise(0.0))
    deviation = let(c("__mu"), lambda mu: F.sqrt(safe_div(lagged.total(F.transform("__w", lambda v: (v - mu) * (v - mu))), size)))
    varies = (F.array_max("__w") > F.array_min("__w")) | ~has_mean  # what is left of a flat series is the mean's rounding
    out = out.withColumn("__scale", let(F.when(varies, deviation), lambda d: F.when(d > 0, d).otherwise(1.0)))
    centred = lambda m: F.transform("__w", lambda v: (v - m["mu"]) / m["scale"])
    out = out.withColumn("__z", let(F.struct(c("__mu").alias("mu"), c("__scale").alias("scale")), centred))
    most = lambda lags: F.coalesce(F.array_max(lags), F.lit(0))
    lags = lambda o: F.struct(*[o[k].alias(k) for k in ORDER], lags_of(o["p"], o["sp"], c("s")).alias("__ar"), lags_of(o["q"], o["sq"], c("s")).alias("__ma"))
    out = out.withColumn("__orders", F.transform("__orders", lags))
    wanted = lambda o: F.greatest(most(o["__ma"]), most(o["__ar"]), F.ceil(10 * F.log10(F.greatest(size, F.lit(1)).cast("double"))).cast("int"))
    long = lambda o: F.when(F.size(o["__ma"]) > 0, F.least(F.floor(size / 3).cast("int"), wanted(o))).otherwise(0)
    out = out.withColumn("__orders", F.transform("__orders", lambda o: o.withField("long", long(o))))
    first = lambda o: F.greatest(most(o["__ar"]), F.when(F.size(o["__ma"]) > 0, o["long"] + most(o["__ma"])).otherwise(0))
    out = out.withColumn("__first", F.array_max(F.transform("__orders", first)))
    out = out.withColumn("__rows", size - c("__first"))
    alike = lambda k: F.struct(k.alias("__long"), F.filter("__orders", lambda o: o["long"] == k).alias("__grid"))
    out = out.withColumn("__blocks", F.transform(F.array_distinct(F.transform("__orders", lambda o: o["long"])), alike))
    # outer, though no array is empty: else a filter on its size is pushed below the fit and computes it again
    out = out.drop("__orders", "__w").select("*", F.inline_outer("__blocks")).drop("__blocks")

    params = lambda o: F.size(o["__ar"]) + F.size(o["__ma"])
    able = lambda o: c("__rows") > params(o) + 1 + has_mean.cast("int")
    every = lambda name: F.array_sort(F.array_distinct(F.flatten(F.transform("__grid", lambda o: o[name]))))
    out = out.withColumns({"__ars": every("__ar"), "__mas": every("__ma"), "__any": F.exists("__grid", able)})
    at = F.struct("__long", "__first", "__rows")
    e = let(F.struct("__z", "__size", "__long"), lambda g: innovations(g["__z"], g["__size"], g["__long"]))
    out = out.withColumn("__e", F.when(c("__any") & (F.size("__mas") > 0), e).otherwise(F.array().cast("array<double>")))

    def columns(g):
        """The regression's columns and, last, its response."""
        own = F.transform(g["ar"], lambda lag: F.slice(g["__z"], g["at"]["__first"] - lag + 1, g["at"]["__rows"]))
        moving = F.transform(g["ma"], lambda lag: F.slice(g["__e"], g["at"]["__first"] - lag - g["at"]["__long"] + 1, g["at"]["__rows"]))
        return F.concat(own, moving, F.array(F.slice(g["__z"], g["at"]["__first"] + 1, g["at"]["__rows"])))

    given = lambda ar, ma: F.struct(c(ar).alias("ar"), c(ma).alias("ma"), "__z", "__e", at.alias("at"))
    half = lambda cols: F.transform(cols, lambda a, i: F.transform(F.slice(cols, F.lit(1), i + 1), lambda b: lagged.dot(a, b)))
    out = out.withColumn("__half", F.when(c("__any"), let(let(given("__ars", "__mas"), columns), half)))
    cell = lambda m, i, j: F.get(F.get(m, i), j)

    def products(o, g):
        """The order's own cross products."""
        place = lambda lags, lag: F.array_position(lags, lag).cast("int") - 1
        own = F.transform(o["__ar"], lambda lag: place(g["ar"], lag))
        moving = F.transform(o["__ma"], lambda lag: F.size(g["ar"]) + place(g["ma"], lag))
        places = F.concat(own, moving, F.array(F.size(g["ar"]) + F.size(g["ma"])))
        return let(places, lambda at: F.transform(at, lambda i: F.transform(at, lambda j: cell(g["half"], F.greatest(i, j), F.least(i, j)))))

    def solved(gram, k):
        def coefficients(m):
            return F.transform(span(0, k - 1), lambda i: F.when(cell(m, i, i) > lagged.COLLINEAR * cell(gram, i, i), cell(m, i, k)).otherwise(0.0))

        figures = lambda m: F.struct(coefficients(m).alias("b"), cell(m, k, k).alias("squares"), cell(gram, k, k).alias("all"))
        return let(F.when(k > 0, lagged.swept(gram, k + 1)["m"]).otherwise(gram), figures)

    regression = lambda o, g: F.when(able(o), let(products(o, g), lambda gram: let(F.size(gram) - 1, lambda k: solved(gram, k))))
    # what the orders share goes in as a value: named within a function of one, it would be worked out for each
    shared = F.struct(c("__ars").alias("ar"), c("__mas").alias("ma"), c("__half").alias("half"))
    fits = let(shared, lambda g: F.transform("__grid", lambda o: o.withField("__b", regression(o, g)).dropFields("long")))
    out = out.withColumn("__fits", fits)
    out = out.drop("__grid", "__half", "__ars", "__mas", "__any").select("*", F.inline_outer("__fits")).drop("__fits")

    b = c("__b")
    good = b.isNotNull()
    out = out.withColumn("status", F.when(good, FITTED).otherwise(SHORT))
    squares = F.when(b["squares"] > PERFECT * b["all"], b["squares"]).otherwise(0.0)
    m = c("__rows")
    out = out.withColumn("sigma2", F.when(good, safe_div(squares, m) * c("__scale") * c("__scale")))
    out = out.withColumn("nobs", F.when(good, m).cast("int"))
    penalised = F.size("__ar") + F.size("__ma") + 1 + has_mean.cast("int")
    likelihood = -m / 2 * (F.log(2 * math.pi * c("sigma2")) + 1)
    out = out.withColumns({"aic": -2 * likelihood + 2 * penalised, "bic": -2 * likelihood + F.log(m.cast("double")) * penalised})
    ar, ma = F.slice(b["b"], F.lit(1), F.size("__ar")), F.slice(b["b"], F.size("__ar") + 1, F.size("__ma"))
    # a column of its own: who doesn't ask for residuals doesn't compute them
    less = lambda cols: F.aggregate(span(0, F.size(cols) - 2), F.element_at(cols, -1), lambda left, i: F.zip_with(left, F.get(cols, i), lambda y, v: y - F.get(b["b"], i) * v))
    left = let(c("__scale"), lambda s: F.transform(let(let(given("__ar", "__ma"), columns), less), lambda v: v * s))
    return out.withColumns({"__fit": F.when(good, F.struct(ar.alias("ar"), ma.alias("ma"))), "__left": F.when(good, left)}).drop("__z", "__b")


def forecasts(fitted: DataFrame, steps: Column, z: float = 1.96) -> DataFrame:
    """``__fc``: (forecast, se) for every step, NULL where there is no fit; ``steps`` may differ by row."""

    def coefficient(lags, values, lag):
        return F.coalesce(F.get(values, F.array_position(lags, lag).cast("int") - 1), F.lit(0.0))

    def polynomial(g):
        ar = F.transform(span(0, g["p"] + g["s"] * g["sp"]), lambda lag: F.when(lag == 0, 1.0).otherwise(-coefficient(g["__ar"], g["__fit"]["ar"], lag)))
        return difference_polynomial(difference_polynomial(ar, g["s"], g["sd"]), F.lit(1), g["d"])

    def ahead(g, weights):
        """``weights``: of the values 1, 2 … periods before."""
        k = F.size(weights)
        shock = lambda h: F.aggregate(
            span(0, F.size(g["__ma"]) - 1),
            F.lit(0.0),
            lambda s, i: s + F.when(F.get(g["__ma"], i) >= h, F.get(g["__fit"]["ma"], i) * F.get(g["__e"], F.size(g["__e"]) - 1 + h - F.get(g["__ma"], i))).otherwise(0.0),
        )
        back = F.transform(F.slice(g["__x"], F.size(g["__x"]) - k + 1, k), lambda v: v - g["__mu"])
        value = lambda a, h: lagged.dot(F.reverse(weights), F.slice(a, F.size(a) - k + 1, k)) + g["__scale"] * shock(h)
        points = F.aggregate(span(1, g["steps"]), back, lambda a, h: F.concat(a, F.array(value(a, h))))
        known = lambda a, j: F.least(j, k)
        psi = F.aggregate(
            span(1, g["steps"] - 1),
            F.array(F.lit(1.0)),
            lambda a, j: F.concat(a, F.array(coefficient(g["__ma"], g["__fit"]["ma"], j) + lagged.dot(F.slice(weights, F.lit(1), known(a, j)), F.slice(F.reverse(a), F.lit(1), known(a, j))))),
        )
        out = lambda x, w: F.transform(
            span(1, g["steps"]),
            lambda h: F.struct(h.alias("step"), (F.get(x, k + h - 1) + g["__mu"]).alias("forecast"), F.sqrt(g["sigma2"] * lagged.dot(F.slice(w, F.lit(1), h), F.slice(w, F.lit(1), h))).alias("se")),
        )
        return let(points, lambda x: let(psi, lambda w: out(x, w)))

    given = F.struct("__x", "__mu", "__scale", "__ar", "__ma", "__fit", "__e", "sigma2", "p", "d", "sp", "sd", "s", steps.cast("int").alias("steps"))
    whole = let(given, lambda g: let(F.transform(F.slice(polynomial(g), F.lit(2), F.lit(1 << 30)), lambda v: -v), lambda weights: ahead(g, weights)))
    return fitted.withColumn("__fc", F.when(F.col("status") == FITTED, whole))
