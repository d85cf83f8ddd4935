"""Lag products, regressions on lags and their tail probabilities, as expressions over one array per series.

A period table has one row per series and period, so that a series is bounded by its calendar: it is gathered once, in
order, into an array, and everything that depends on a number of lags which the data decide (long-run variances,
regressions of every lag count) is a higher-order expression on it. No Python worker is involved.

``sweep`` solves regressions: sweeping the cross-product matrix of (columns, response) on its columns one after the
other leaves, after each, the residual sum of squares of the regression on the columns so far, its coefficients, and the
inverse of their cross products. One matrix per series so answers all nested lag counts. ``triangle`` and ``forward`` answer
them from a triangular factor, at a sixth of the products.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attach import attach_row
from ..functions.numeric import safe_div

#: A column this close to a combination of those before it, as a share of its squares, adds nothing to a regression.
COLLINEAR = 1e-10


def series_arrays(series: DataFrame, keys: Sequence[str], period: str, value: str, out: str = "__x", n: str = "__n") -> DataFrame:
    """keys, ``out`` (the values in order of their periods, without NULL and NaN), ``n`` (how many)."""
    return present(whole_arrays(series, keys, period, value, out), out, n)


def whole_arrays(series: DataFrame, keys: Sequence[str], period: str, value: str, out: str = "__x") -> DataFrame:
    """keys, ``out`` (the values in order of their periods, NULL where one has none)."""
    held = F.collect_list(F.struct(F.col(period).alias("p"), F.col(value).cast("double").alias("v")))
    return series.groupBy(*keys).agg(F.transform(F.array_sort(held), lambda s: s["v"]).alias(out))


def present(arrays: DataFrame, out: str = "__x", n: str = "__n") -> DataFrame:
    """``out`` without NULL and NaN, and ``n``, how many are left."""
    return arrays.withColumn(out, F.filter(out, lambda v: v.isNotNull() & ~F.isnan(v))).withColumn(n, F.size(out))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays of one length."""
    return total(F.zip_with(a, b, lambda x, y: x * y))


def lag_product(e: Column, n: Column, k: Column) -> Column:
    """Sum over t of e[t] e[t - k]."""
    left = F.greatest(n - k, F.lit(0))
    return dot(F.slice(e, k + 1, left), F.slice(e, F.lit(1), left))


def weighted_lags(e: Column, n: Column, lags: Column, weight) -> Column:
    """Sum over k = 1 .. lags of weight(k) times the lag product."""
    each = F.filter(F.sequence(F.lit(0), lags), lambda k: k > 0)
    return F.aggregate(each, F.lit(0.0), lambda s, k: s + weight(k) * lag_product(e, n, k))


def running_squares(e: Column) -> Column:
    """Sum of the squared running totals."""
    start = F.struct(F.lit(0.0).alias("at"), F.lit(0.0).alias("sum"))
    step = lambda s, v: F.struct((s["at"] + v).alias("at"), (s["sum"] + (s["at"] + v) * (s["at"] + v)).alias("sum"))
    return F.aggregate(e, start, step, lambda s: s["sum"])


def normal_cdf(z: Column) -> Column:
    """Φ(z) by the series z + z³/3 + z⁵/15 + …, to full precision where it isn't 0 or 1."""
    near = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    start = F.struct(near.alias("term"), near.alias("sum"))

    def step(s, k):
        term = s["term"] * near * near / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), start, step, lambda s: s["sum"])
    density = F.exp(-near * near / 2) / math.sqrt(2 * math.pi)
    return F.when(z.isNotNull(), F.greatest(F.least(0.5 + density * series, F.lit(1.0)), F.lit(0.0)))


# Fixed values (published constants). Wichura (1988), the 7-figure normal quantile: numerators and denominators by
# rising powers, for the middle (|p - 1/2| <= 0.425), the tails and the far tails.
QUANTILE_MIDDLE = ((3.3871327179, 50.434271938, 159.29113202, 59.109374720), (1.0, 17.895169469, 78.757757664, 67.187563600))
QUANTILE_TAIL = ((1.4234372777, 2.7568153900, 1.3067284816, 0.17023821103), (1.0, 0.73700164250, 0.12021132975))
QUANTILE_FAR = ((6.6579051150, 3.0812263860, 0.42868294337, 0.017337203997), (1.0, 0.24197894225, 0.012258202635))
# Royston (1993): ln(1 - W') of normal samples has mean a + b (ln u - u) and deviation c + d (ln u + 2 / u), u = ln n.
FRANCIA_MEAN = (-1.2725, 1.0521)
FRANCIA_DEVIATION = (1.0308, -0.26758)
#: Fewer values than this have no p-value.
FRANCIA_LEAST = 5


def normal_quantile(p: Column) -> Column:
    """z with Φ(z) = p, to seven figures, for p strictly between 0 and 1."""

    def ratio(table, r):
        top, bottom = ([c * r**i for i, c in enumerate(part)] for part in table)
        return sum(top, F.lit(0.0)) / sum(bottom, F.lit(0.0))

    q = p - 0.5
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    far = F.when(tail <= 5, ratio(QUANTILE_TAIL, tail - 1.6)).otherwise(ratio(QUANTILE_FAR, tail - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(QUANTILE_MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * far)


def chi_square_tail(x: Column, even: int) -> Column:
    """Chance of more than ``x`` with an even number of degrees of freedom: a Poisson sum."""
    half = x / 2
    return F.exp(-half) * sum((half**i / math.factorial(i) for i in range(1, even // 2)), F.lit(1.0))


def cross_products(columns: Column) -> Column:
    return F.transform(columns, lambda a: F.transform(columns, lambda b: dot(a, b)))


def sweep(m: Column, p: Column, size: Column, scale: Column) -> Column:
    """The matrix swept on column ``p`` (from 0); unchanged where the column is a combination of those before.

    ``scale``: the diagonal before any sweep.
    """
    at = lambda i, j: F.get(F.get(m, i), j)
    d = at(p, p)
    each = F.sequence(F.lit(0), size - 1)

    def cell(i, j):
        inner = at(i, j) - at(i, p) * at(p, j) / d
        return F.when((i == p) & (j == p), 1 / d).when(i == p, at(p, j) / d).when(j == p, -at(i, p) / d).otherwise(inner)

    return F.when(d > F.lit(COLLINEAR) * F.get(scale, p), F.transform(each, lambda i: F.transform(each, lambda j: cell(i, j)))).otherwise(m)


def swept(m: Column, size: Column) -> Column:
    """(m, left): the matrix swept on all columns but the last, and the response's residual squares after each."""
    scale = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(F.get(m, i), i))
    start = F.struct(m.alias("m"), F.array().cast("array<double>").alias("left"))

    # the matrix before a sweep travels along, so that what is left after it is read one step later
    def step(s, p):
        left = F.when(p > 0, F.concat(s["left"], F.array(corner(s["m"])))).otherwise(s["left"])
        return F.struct(sweep(s["m"], p, size, scale).alias("m"), left.alias("left"))

    corner = lambda x: F.get(F.get(x, size - 1), size - 1)
    end = lambda s: F.struct(s["m"].alias("m"), F.concat(s["left"], F.array(corner(s["m"]))).alias("left"))
    return F.aggregate(F.sequence(F.lit(0), size - 2), start, step, end)


def forward(factor: Column, g: Column) -> Column:
    """Solution of (lower triangle ``factor``) x = g; 0 in the places of columns that take no part."""

    def entry(a, row):
        left = F.get(g, F.size(a)) - dot(a, F.slice(row, F.lit(1), F.size(a)))
        return F.concat(a, F.array(F.coalesce(safe_div(left, F.get(row, F.size(a))), F.lit(0.0))))

    return F.aggregate(factor, F.array().cast("array<double>"), entry)


def triangle(gram: Column) -> Column:
    """Lower Cholesky factor of ``gram``, row by row, both as rows that end at the diagonal.

    A column that is a combination of those before has 0 on the diagonal, and takes no part in what follows.
    """

    def row(f, g):
        own, d = forward(f, g), F.get(g, F.size(f))
        left = lambda a: d - dot(a, a)
        root = lambda x: F.when(x > F.lit(COLLINEAR) * d, F.sqrt(x)).otherwise(0.0)
        ended = lambda a: F.concat(a, F.transform(F.array(left(a)), root))
        return F.concat(f, F.transform(F.array(own), ended))

    return F.aggregate(gram, F.array().cast("array<array<double>>"), row)


def residual_autocorrelation(residuals: DataFrame, keys: Sequence[str] = (), lags: int = 10, period: str = "period", value: str = "residual") -> DataFrame:
    """keys, lag, r, q, p_value, n: autocorrelations of any residual table, with the portmanteau statistic up to ``lags``.

    All lags come from one window over the series and one aggregate. q and p_value are those of all ``lags`` (an even
    number) together; a flat series has none.
    """
    keys = list(keys)
    if lags % 2:
        raise ValueError("lags must be even")
    rows = residuals.where(F.col(value).isNotNull())
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("__mean"))
    e = attach_row(rows.select(*keys, period, value), mean, keys).withColumn("e", F.col(value) - F.col("__mean"))
    w = Window.partitionBy(*keys).orderBy(period) if keys else Window.orderBy(period)
    e = e.withColumns({f"l{k}": F.lag("e", k).over(w) for k in range(1, lags + 1)})
    sums = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("e") * F.col("e")).alias("s0"), *[F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0)).alias(f"s{k}") for k in range(1, lags + 1)])
    r = [safe_div(F.col(f"s{k}"), F.when(F.col("s0") > 0, F.col("s0"))) for k in range(1, lags + 1)]
    n = F.col("n")
    q = n * (n + 2) * sum((safe_div(x * x, F.when(n > k, n - k)) for k, x in enumerate(r, 1)), F.lit(0.0))
    sums = sums.withColumn("q", q).withColumn("p_value", chi_square_tail(F.col("q"), lags))
    each = F.array(*[F.struct(F.lit(k).alias("lag"), x.alias("r")) for k, x in enumerate(r, 1)])
    return sums.select(*keys, F.inline(each), "q", "p_value", "n")


def francia_p(w: Column, n: Column) -> Column:
    """Chance of a normal sample of ``n`` values having a W' below ``w``; NULL for fewer than five."""
    u = F.when(n >= FRANCIA_LEAST, F.log(n.cast("double")))
    mean = FRANCIA_MEAN[0] + FRANCIA_MEAN[1] * (F.log(u) - u)
    deviation = FRANCIA_DEVIATION[0] + FRANCIA_DEVIATION[1] * (F.log(u) + 2 / u)
    z = (F.log(F.greatest(1 - w, F.lit(1e-16))) - mean) / deviation
    return F.when(w.isNotNull(), 1 - normal_cdf(z))


def francia_of(centred: Column, n: Column) -> Column:
    """W' of an array of ``n`` values whose mean is zero; NULL if they don't vary."""
    score = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: normal_quantile((i - 0.375) / (n + 0.25)))
    both = F.get(F.transform(F.array(F.struct(score.alias("m"), F.array_sort(centred).alias("x"))), lambda g: safe_div(F.pow(dot(g["m"], g["x"]), F.lit(2.0)), dot(g["m"], g["m"]) * dot(g["x"], g["x"]))), F.lit(0))
    return F.when(F.array_max(centred) > F.array_min(centred), F.least(both, F.lit(1.0)))


def residual_normality(residuals: DataFrame, keys: Sequence[str] = (), value: str = "residual") -> DataFrame:
    """keys, n, w_stat, p_value, is_normal: are the residuals of each series normal? By their order statistics.

    Shapiro and Francia's W': the squared correlation of the sorted values with their normal scores (Blom's
    (rank - 3/8) / (n + 1/4)), from one window and one aggregate; p by Royston's normalising transform, made for 5 to 5000
    values. NULL and NaN don't count; a flat series has neither figure, one of fewer than five values no p_value; a
    series without a value has no row. Ties may rank in any order, as their scores meet the same value.
    """
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = residuals.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"__n": F.count(F.lit(1)).over(w), "__e": F.col("__v") - F.avg("__v").over(w), "__rank": F.row_number().over(w.orderBy("__v"))})
    rows = rows.withColumn("__m", normal_quantile((F.col("__rank") - 0.375) / (F.col("__n") + 0.25)))
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("__m") * F.col("__e")).alias("__me"), F.sum(F.col("__m") * F.col("__m")).alias("__mm"),
        F.sum(F.col("__e") * F.col("__e")).alias("__ee"), (F.max("__v") > F.min("__v")).alias("__varies"),
    ).where(F.col("n") > 0)
    share = F.when(F.col("__varies"), F.least(safe_div(F.col("__me") * F.col("__me"), F.col("__mm") * F.col("__ee")), F.lit(1.0)))
    sums = sums.withColumn("w_stat", share)
    sums = sums.withColumn("p_value", francia_p(F.col("w_stat"), F.col("n")))
    return sums.select(*keys, "n", "w_stat", "p_value", (F.col("p_value") > 0.05).alias("is_normal"))
