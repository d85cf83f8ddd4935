"""Mergeable moments of columns and column pairs.

A *state* is what a group of rows says about a pair (x, y) of columns: the number of rows that hold both, their means,
and the sums of squared and crossed deviations from them. States are computed from rows in one aggregate, can be stored,
and states of finer groups merge into those of coarser ones without going back to the rows. Merging takes each state's
deviation from the merged mean, so that nothing is lost to cancellation however far a column lies from zero.

What follows from a state never fails: a group of no or one row, or a constant column, has no correlation (NULL).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.attach import attach_row
from ..functions.numeric import clip, safe_div

#: Parts of a pair's state: rows, both means, squared deviations of either, crossed deviations.
PARTS = ("n", "mx", "my", "xx", "yy", "xy")


def both_held(x: Column, y: Column) -> tuple[Column, Column]:
    """x and y as doubles, NULL where either is NULL or NaN."""
    x, y = x.cast("double"), y.cast("double")
    held = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    return F.when(held, x), F.when(held, y)


def _varies(x: Column) -> Column:
    return F.min(x) < F.max(x)


def _mean(x: Column) -> Column:
    # a constant column's mean is that value to the last bit, which a sum divided by a count may miss
    return F.when(_varies(x), F.avg(x)).otherwise(F.min(x))


def _squares(x: Column) -> Column:
    return F.when(_varies(x), F.var_pop(x) * F.count(x)).otherwise(F.lit(0.0))


def pair_state(x: Column, y: Column, name: str = "") -> list[Column]:
    """Aggregates ``<name>n`` … ``<name>xy`` over a group's rows."""
    x, y = both_held(x, y)
    n = F.count(x)
    crossed = F.when(_varies(x) & _varies(y), F.covar_pop(x, y) * n).otherwise(F.lit(0.0))
    figures = (n, _mean(x), _mean(y), _squares(x), _squares(y), crossed)
    return [f.alias(name + p) for p, f in zip(PARTS, figures)]


def _bounded(r: Column) -> Column:
    return F.when(r.isNotNull(), clip(r, -1.0, 1.0))  # the bounds would stand in for a NULL


def pearson(name: str = "") -> Column:
    """Correlation of a state's pair; NULL where either column doesn't vary."""
    n, xx, yy, xy = (F.col(f"`{name}{p}`") for p in ("n", "xx", "yy", "xy"))
    r = safe_div(xy, F.sqrt(xx) * F.sqrt(yy))
    return F.when((n > 1) & (xx > 0) & (yy > 0), _bounded(r))


def correlation(x: Column, y: Column) -> Column:
    """The same as one aggregate over rows."""
    x, y = both_held(x, y)
    r = safe_div(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))
    return F.when(_varies(x) & _varies(y), _bounded(r))


def stddev_samp(squared: Column, n: Column) -> Column:
    """Sample deviation from summed squared deviations; NULL under two rows."""
    return F.when(n > 1, F.sqrt(F.greatest(safe_div(squared, n - 1), F.lit(0.0))))


def single_state(x: Column, name: str = "") -> list[Column]:
    """Aggregates ``<name>n``, ``<name>mx`` and ``<name>xx`` of one column."""
    return [F.count(x).alias(f"{name}n"), _mean(x).alias(f"{name}mx"), _squares(x).alias(f"{name}xx")]


def merge(states: DataFrame, keys: Sequence[str], pairs: Sequence[str] = (), singles: Sequence[str] = (), more: Sequence[Column] = ()) -> DataFrame:
    """One row of states per ``keys`` from states of finer groups: one aggregate for the means, one for the deviations.

    ``more``: further aggregates over the finer groups' rows.
    """
    keys = list(keys)
    part = lambda name, p: F.col(f"`{name}{p}`")
    axes = {name: ("mx", "my") for name in pairs} | {name: ("mx",) for name in singles}
    means = []
    for name, own in axes.items():
        n = F.sum(part(name, "n"))
        means.append(n.alias(f"{name}n_all"))
        for m in own:
            each = F.when(part(name, "n") > 0, part(name, m))
            mean = F.when(_varies(each), safe_div(F.sum(part(name, "n") * each), n)).otherwise(F.min(each))
            means.append(mean.alias(f"{name}{m}_all"))
    joined = attach_row(states, states.groupBy(*keys).agg(*means), keys)
    out = list(more)
    for name, own in axes.items():
        n = part(name, "n")
        away = {m: part(name, m) - F.col(f"`{name}{m}_all`") for m in own}
        out.append(F.max(f"`{name}n_all`").alias(f"{name}n"))
        out += [F.max(f"`{name}{m}_all`").alias(f"{name}{m}") for m in own]
        sums = {"xx": ("mx", "mx")} | ({"yy": ("my", "my"), "xy": ("mx", "my")} if len(own) > 1 else {})
        out += [F.sum(part(name, p) + n * away[a] * away[b]).alias(f"{name}{p}") for p, (a, b) in sums.items()]
    return joined.groupBy(*keys).agg(*out)


def unpivot(wide: DataFrame, keys: Sequence[str], columns: dict[str, Column], variable: str = "variable", value: str = "value") -> DataFrame:
    """One row per key and named column."""
    pairs = [F.struct(F.lit(c).alias(variable), v.alias(value)) for c, v in columns.items()]
    if not pairs:
        return wide.select(*keys, F.lit("").alias(variable), F.lit(None).cast("double").alias(value)).where("false")
    return wide.select(*keys, F.inline(F.array(*pairs)))
