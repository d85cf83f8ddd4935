"""Data-quality checks as DataFrame assertions.

Each check returns a *violations* table (empty = pass) and/or a one-row
``(check, checked, violations, passed)`` result; ``report`` folds any number of
results into totals and a pass rate with one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attach import attach_row
from ..functions.numeric import round_half_up


def _result(name: str, checked: DataFrame, violations: DataFrame) -> DataFrame:
    c = checked.agg(F.count(F.lit(1)).alias("checked"))
    v = violations.agg(F.count(F.lit(1)).alias("violations"))
    return attach_row(c, v).select(
        F.lit(name).alias("check"), "checked", "violations", (F.col("violations") == 0).alias("passed")
    )


def tenant_isolation(stored: DataFrame, row_key: Sequence[str], tenant: str = "user_id") -> DataFrame:
    """Q1: row keys that appear under more than one tenant (aggregate, map-side combined)."""
    return stored.groupBy(*row_key).agg(F.count_distinct(tenant).alias("tenants")).where(F.col("tenants") > 1)


def forecast_bounds(fc: DataFrame, history: DataFrame, keys: Sequence[str] = (), value: str = "value", z_max: float = 3.0) -> DataFrame:
    """Q2: forecasts that are negative, not finite, or |z| ≥ 3 against the history of their series."""
    keys = list(keys)
    h = history.groupBy(*keys).agg(F.avg(value).alias("__mu"), F.stddev_samp(value).alias("__sd"))
    j = attach_row(fc, h, keys, "left")
    z = F.try_divide(F.col("forecast") - F.col("__mu"), F.col("__sd"))
    bad_num = F.col("forecast").isNull() | F.isnan("forecast") | (F.abs(F.col("forecast")) == float("inf"))
    reason = (
        F.when(bad_num, "not finite")
        .when(F.col("forecast") < 0, "negative")
        .when(F.abs(z) >= z_max, "outside 3 sigma")
    )
    return j.select(*keys, "step", "forecast", z.alias("z"), reason.alias("reason")).where(F.col("reason").isNotNull())


def ci_consistency(fc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Q3: rows with lower > forecast or forecast > upper, or a CI narrower than the previous step."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("step") if keys else Window.orderBy("step")
    width = F.col("upper_ci") - F.col("lower_ci")
    x = fc.withColumns({"__w": width, "__pw": F.lag(width).over(w)})
    reason = (
        F.when(F.col("lower_ci") > F.col("forecast"), "lower above forecast")
        .when(F.col("forecast") > F.col("upper_ci"), "forecast above upper")
        .when(F.col("__w") < F.col("__pw") - 1e-9 * F.abs(F.col("__pw")), "width shrinks")
    )
    return x.select(*keys, "step", reason.alias("reason")).where(F.col("reason").isNotNull())


def seasonality_indices(series: DataFrame, keys: Sequence[str] = (), period: str = "period", value: str = "value", tol: float = 0.25) -> DataFrame:
    """Q4: monthly seasonal indices (month mean ÷ overall mean) should sum to the number of months (12)."""
    keys = list(keys)
    m = series.groupBy(*keys, F.month(period).alias("month")).agg(F.sum(value).alias("__sum"), F.count(value).alias("__n"))
    g = m.groupBy(*keys).agg(
        F.sum(F.col("__sum") / F.col("__n")).alias("__s"), (F.sum("__sum") / F.sum("__n")).alias("__mu"), F.count(F.lit(1)).alias("months")
    )
    s = g.withColumn("index_sum", F.try_divide(F.col("__s"), F.col("__mu")))
    return s.select(*keys, "months", "index_sum", (F.abs(F.col("index_sum") - F.col("months")) <= tol).alias("passed"))


def arima_order_range(orders: DataFrame, max_p: int = 5, max_d: int = 2, max_q: int = 5) -> DataFrame:
    """Q5: fitted (p, d, q) outside 0..5 / 0..2 / 0..5."""
    ok = F.col("p").between(0, max_p) & F.col("d").between(0, max_d) & F.col("q").between(0, max_q)
    return orders.where(~ok)


def series_completeness(series: DataFrame, freq: str = "D", keys: Sequence[str] = (), period: str = "period", value: str = "value") -> DataFrame:
    """Q6: per series, calendar periods with no row (anti-join against the generated calendar) and NULL values."""
    from .series import calendar

    keys = list(keys)
    cal = calendar(series, freq, keys, period)
    missing = cal.join(series, [*keys, period], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("missing_periods"))
    nulls = series.groupBy(*keys).agg(F.count_if(F.col(value).isNull()).alias("null_values"), F.count(F.lit(1)).alias("points"))
    j = attach_row(nulls, missing, keys, "left")
    j = j.fillna({"missing_periods": 0})
    return j.withColumn("passed", (F.col("missing_periods") == 0) & (F.col("null_values") == 0))


def value_range(df: DataFrame, column: str, min_val: float | None = None, max_val: float | None = None) -> DataFrame:
    """Q7: rows whose value is below ``min_val`` or above ``max_val`` (either bound optional)."""
    c = F.col(column)
    cond = F.lit(False)
    if min_val is not None:
        cond = cond | (c < min_val)
    if max_val is not None:
        cond = cond | (c > max_val)
    return df.where(cond | c.isNull())


def report(results: Sequence[DataFrame]) -> DataFrame:
    """Q8: total / passed / failed / pass-rate (2 dp) over check results."""
    u = results[0]
    for r in results[1:]:
        u = u.unionByName(r)
    g = u.agg(F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed_checks"))
    return g.select(
        "total_checks", "passed_checks", (F.col("total_checks") - F.col("passed_checks")).alias("failed_checks"),
        round_half_up(F.col("passed_checks") / F.col("total_checks") * 100, 2).alias("pass_rate"),
    )


check_result = _result
