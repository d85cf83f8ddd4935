"""Order-dependent operators over long series tables ``(keys…, order, value)``.

Every window is partitioned by the series keys, so work spreads across series
and each task holds one series (bounded by its calendar length: months, weeks
or days). Series are aggregated to periods *before* these run, never raw facts.
An empty ``keys`` means a single series (one partition of ≤ calendar rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import pct_change, round_half_up, safe_div

# Trend arrows and the ±2 % dead band.
UP, DOWN, FLAT = "↑", "↓", "→"
TREND_BAND = 2.0


def _w(keys: Sequence[str], order) -> Window:
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)


def _direction(pct: Column) -> Column:
    return F.when(pct > TREND_BAND, UP).when(pct < -TREND_BAND, DOWN).otherwise(FLAT)


def period_trend(df: DataFrame, order: str = "period", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """win_trend: change % vs the previous period (0 for the first / zero base), arrow with ±2 % band."""
    prev = F.lag(value).over(_w(keys, order))
    chg = F.when(prev.isNull(), F.lit(0.0)).otherwise(F.coalesce(pct_change(F.col(value), prev), F.lit(0.0)))
    return df.withColumn("change_pct", round_half_up(chg, 2)).withColumn("direction", _direction(F.col("change_pct")))


def month_growth(df: DataFrame, value: str = "mean", order: str = "month_num", keys: Sequence[str] = ()) -> DataFrame:
    """win_month_growth: % change of a monthly profile vs the previous calendar month (NULL for the first)."""
    prev = F.lag(value).over(_w(keys, order))
    return df.withColumn("growth_rate", pct_change(F.col(value), prev))


def prediction_trend(df: DataFrame, base: str, order: str = "date", value: str = "predicted_sales", keys: Sequence[str] = ()) -> DataFrame:
    """win_pred_trend: each prediction vs the previous one; the first vs the historical mean ``base``."""
    prev = F.coalesce(F.lag(value).over(_w(keys, order)), F.col(base))
    pct = F.when(prev > 0, pct_change(F.col(value), prev)).otherwise(F.lit(0.0))
    return df.withColumn("trend_pct", pct).withColumn(
        "trend_direction", F.when(F.col("trend_pct") > TREND_BAND, "Up").when(F.col("trend_pct") < -TREND_BAND, "Down").otherwise("Stable")
    )


def lags(df: DataFrame, n: int = 12, order: str = "period", value: str = "value", keys: Sequence[str] = (), prefix: str = "lag_") -> DataFrame:
    """win_lags: lag_1..lag_n computed in one Window node."""
    w = _w(keys, order)
    return df.withColumns({f"{prefix}{i}": F.lag(value, i).over(w) for i in range(1, n + 1)})


def difference(df: DataFrame, d: int = 1, order: str = "period", value: str = "value", keys: Sequence[str] = (), out: str = "diff") -> DataFrame:
    """win_diff: d-th order difference (repeated first differences); the first d rows are dropped."""
    w = _w(keys, order)
    cur = df.withColumn(out, F.col(value).cast("double")).withColumn("__rn", F.row_number().over(w))
    for _ in range(d):
        cur = cur.withColumn(out, F.col(out) - F.lag(out).over(w))
    return cur.where(F.col("__rn") > d).drop("__rn")


def seasonal_difference(
    df: DataFrame, s: int = 12, order: str = "period", value: str = "value", keys: Sequence[str] = (), out: str = "sdiff"
) -> DataFrame:
    """win_sdiff: x_t - x_{t-s}; needs s > 1 and at least 2s points per series (else no rows)."""
    if s <= 1:
        raise ValueError("seasonal period must be > 1")
    w = _w(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys)) if keys else F.count(F.lit(1)).over(Window.partitionBy())
    cur = df.withColumns({out: F.col(value) - F.lag(value, s).over(w), "__n": n})
    return cur.where(F.col(out).isNotNull() & (F.col("__n") >= 2 * s)).drop("__n")


def step_pct_change(df: DataFrame, order: str = "period", value: str = "value", keys: Sequence[str] = (), out: str = "pct_change") -> DataFrame:
    """win_pct_change: step % change; first row (no predecessor) dropped."""
    prev = F.lag(value).over(_w(keys, order))
    return (
        df.withColumn("__prev", prev)
        .withColumn(out, safe_div(F.col(value) - F.col("__prev"), F.col("__prev")) * 100)
        .where(F.col("__prev").isNotNull())
        .drop("__prev")
    )


def halves(df: DataFrame, order: str = "period", keys: Sequence[str] = ()) -> DataFrame:
    """win_halves: label each point 1 (first half, the first floor(n/2)) or 2 by position."""
    rn = F.row_number().over(_w(keys, order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("half", F.when(rn <= F.floor(n / 2), 1).otherwise(2))


def train_test_split(df: DataFrame, fraction: float = 0.8, order: str = "period", keys: Sequence[str] = ()) -> DataFrame:
    """win_train_test: chronological split; the first floor(n·f) points are train."""
    rn = F.row_number().over(_w(keys, order))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("split", F.when(rn <= F.floor(n * F.lit(fraction)), "train").otherwise("test"))


def first_last(df: DataFrame, order: str = "period", value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """win_first_last: last vs first value as an aggregate (min_by/max_by, no window)."""
    g = df.groupBy(*keys).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))
    return g.withColumns(
        {
            "change": F.col("last_value") - F.col("first_value"),
            "change_pct": pct_change(F.col("last_value"), F.col("first_value")),
            "trend": F.when(F.col("last_value") > F.col("first_value"), "increasing").otherwise("decreasing"),
        }
    )


def intervals(df: DataFrame, order: str = "period", keys: Sequence[str] = ()) -> DataFrame:
    """win_intervals: distinct day gaps between consecutive dates per series."""
    gap = F.datediff(F.col(order), F.lag(order).over(_w(keys, order)))
    g = df.withColumn("gap_days", gap).where(F.col("gap_days").isNotNull())
    return g.groupBy(*keys).agg(
        F.count_distinct("gap_days").alias("distinct_gaps"),
        F.min("gap_days").alias("min_gap"),
        F.max("gap_days").alias("max_gap"),
        F.sort_array(F.collect_set("gap_days")).alias("gaps"),
    )
