"""Time-series preparation on long tables ``(keys…, period DATE, value DOUBLE)``.

Raw facts are reduced to one row per (series, period) by an aggregate with
map-side combine *first*; everything after works on the period table, whose
size per series is bounded by the calendar. Calendars are generated per series
with ``sequence`` (no driver loops) and attached with an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attach import attach_row
from ..functions.calendar import month_start, week_ending_sunday

PERIOD, VALUE = "period", "value"

# Frequency codes and their calendar step.
FREQ_STEP = {"D": "1 day", "W": "7 days", "MS": "1 month"}


def period_key(date_col, freq: str) -> Column:
    d = F.col(date_col) if isinstance(date_col, str) else date_col
    if freq == "D":
        return d.cast("date")
    if freq == "W":
        return week_ending_sunday(d)
    if freq == "MS":
        return month_start(d)
    raise ValueError(f"unknown frequency {freq!r}")


def store_series(fact: DataFrame, store_id, store: str = "store", date: str = "date", sales: str = "sales") -> DataFrame:
    """flt_store: one store's daily totals. A missing / non-positive numeric id is an error."""
    sid = "" if store_id is None else str(store_id).strip()
    if not sid or (sid.lstrip("-").isdigit() and int(sid) <= 0):
        raise ValueError(f"invalid store id {store_id!r}")
    one = fact.where(F.col(store) == F.lit(sid))
    return one.groupBy(date).agg(F.sum(sales).alias(sales), F.count(F.lit(1)).alias("records"))


def positive_only(series: DataFrame, value: str = VALUE) -> DataFrame:
    """flt_positive: drop periods whose value is not > 0."""
    return series.where(F.col(value) > 0)


def index_series(df: DataFrame, date: str = "date", value: str = "sales", keys: Sequence[str] = ()) -> DataFrame:
    """ts_index: typed (keys, period DATE, value DOUBLE) key columns."""
    return df.select(*keys, F.col(date).cast("date").alias(PERIOD), F.col(value).cast("double").alias(VALUE))


def aggregate(
    fact: DataFrame, freq: str = "MS", keys: Sequence[str] = (), date: str = "date", sales: str = "sales",
    positive: bool = True,
) -> DataFrame:
    """ts_daily / ts_weekly / ts_monthly: sum per period (W = weeks ending Sunday, MS = month start)."""
    s = fact.groupBy(*keys, period_key(date, freq).alias(PERIOD)).agg(F.sum(sales).alias(VALUE))
    return positive_only(s) if positive else s


def series_stats(series: DataFrame, keys: Sequence[str] = (), period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """Aggregation statistics per series (periods, range, mean/std/min/max, spanned weeks)."""
    return series.groupBy(*keys).agg(
        F.count(value).alias("periods"),
        F.min(period).alias("date_range_start"),
        F.max(period).alias("date_range_end"),
        (F.datediff(F.max(period), F.min(period)) / 7.0).alias("total_weeks"),
        F.avg(value).alias("avg_sales"),
        F.stddev_samp(value).alias("std_sales"),
        F.min(value).alias("min_sales"),
        F.max(value).alias("max_sales"),
    )


def calendar(series: DataFrame, freq: str = "D", keys: Sequence[str] = (), period: str = PERIOD) -> DataFrame:
    """Complete calendar from each series' first to last period (one ``sequence`` per series)."""
    bounds = series.groupBy(*keys).agg(F.min(period).alias("__lo"), F.max(period).alias("__hi"))
    step = F.expr(f"INTERVAL {FREQ_STEP[freq]}")
    return bounds.select(*keys, F.explode(F.sequence("__lo", "__hi", step)).alias(period))


def complete(
    series: DataFrame, freq: str = "D", keys: Sequence[str] = (), period: str = PERIOD, fill_value: float | None = None
) -> DataFrame:
    """jn_calendar: left join calendar ← data; missing periods NULL (or ``fill_value``)."""
    cal = calendar(series, freq, keys, period)
    j = cal.join(series, [*keys, period], "left")
    if fill_value is not None:
        j = j.fillna({c: fill_value for c in series.columns if c not in (*keys, period)})
    return j


def fixed_intervals(series: DataFrame, freq: str = "D", keys: Sequence[str] = (), period: str = PERIOD, value: str = VALUE) -> DataFrame:
    """ts_fixed: complete calendar, forward fill then backward fill; ``filled`` marks inserted periods."""
    from .clean import carry_forward, edge_value

    j = complete(series.withColumn("__present", F.lit(True)), freq, keys, period)
    filled = F.coalesce(F.col(value), carry_forward(value, keys, period), edge_value(value, keys, period))
    return j.select(*keys, period, filled.alias(value), F.col("__present").isNull().alias("filled"))


def fill_stats(fixed: DataFrame, freq: str, keys: Sequence[str] = (), period: str = PERIOD) -> DataFrame:
    return fixed.groupBy(*keys).agg(
        F.count_if(~F.col("filled")).alias("original_length"),
        F.count(F.lit(1)).alias("final_length"),
        F.count_if(F.col("filled")).alias("missing_periods_filled"),
        F.lit(freq).alias("frequency"),
        F.min(period).alias("date_range_start"),
        F.max(period).alias("date_range_end"),
    )


def validate(
    series: DataFrame, keys: Sequence[str] = (), min_periods: int = 10, period: str = PERIOD, value: str = VALUE
) -> DataFrame:
    """ts_validate: one row per series with ``is_valid``, ``issues`` and ``warnings`` arrays and metadata."""
    w = Window.partitionBy(*keys).orderBy(period) if keys else Window.orderBy(period)
    gaps = series.withColumn("__gap", F.datediff(F.col(period), F.lag(period).over(w)))
    base = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("length"),
        F.count_if(F.col(value).isNull() | F.isnan(value)).alias("nan_count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.min(period).alias("start_date"),
        F.max(period).alias("end_date"),
        F.count_distinct("__gap").alias("distinct_intervals"),
    )
    # Outliers need the series mean/std: second pass joined on the keys (one row per series).
    joined = attach_row(series, base.select(*keys, "mean", "std"), keys)
    out = joined.groupBy(*keys).agg(F.count_if(F.abs(F.col(value) - F.col("mean")) > 5 * F.col("std")).alias("outliers"))
    res = attach_row(base, out, keys, "left")
    nan_pct = F.col("nan_count") / F.col("length") * 100
    issues = F.array_compact(
        F.array(
            F.when(F.col("length") < min_periods, F.format_string("Series length (%d) is less than minimum (%d)", F.col("length"), F.lit(min_periods))),
            F.when(nan_pct > 20, F.format_string("Too many NaN values (%.1f%%)", nan_pct)),
            F.when(F.col("std") == 0, F.lit("Series has no variation (constant values)")),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when((nan_pct > 0) & (nan_pct <= 20), F.format_string("Series has %d NaN values (%.1f%%)", F.col("nan_count"), nan_pct)),
            F.when(
                F.col("outliers") > 0,
                F.format_string("Found %d potential outliers (%.1f%%)", F.col("outliers"), F.col("outliers") / F.col("length") * 100),
            ),
            F.when(F.col("distinct_intervals") > 1, F.format_string("Series has %d different time intervals", F.col("distinct_intervals"))),
        )
    )
    return res.withColumns({"issues": issues, "warnings": warnings}).withColumn("is_valid", F.size("issues") == 0)


def prepare(
    fact: DataFrame, freq: str = "MS", keys: Sequence[str] = (), date: str = "date", sales: str = "sales",
    ensure_intervals: bool = True, min_periods: int = 10,
):
    """ts_prepare: aggregate → fixed intervals → validate. Returns (series, validation)."""
    s = aggregate(fact, freq, keys, date, sales, positive=True)
    if ensure_intervals:
        s = fixed_intervals(s, freq, keys).drop("filled")
    return s, validate(s, keys, min_periods)
