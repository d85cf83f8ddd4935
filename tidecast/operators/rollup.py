"""One stored rollup of a sales fact, from which every descriptive section follows.

The fact is read once: one aggregate with three grouping sets gives a *cell* for each day and for each store (mergeable
moments of sales, and of sales against each numeric column) and a *bucket* table of the value distribution. All go to the
checkpoint folder. No section needs a store's days: cells of both together would be nearly as many as the rows. Months,
seasons, weekdays and years are merged from the days, the whole from the stores; correlations from the days, those with
the calendar's columns included, since these are constant within a day. Only the median, whiskers and histogram read the
fact again, once, for the values of the few buckets that decide them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import season, season_order, temporal_features, weekday0
from ..functions.numeric import safe_div
from ..session import cut_lineage
from . import eda
from .moments import merge, pair_state, pearson, single_state, stddev_samp, unpivot
from .quantile import distribution, exact_quantiles, log_bucket

CALENDAR = ("year", "month", "week", "day_of_week", "quarter", "day_of_year")
#: Names of the states within a cell: sales alone, and sales with each column.
OWN = "s_"
_DAY, _STORE, _BUCKET = 1, 2, 3


def _pair(column: str) -> str:
    return f"c_{column}_"


@dataclass(frozen=True)
class Rollup:
    fact: DataFrame
    days: DataFrame
    shops: DataFrame
    buckets: DataFrame
    keys: list[str]
    store: str
    date: str
    sales: str
    columns: list[str]


def rollup(fact: DataFrame, keys: Sequence[str] = (), columns: Sequence[str] = (), store: str = "store", date: str = "date", sales: str = "sales", by_day: bool = True) -> Rollup:
    """``columns``: numeric columns whose correlation with sales is wanted. ``by_day=False`` leaves the days out."""
    keys = list(keys)
    value = F.col(sales).cast("double")
    src = fact.withColumns({"__bucket": F.when(~F.isnan(value), log_bucket(value)), "__value": value})
    grain = [store, date] if by_day else [store]
    figures = [
        F.count(F.lit(1)).alias("records"),
        F.sum(sales).alias("total"),
        F.min(sales).alias("least"),
        F.max(sales).alias("most"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        *single_state(F.col("__value"), OWN),
    ]
    for c in columns:
        figures += pair_state(F.col("__value"), F.col(f"`{c}`"), _pair(c))
    # which of the sets a row belongs to: each leaves the others' columns out
    at = lambda c: F.grouping(c) == 0
    kind = F.when(at("__bucket"), _BUCKET)
    kind = (kind.when(at(date), _DAY) if by_day else kind).otherwise(_STORE).alias("kind")
    both = cut_lineage(src.groupingSets([[*keys, c] for c in [*grain, "__bucket"]], *keys, *grain, "__bucket").agg(kind, *figures))
    days, shops = (both.where(F.col("kind") == k).drop("kind", "__bucket", *(set(grain) - {own})) for k, own in ((_DAY, date), (_STORE, store)))
    buckets = both.where((F.col("kind") == _BUCKET) & F.col("__bucket").isNotNull())
    buckets = buckets.select(*keys, F.col("__bucket").alias("bucket"), F.col(f"{OWN}n").alias("c"), F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"))
    return Rollup(fact, days, shops, buckets, keys, store, date, sales, list(columns))


def _average() -> Column:
    return safe_div(F.sum("total"), F.sum(f"{OWN}n"))


def _deviation() -> Column:
    return stddev_samp(F.col(f"{OWN}xx"), F.col(f"{OWN}n"))


def overall(r: Rollup) -> DataFrame:
    more = [
        F.sum("total").alias("total_sales"),
        _average().alias("avg_sales"),
        F.min("least").alias("min_sales"),
        F.max("most").alias("max_sales"),
        F.coalesce(F.sum("records"), F.lit(0)).cast("long").alias("total_records"),
        F.count_distinct(r.store).alias("total_stores"),
        F.min("first_date").alias("date_range_start"),
        F.max("last_date").alias("date_range_end"),
    ]
    stats = merge(r.shops, r.keys, singles=[OWN], more=more).withColumn("std_dev", _deviation())
    stats = stats.select(*r.keys, "total_sales", "avg_sales", "std_dev", "min_sales", "max_sales", "total_records", "total_stores", "date_range_start", "date_range_end")
    median = exact_quantiles(r.fact, r.sales, [0.5], r.keys, ["median_sales"], buckets=r.buckets)
    return with_median(stats, median, r.keys)


def with_median(stats: DataFrame, median: DataFrame, keys: Sequence[str]) -> DataFrame:
    return stats.join(median, list(keys), "left") if keys else eda.attach_row(stats, median)


def _by(r: Rollup, column: Column) -> DataFrame:
    return r.days.groupBy(*r.keys, column).agg(F.sum("total").alias("total_sales"), _average().alias("avg_sales"), F.sum(f"{OWN}n").alias("record_count"))


def monthly(r: Rollup) -> DataFrame:
    return _by(r, F.date_format(F.col(r.date), "yyyy-MM").alias("month"))


def weekdays(r: Rollup) -> DataFrame:
    return eda.with_day_name(_by(r, weekday0(r.date).alias("day_of_week")))


def years(r: Rollup) -> DataFrame:
    return _by(r, F.year(r.date).alias("year"))


def daily(r: Rollup) -> DataFrame:
    return r.days.groupBy(*r.keys, r.date).agg(F.sum("total").alias(r.sales))


def seasons(r: Rollup) -> DataFrame:
    more = [_average().alias("avg_sales"), F.sum("total").alias("total_sales"), F.sum(f"{OWN}n").alias("records")]
    merged = merge(r.days.withColumn("season", season(F.month(r.date))), [*r.keys, "season"], singles=[OWN], more=more)
    return merged.select(*r.keys, "season", "avg_sales", "total_sales", "records", _deviation().alias("std_dev"), season_order("season").alias("season_order"))


def stores(r: Rollup) -> DataFrame:
    more = [_average().alias("avg_sales"), F.sum("total").alias("total_sales"), F.min("least").alias("min_sales"), F.max("most").alias("max_sales")]
    merged = merge(r.shops, [*r.keys, r.store], singles=[OWN], more=more)
    return eda.with_consistency(merged.select(*r.keys, r.store, "avg_sales", "total_sales", _deviation().alias("std_dev"), "min_sales", "max_sales", F.col(f"{OWN}n").alias("records")))


def correlations(r: Rollup, calendar: Sequence[str] = CALENDAR, top: int = 3) -> DataFrame:
    """Sales against the rollup's columns and the calendar's."""
    names = list(calendar) + r.columns
    cells = temporal_features(r.days, r.date)
    held, zero = F.col(f"{OWN}n"), F.lit(0.0)
    for c in calendar:
        parts = {"n": F.when(F.col(c).isNotNull(), held).otherwise(F.lit(0).cast("long")), "mx": F.col(f"{OWN}mx"), "my": F.when(held > 0, F.col(c).cast("double")), "xx": F.col(f"{OWN}xx"), "yy": zero, "xy": zero}
        cells = cells.withColumns({_pair(c) + p: v for p, v in parts.items()})
    merged = merge(cells, r.keys, pairs=[_pair(c) for c in names])
    return eda.ranked_correlations(unpivot(merged, r.keys, {c: pearson(_pair(c)) for c in names}, value="r"), r.keys, r.sales, top)


def charts(r: Rollup, bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Box-plot figures and histogram, from the fact's second read."""
    return distribution(r.fact, r.sales, r.keys, bins, buckets=r.buckets)
