"""Descriptive analytics over a canonical sales fact (``store, date, sales`` + extras).

Every function is a single declarative plan: partial (map-side) aggregation
then one shuffle on the grouping key. ``keys`` adds outer grouping columns
(tenant, region, category …) so one call answers every group at once.
Top-k selections use ``limit`` (TakeOrderedAndProject) when ungrouped and a
``row_number`` window partitioned by the outer keys otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.attach import attach_row
from ..functions.calendar import DAY_NAMES, season, season_order, weekday0
from ..functions.numeric import clip, round_half_up, safe_div
from .moments import correlation, unpivot
from .quantile import distribution

STORE, DATE, SALES = "store", "date", "sales"


def _keys(keys: Sequence[str] | None) -> list[str]:
    return list(keys or [])


def top_k(df: DataFrame, keys: Sequence[str], order: list, k: int, rank_col: str = "rank") -> DataFrame:
    """Top-k rows per group in ``order``; ungrouped → distributed TakeOrderedAndProject."""
    keys = _keys(keys)
    if not keys:
        return df.orderBy(*order).limit(k).withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


# --- agg_monthly ---------------------------------------------------------------------------
def monthly_trends(fact: DataFrame, keys: Sequence[str] = (), date: str = DATE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    return fact.groupBy(*keys, F.date_format(F.col(date), "yyyy-MM").alias("month")).agg(
        F.sum(sales).alias("total_sales"),
        F.avg(sales).alias("avg_sales"),
        F.count(sales).alias("record_count"),
    )


# --- agg_season / agg_season_strength -------------------------------------------------------
def seasonal_patterns(fact: DataFrame, keys: Sequence[str] = (), date: str = DATE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    s = F.col("season") if "season" in fact.columns else season(F.month(date))
    return (
        fact.groupBy(*keys, s.alias("season"))
        .agg(
            F.avg(sales).alias("avg_sales"),
            F.sum(sales).alias("total_sales"),
            F.count(sales).alias("records"),
            F.stddev_samp(sales).alias("std_dev"),
        )
        .withColumn("season_order", season_order("season"))
    )


def seasonality_strength(fact: DataFrame, keys: Sequence[str] = (), date: str = DATE, sales: str = SALES) -> DataFrame:
    """Sample std of the season means ÷ overall mean × 100 (2 dp); 0 when the mean is not positive."""
    return strength_of(seasonal_patterns(fact, keys, date, sales), keys)


def strength_of(seasons: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    per = seasons.groupBy(*_keys(keys)).agg(
        F.stddev_samp("avg_sales").alias("season_mean_std"),
        safe_div(F.sum("total_sales"), F.sum("records")).alias("overall_mean"),
        F.count(F.lit(1)).alias("seasons"),
    )
    return per.withColumn(
        "seasonality_strength",
        F.when(F.col("overall_mean") > 0, round_half_up(F.col("season_mean_std") / F.col("overall_mean") * 100, 2)).otherwise(
            F.lit(0.0)
        ),
    )


# --- agg_peak_low / agg_peak_gap -------------------------------------------------------------
def peak_low_periods(fact: DataFrame, keys: Sequence[str] = (), n: int = 5, date: str = DATE, sales: str = SALES) -> DataFrame:
    """Top-n and bottom-n months by total sales, with the average of each side."""
    keys = _keys(keys)
    return peak_low_of(fact.groupBy(*keys, F.date_format(F.col(date), "yyyy-MM").alias("month")).agg(F.sum(sales).alias("total_sales")), keys, n)


def peak_low_of(monthly: DataFrame, keys: Sequence[str] = (), n: int = 5) -> DataFrame:
    keys = _keys(keys)
    peak = top_k(monthly, keys, [F.desc("total_sales"), F.asc("month")], n).withColumn("kind", F.lit("peak"))
    low = top_k(monthly, keys, [F.asc("total_sales"), F.desc("month")], n).withColumn("kind", F.lit("low"))
    both = peak.unionByName(low)
    avg = both.groupBy(*keys, "kind").agg(F.avg("total_sales").alias("kind_average"))
    return both.join(avg, keys + ["kind"], "inner")


def peak_gap(fact: DataFrame, keys: Sequence[str] = (), n: int = 5, date: str = DATE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    pl = peak_low_periods(fact, keys, n, date, sales)
    g = pl.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "peak", F.col("kind_average"))).alias("peak_average"),
        F.max(F.when(F.col("kind") == "low", F.col("kind_average"))).alias("low_average"),
    )
    return g.withColumns(
        {
            "gap": F.col("peak_average") - F.col("low_average"),
            "gap_pct": safe_div(F.col("peak_average") - F.col("low_average"), F.col("low_average")) * 100,
        }
    )


# --- agg_store / agg_store_rank / agg_store_summary / agg_store_volatility ------------------------
def store_metrics(fact: DataFrame, keys: Sequence[str] = (), store: str = STORE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    m = fact.groupBy(*keys, store).agg(
        F.avg(sales).alias("avg_sales"),
        F.sum(sales).alias("total_sales"),
        F.stddev_samp(sales).alias("std_dev"),
        F.min(sales).alias("min_sales"),
        F.max(sales).alias("max_sales"),
        F.count(sales).alias("records"),
    )
    return with_consistency(m)


def with_consistency(m: DataFrame) -> DataFrame:
    return m.withColumn("consistency", 100 - clip(safe_div("std_dev", "avg_sales") * 100, 0, 100))


def store_ranking(fact: DataFrame, keys: Sequence[str] = (), n: int = 10, store: str = STORE, sales: str = SALES) -> DataFrame:
    return ranking_of(store_metrics(fact, keys, store, sales), keys, n, store)


def ranking_of(metrics: DataFrame, keys: Sequence[str] = (), n: int = 10, store: str = STORE) -> DataFrame:
    keys = _keys(keys)
    m = metrics.select(*keys, store, "avg_sales", "total_sales", "consistency")
    top = top_k(m, keys, [F.desc("avg_sales"), F.asc(store)], n).withColumn("kind", F.lit("top"))
    bottom = top_k(m, keys, [F.asc("avg_sales"), F.asc(store)], n).withColumn("kind", F.lit("bottom"))
    return top.unionByName(bottom)


def store_overview(fact: DataFrame, keys: Sequence[str] = (), store: str = STORE, sales: str = SALES) -> DataFrame:
    """Total stores, average of store means, best performer (ties → smallest id)."""
    return overview_of(store_metrics(fact, keys, store, sales), keys, store)


def overview_of(metrics: DataFrame, keys: Sequence[str] = (), store: str = STORE) -> DataFrame:
    return metrics.groupBy(*_keys(keys)).agg(
        F.count(F.lit(1)).alias("total_stores"),
        F.avg("avg_sales").alias("avg_store_sales"),
        F.min_by(store, F.struct(-F.col("avg_sales"), F.col(store))).alias("best_performer"),
        F.max("avg_sales").alias("best_performer_sales"),
    )


def store_summary(fact: DataFrame, keys: Sequence[str] = (), store: str = STORE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    return fact.groupBy(*keys, store).agg(
        F.avg(sales).alias("mean"),
        F.min(sales).alias("min"),
        F.max(sales).alias("max"),
        F.stddev_samp(sales).alias("std"),
    )


def store_volatility(fact: DataFrame, keys: Sequence[str] = (), n: int = 5, store: str = STORE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    m = store_metrics(fact, keys, store, sales)
    top = top_k(m, keys, [F.desc("avg_sales"), F.asc(store)], n)
    return top.select(*keys, store, "rank", "std_dev", (F.col("max_sales") - F.col("min_sales")).alias("sales_range"))


# --- agg_weekday / agg_year ------------------------------------------------------------------
def weekday_analysis(fact: DataFrame, keys: Sequence[str] = (), date: str = DATE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    g = fact.groupBy(*keys, weekday0(date).alias("day_of_week")).agg(
        F.avg(sales).alias("avg_sales"), F.sum(sales).alias("total_sales"), F.count(sales).alias("record_count")
    )
    return with_day_name(g)


def with_day_name(g: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    return g.withColumn("day_name", F.element_at(names, F.col("day_of_week") + 1))


def year_analysis(fact: DataFrame, keys: Sequence[str] = (), date: str = DATE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    return fact.groupBy(*keys, F.year(date).alias("year")).agg(
        F.sum(sales).alias("total_sales"), F.avg(sales).alias("avg_sales"), F.count(sales).alias("record_count")
    )


# --- agg_overall / agg_data_stats / agg_frame_summary ----------------------------------------------
def overall_statistics(
    fact: DataFrame, keys: Sequence[str] = (), store: str = STORE, date: str = DATE, sales: str = SALES
) -> DataFrame:
    """Totals, spread, exact median, stores and date range, from two reads of the fact."""
    from .rollup import overall, rollup

    return overall(rollup(fact, keys, store=store, date=date, sales=sales, by_day=False))


def data_stats(fact: DataFrame, keys: Sequence[str] = (), store: str = STORE, date: str = DATE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    g = fact.groupBy(*keys).agg(
        F.count_distinct(store).alias("stores"),
        F.count(F.lit(1)).alias("records"),
        F.avg(sales).alias("mean_sales"),
        F.max(sales).alias("max_sales"),
        F.min(sales).alias("min_sales"),
        F.stddev_samp(sales).alias("std_sales"),
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
    )
    return g.withColumn("weeks", F.floor(F.datediff("end_date", "start_date") / 7).cast("long"))


def frame_summary(fact: DataFrame, keys: Sequence[str] = (), date: str = DATE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    return fact.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
        F.sum(sales).alias("total_sales"),
        F.avg(sales).alias("avg_sales"),
        F.min(sales).alias("min_sales"),
        F.max(sales).alias("max_sales"),
        F.stddev_samp(sales).alias("std_sales"),
    )


# --- agg_corr ---------------------------------------------------------------------------
NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def correlation_analysis(
    fact: DataFrame, sales: str = SALES, columns: Sequence[str] | None = None, keys: Sequence[str] = (), top: int = 3
) -> DataFrame:
    """Pearson r of sales against every numeric column in ONE aggregate, unpivoted, ranked by |r|."""
    keys = _keys(keys)
    cols = list(columns) if columns is not None else numeric_columns(fact, exclude=[sales, *keys])
    wide = fact.groupBy(*keys).agg(*[correlation(F.col(sales), F.col(f"`{c}`")).alias(c) for c in cols])
    return ranked_correlations(unpivot(wide, keys, {c: F.col(f"`{c}`") for c in cols}, value="r"), keys, sales, top)


def ranked_correlations(long: DataFrame, keys: Sequence[str] = (), sales: str = SALES, top: int = 3) -> DataFrame:
    """(variable, r) rows that have a correlation, rounded, ranked by |r|, with a sentence on strong ones."""
    keys = _keys(keys)
    held = long.where(F.col("r").isNotNull()).withColumn("correlation", round_half_up("r", 3)).drop("r")
    order = [F.desc(F.abs("correlation")), F.asc("variable")]
    ranked = held.withColumn("abs_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)))
    sign = F.when(F.col("correlation") > 0, "rises").otherwise("falls")
    strong = (F.col("abs_rank") <= top) & (F.abs("correlation") > 0.5)
    return ranked.withColumn("insight", F.when(strong, F.format_string("%s: %s clearly with %s", F.lit(sales), sign, F.col("variable"))))


# --- agg_daily / agg_quartiles -----------------------------------------------------------------
def daily_totals(fact: DataFrame, keys: Sequence[str] = (), date: str = DATE, sales: str = SALES) -> DataFrame:
    keys = _keys(keys)
    return fact.groupBy(*keys, date).agg(F.sum(sales).alias(sales))


def daily_quartiles(fact: DataFrame, keys: Sequence[str] = (), date: str = DATE, sales: str = SALES) -> DataFrame:
    """Mean, median, std, min, max, q25, q75 of daily totals (one row per calendar day per group).

    The daily table is bounded by the calendar, so Spark's exact ``percentile`` runs in the
    same single aggregate (the multi-pass helper is for unbounded raw facts)."""
    keys = _keys(keys)
    daily = daily_totals(fact, keys, date, sales)
    return daily.groupBy(*keys).agg(
        F.avg(sales).alias("mean"),
        F.stddev_samp(sales).alias("std"),
        F.min(sales).alias("min"),
        F.max(sales).alias("max"),
        F.count(F.lit(1)).alias("days"),
        F.percentile(sales, 0.25).alias("q25"),
        F.percentile(sales, 0.5).alias("median"),
        F.percentile(sales, 0.75).alias("q75"),
    )


# --- agg_tenant_summary / agg_db_stats ----------------------------------------------------------
def tenant_summary(stored: DataFrame, tenant: str = "user_id", store: str = "store_id", date: str = DATE) -> DataFrame:
    return stored.groupBy(tenant).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct(store).alias("total_stores"),
        F.min(date).alias("min_date"),
        F.max(date).alias("max_date"),
    )


def db_stats(stored: DataFrame, tenant: str = "user_id", store: str = "store_id") -> DataFrame:
    return stored.agg(
        F.count_distinct(tenant).alias("total_users"),
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct(store).alias("total_stores"),
    )


# --- agg_describe -----------------------------------------------------------------------------
def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count / mean / stddev / min / max of every numeric column in ONE pass, long format."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"{c}__count"),
            F.avg(x).alias(f"{c}__mean"),
            F.stddev_samp(x).alias(f"{c}__stddev"),
            F.min(x).alias(f"{c}__min"),
            F.max(x).alias(f"{c}__max"),
        ]
    wide = df.agg(*aggs)
    stack = "stack({n}, {rows}) AS (column, count, mean, stddev, min, max)".format(
        n=len(cols),
        rows=", ".join(
            f"'{c}', `{c}__count`, `{c}__mean`, `{c}__stddev`, `{c}__min`, `{c}__max`" for c in cols
        ),
    )
    return wide.selectExpr(stack)


# --- agg_unified ------------------------------------------------------------------------------
def unified_analysis(fact: DataFrame, store: str = STORE, date: str = DATE, sales: str = SALES) -> DataFrame:
    """Totals, per-month and per-store figures in ONE shuffle with GROUPING SETS."""
    src = fact.select(F.date_format(F.col(date), "yyyy-MM").alias("month"), F.col(store).alias("store"), F.col(sales).alias("v"))
    g = src.groupingSets([["month"], ["store"], []], "month", "store").agg(
        F.avg("v").alias("avg_sales"),
        F.max("v").alias("max_sales"),
        F.min("v").alias("min_sales"),
        F.count("v").alias("records"),
        F.sum("v").alias("total_sales"),
        F.grouping_id().alias("gid"),
    )
    level = F.when(F.col("gid") == 1, "month").when(F.col("gid") == 2, "store").otherwise("total")
    return g.withColumn("level", level).drop("gid")


# --- agg_histogram -----------------------------------------------------------------------------
def histogram(fact: DataFrame, sales: str = SALES, bins: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between min and max (the max lands in the last bin), empty bins included."""
    keys = _keys(keys)
    rng = fact.groupBy(*keys).agg(F.min(sales).alias("lo"), F.max(sales).alias("hi"))
    joined = fact.select(*keys, sales).where(F.col(sales).isNotNull())
    joined = attach_row(joined, rng, keys)
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(sales) - F.col("lo")) / width), F.lit(bins - 1)))
    counts = joined.groupBy(*keys, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    every = rng.where(F.col("lo").isNotNull()).select(*keys, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    h = every.join(counts, [*keys, "bin"], "left").fillna({"count": 0})
    return h.select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_end"),
        "count",
    )


#: Longest run of empty bins that is given bin by bin.
MAX_GAP = 1000


def filled_bins(counts: DataFrame, keys: Sequence[str] = (), max_gap: int = MAX_GAP) -> DataFrame:
    """keys, bin, bins, count: the counted bins and the empty ones between them.

    A run of more than ``max_gap`` empty bins is one row: its first bin, and how many ``bins`` it spans. So an outlier adds
    a row, not a bin for every width up to it.
    """
    keys = _keys(keys)
    w = Window.partitionBy(*keys).orderBy("bin") if keys else Window.orderBy("bin")
    following = counts.withColumn("following", F.lead("bin").over(w))
    # differences of bins at either end of BIGINT don't fit in it
    gap = F.col("following").cast("decimal(20,0)") - F.col("bin") - 1
    here = F.struct(F.col("bin").alias("bin"), F.lit(1).cast("decimal(20,0)").alias("bins"), F.col("count").alias("count"))
    empty = lambda at, wide: F.struct(at.alias("bin"), wide.cast("decimal(20,0)").alias("bins"), F.lit(0).cast("long").alias("count"))
    single = F.transform(F.sequence(F.col("bin") + 1, F.col("following") - 1), lambda b: empty(b, F.lit(1)))
    between = F.when(gap.isNull() | (gap <= 0), F.array().cast("array<struct<bin:bigint,bins:decimal(20,0),count:bigint>>"))
    between = between.when(gap <= max_gap, single).otherwise(F.array(empty(F.col("bin") + 1, gap)))
    return following.select(*keys, F.inline(F.concat(F.array(here), between)))


def fixed_width_histogram(fact: DataFrame, sales: str = SALES, width: float = 2000.0, keys: Sequence[str] = (), max_gap: int = MAX_GAP) -> DataFrame:
    """Bins of ``width`` from the lowest to the highest value's, empty bins between them as in ``filled_bins``."""
    keys = _keys(keys)
    b = F.floor(F.col(sales) / width).cast("long")
    counts = fact.where(F.col(sales).isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    end = (F.col("bin") + F.col("bins").cast("double")) * width
    return filled_bins(counts, keys, max_gap).select(*keys, "bin", "count", (F.col("bin") * width).alias("bin_start"), end.alias("bin_end"))


def box_plot(fact: DataFrame, sales: str = SALES, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles, IQR, 1.5·IQR whiskers (most extreme points inside the fences) and outlier count, in two reads of the fact."""
    return distribution(fact, sales, keys)[0]


# --- dashboard distributions over per-store min / average / max ---------------------------------------
# The dashboard's sales bands (upper edges, exclusive) and its histogram bin width.
SALES_BAND_EDGES = (5000.0, 10000.0, 15000.0, 20000.0)
STORE_VALUE_BIN = 2000.0


def store_values(fact: DataFrame, keys: Sequence[str] = (), store: str = STORE, sales: str = SALES) -> DataFrame:
    """Three values per store: its minimum, average and maximum sale."""
    keys = _keys(keys)
    m = store_metrics(fact, keys, store, sales)
    return m.select(*keys, store, F.explode(F.array("min_sales", "avg_sales", "max_sales")).alias("value"))


def store_value_bands(fact: DataFrame, keys: Sequence[str] = (), store: str = STORE, sales: str = SALES) -> DataFrame:
    """Counts of store min/avg/max values per fixed band (all five bands, zeros included), one aggregate."""
    keys = _keys(keys)
    v = F.col("value")
    e = SALES_BAND_EDGES
    conds = [v < e[0]] + [(v >= e[i]) & (v < e[i + 1]) for i in range(len(e) - 1)] + [v >= e[-1]]
    wide = store_values(fact, keys, store, sales).groupBy(*keys).agg(*[F.count_if(c).alias(f"b{i}") for i, c in enumerate(conds)])
    labels = [f"<{int(e[0])}"] + [f"{int(e[i])}-{int(e[i + 1])}" for i in range(len(e) - 1)] + [f">={int(e[-1])}"]
    stack = "stack({n}, {rows}) AS (band, label, count)".format(
        n=len(conds), rows=", ".join(f"{i}, '{lab}', b{i}" for i, lab in enumerate(labels))
    )
    return wide.selectExpr(*[f"`{k}`" for k in keys], stack)


def store_value_histogram(fact: DataFrame, keys: Sequence[str] = (), width: float = STORE_VALUE_BIN, store: str = STORE,
                          sales: str = SALES, max_gap: int = MAX_GAP) -> DataFrame:
    """Bins of ``width`` from floor(min/width) to ceil(max/width) inclusive over store min/avg/max values,
    empty bins as in ``filled_bins``, labelled like '$2K-$4K'."""
    keys = _keys(keys)
    vals = store_values(fact, keys, store, sales).withColumn("bin", F.floor(F.col("value") / width).cast("long"))
    # the bin that starts at or after the greatest value is listed too
    last = vals.groupBy(*keys).agg(F.ceil(F.max("value") / width).cast("long").alias("bin")).where("bin is not null").withColumn("count", F.lit(0).cast("long"))
    counts = vals.where("bin is not null").select(*keys, "bin", F.lit(1).cast("long").alias("count")).unionByName(last).groupBy(*keys, "bin").agg(F.sum("count").alias("count"))
    k = width / 1000.0
    end = F.col("bin") + F.col("bins").cast("double")
    return filled_bins(counts, keys, max_gap).select(
        *keys, "bin", (F.col("bin") * width).alias("range_start"), (end * width).alias("range_end"),
        F.format_string("$%.0fK-$%.0fK", F.col("bin") * k, end * k).alias("label"), "count",
    )
