"""Cleaning operators for the canonical sales fact.

* Keyed de-duplication is an *aggregate* (``min_by`` over a tie-break struct),
  so a hot (store, date) key is collapsed map-side before the shuffle instead of
  being sorted inside one window partition. Result equals
  ``row_number() OVER (PARTITION BY key ORDER BY tiebreak) = 1``.
* Forward/backward fills run per store ordered by date on the de-duplicated
  fact, whose size per store is bounded by the calendar (one row per day);
  ``forward_fill_rows`` fills raw rows (any number per store and day) through
  range-partitioned blocks, so a hot store never lands in one task.
* Mean fills aggregate first and join the small per-key table back (AQE
  broadcasts it after checking its runtime size) — no unbounded window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attach import attach_row
from ..functions.calendar import temporal_features

STORE, DATE, SALES = "store", "date", "sales"


def dropna(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """cln_dropna: drop rows with a NULL in ``subset`` (any column when None)."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def dedupe_rows(df: DataFrame) -> DataFrame:
    """cln_dedupe_rows: exact duplicate rows removed (aggregate with map-side combine)."""
    return df.dropDuplicates()


def dedupe_key(df: DataFrame, key: Sequence[str] = (STORE, DATE), tiebreak: Sequence[str] | None = None) -> DataFrame:
    """cln_dedupe_key: keep the first row per ``key`` in ``tiebreak`` order (deterministic)."""
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    tiebreak = list(tiebreak) if tiebreak else rest
    picked = df.groupBy(*key).agg(
        F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in tiebreak])).alias("__row")
    )
    return picked.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def _ordered(keys: Sequence[str], order: str, descending: bool = False) -> Window:
    o = F.col(order).desc() if descending else F.col(order).asc()
    return Window.partitionBy(*keys).orderBy(o) if keys else Window.orderBy(o)


def carry_forward(column: str, keys: Sequence[str], order: str, descending: bool = False):
    """Last non-NULL value at or before each row in the given order (running frame: O(n))."""
    return F.last(column, ignorenulls=True).over(_ordered(keys, order, descending).rowsBetween(Window.unboundedPreceding, 0))


def edge_value(column: str, keys: Sequence[str], order: str, descending: bool = False):
    """First non-NULL value of the whole partition in the given order (whole-partition frame: computed once)."""
    return F.first(column, ignorenulls=True).over(
        _ordered(keys, order, descending).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )


def carry_backward(column: str, keys: Sequence[str], order: str):
    """First non-NULL value at or after each row: a running frame over the reversed order.

    (``first`` over current→unbounded-following is re-evaluated per row — quadratic.)"""
    return carry_forward(column, keys, order, descending=True)


def forward_fill(df: DataFrame, column: str = SALES, keys: Sequence[str] = (STORE,), order: str = DATE) -> DataFrame:
    """cln_fill_ffill: per-key forward fill by ``order`` then backward fill for leading gaps.

    After the forward pass only leading gaps remain, and their backward fill is the
    partition's first non-NULL value — both from ONE sort (one Window operator)."""
    keys = list(keys)
    return df.withColumn(
        column, F.coalesce(F.col(column), carry_forward(column, keys, order), edge_value(column, keys, order))
    )


def backward_fill(df: DataFrame, column: str = SALES, keys: Sequence[str] = (STORE,), order: str = DATE) -> DataFrame:
    """cln_fill_bfill: mirror of forward_fill (backward first, then forward for trailing gaps), one reversed sort."""
    keys = list(keys)
    return df.withColumn(
        column,
        F.coalesce(F.col(column), carry_forward(column, keys, order, descending=True), edge_value(column, keys, order, descending=True)),
    )


def forward_fill_rows(
    df: DataFrame, column: str = SALES, keys: Sequence[str] = (STORE,), order: Sequence[str] = (DATE,),
    tiebreak: Sequence[str] | None = None, blocks: int | None = None, descending: bool = False,
) -> DataFrame:
    """Forward fill (then backward fill of leading gaps) over raw rows, safe for hot keys; ``descending``: the mirror.

    A per-key window would put a key holding a third of all rows into one task. Instead
    ``repartitionByRange`` on (keys, order, tiebreak) cuts the global order into ``blocks``
    contiguous ranges of bounded size — a hot key (even a hot key-and-day) spans many
    blocks. Each (block, key) is filled with a running window; what a block cannot see
    comes from a tiny carry table (last value of every earlier block of the same key,
    first value of the key), attached by equi-joins. Same result as the per-key window. The
    ranged rows are checkpointed once, so that every later use sees the same blocks.
    """
    from ..session import cut_lineage, target_parallelism

    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in (*keys, *order)]
    tiebreak = list(tiebreak) if tiebreak else rest
    places = [*keys, *order, *tiebreak]
    sort_cols = [*keys, *(F.col(c).desc() if descending else F.col(c).asc() for c in (*order, *tiebreak))]
    ends = (F.min_by, F.max_by) if descending else (F.max_by, F.min_by)  # last and first in this order
    n = blocks or target_parallelism(df.sparkSession)
    ranged = cut_lineage(df.repartitionByRange(n, *sort_cols).withColumn("__block", F.spark_partition_id()))
    w = Window.partitionBy("__block", *keys).orderBy(*sort_cols)
    inside = ranged.withColumn("__ff", F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per_block = inside.groupBy("__block", *keys).agg(
        ends[0](F.col(column), F.when(F.col(column).isNotNull(), F.struct(*places))).alias("__last"),
        ends[1](F.col(column), F.when(F.col(column).isNotNull(), F.struct(*places))).alias("__first"),
    )
    wk = Window.partitionBy(*keys).orderBy("__block")
    carry = per_block.select(
        "__block", *keys,
        F.last("__last", ignorenulls=True).over(wk.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"),
        F.first("__first", ignorenulls=True).over(wk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__edge"),
    )
    out = inside.join(carry, ["__block", *keys], "left")
    filled = F.coalesce(F.col(column), F.col("__ff"), F.col("__carry"), F.col("__edge"))
    return out.withColumn(column, filled).select(*df.columns)


def mean_fill(df: DataFrame, column: str = SALES, keys: Sequence[str] = (STORE,)) -> DataFrame:
    """cln_fill_mean: NULL → mean of its key group (aggregate + join, not a window)."""
    keys = list(keys)
    means = df.groupBy(*keys).agg(F.avg(column).alias("__mean"))
    return df.join(means, keys, "left").withColumn(column, F.coalesce(F.col(column), F.col("__mean"))).drop("__mean").select(
        *df.columns
    )


def column_mean_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Spark-variant mean fill: every numeric column's NULLs → that column's mean, ONE aggregate."""
    from .eda import numeric_columns

    cols = list(columns) if columns is not None else numeric_columns(df)
    means = df.agg(*[F.avg(c).alias(f"__m_{i}") for i, c in enumerate(cols)])
    j = attach_row(df, means)  # column means as scalar subqueries (one aggregate)
    return j.select(
        *[
            F.coalesce(F.col(c), F.col(f"__m_{cols.index(c)}")).cast(df.schema[c].dataType).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )


STRATEGIES = ("drop", "forward_fill", "forward_fill_rows", "backward_fill", "mean", "column_mean")


def handle_missing(
    df: DataFrame, strategy: str = "drop", column: str = SALES, keys: Sequence[str] = (STORE,), order: str = DATE,
    subset: Sequence[str] | None = None,
) -> DataFrame:
    """cln_strategy: dispatcher; an unknown strategy falls back to ``drop``.

    Raw rows may hold any number per key and day, so both fills go block by block (a hot key is
    split, ties follow the remaining columns).
    """
    if strategy in ("forward_fill", "forward_fill_rows"):
        return forward_fill_rows(df, column, keys, [order])
    if strategy == "backward_fill":
        return forward_fill_rows(df, column, keys, [order], descending=True)
    if strategy == "mean":
        return mean_fill(df, column, keys)
    if strategy == "column_mean":
        return column_mean_fill(df)
    return dropna(df, subset)


def sort_fact(df: DataFrame, keys: Sequence[str] = (STORE, DATE)) -> DataFrame:
    """cln_sort: ordering belongs at the edge (before a sink or a preview)."""
    return df.orderBy(*keys)


def rf_clean(df: DataFrame, date: str = DATE, sales: str = SALES) -> DataFrame:
    """cln_rf_clean: drop NULL rows → drop exact duplicates → keep (date, sales) → sum repeated dates."""
    return dedupe_rows(dropna(df)).groupBy(date).agg(F.sum(sales).alias(sales))


def preprocess(
    df: DataFrame, remove_dupes: bool = True, handle_missing_values: bool = True, extract_features: bool = True,
    key: Sequence[str] = (STORE, DATE), tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    """cln_preprocess: dedupe (store, date) → per-store forward fill → temporal features."""
    out = df
    if remove_dupes:
        out = dedupe_key(out, key, tiebreak)
    if handle_missing_values:  # one row per key and day after the de-duplication, any number without it
        out = forward_fill(out) if remove_dupes else forward_fill_rows(out)
    if extract_features:
        out = temporal_features(out)
    return out


def null_count_expr(df: DataFrame):
    """Total NULL cells across every column, as one aggregate expression."""
    return sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0)).alias("nulls")


def preprocessing_stats(before: DataFrame, after: DataFrame, date: str = DATE) -> DataFrame:
    """cln_stats: records before/after/removed, NULL cells before/after, date range — one agg per side."""
    b = before.agg(F.count(F.lit(1)).alias("records_before"), null_count_expr(before).alias("missing_values_before"))
    a = after.agg(
        F.count(F.lit(1)).alias("records_after"),
        null_count_expr(after).alias("missing_values_after"),
        F.min(date).alias("start_date"),
        F.max(date).alias("end_date"),
    )
    j = attach_row(b, a)
    return j.withColumns(
        {
            "records_removed": F.col("records_before") - F.col("records_after"),
            "date_range": F.concat_ws(" to ", F.col("start_date").cast("string"), F.col("end_date").cast("string")),
        }
    )


def eligible_series(series: DataFrame, keys: Sequence[str], min_points: int) -> DataFrame:
    """cln_min_rows: series with at least ``min_points`` observations (count per key, no collect)."""
    return series.groupBy(*keys).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= min_points)


def require_rows(df: DataFrame, n: int, what: str = "rows") -> DataFrame:
    """Raise when ``df`` has fewer than ``n`` rows; reads at most n rows (``limit(n).count()``)."""
    got = df.limit(n).count()
    if got < n:
        raise ValueError(f"need at least {n} {what}, found {got}")
    return df
