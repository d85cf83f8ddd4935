"""Attaching per-group figures to rows.

Grouped: an equi-join on the group keys (AQE broadcasts the small side after
checking its runtime size, otherwise sort-merge). Ungrouped: the figures are a
single row, attached as scalar subqueries — computed once (the optimizer merges
subqueries over the same plan) and inlined, so no join and no cross product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def attach_row(df: DataFrame, figures: DataFrame, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    keys = list(keys)
    if keys:
        return df.join(figures, keys, how)
    return df.select("*", *[figures.select(f"`{c}`").scalar().alias(c) for c in figures.columns])
