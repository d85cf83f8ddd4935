"""Presentation helpers (JVM expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def store_label(stores) -> Column:
    """'Store x' for one store, 'Combined (n stores)' for several."""
    s = F.col(stores) if isinstance(stores, str) else stores
    return F.when(F.size(s) == 1, F.concat(F.lit("Store "), s[0])).otherwise(F.format_string("Combined (%d stores)", F.size(s)))


def signed_percent(x, decimals: int = 1) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.format_string(f"%+.{decimals}f%%", c)


def week_label(date) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return F.format_string("Week %d", F.weekofyear(d))


def json_safe(df):
    """NaN → NULL for every double column (JSON has no NaN)."""
    from pyspark.sql import types as T

    return df.select(*[
        F.when(F.isnan(f.name), F.lit(None).cast("double")).otherwise(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields
    ])
