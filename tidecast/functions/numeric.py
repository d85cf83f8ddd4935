"""Null-safe numeric helpers (ANSI mode raises on x/0, so divide with try_divide)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def safe_div(num, den) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.try_divide(_c(num), _c(den))


def pct_change(new, old) -> Column:
    """(new - old) / old * 100, NULL when old is 0."""
    return F.try_divide(_c(new) - _c(old), _c(old)) * 100.0


def pct_of(part, whole) -> Column:
    return F.try_divide(_c(part), _c(whole)) * 100.0


def clip(x, lo, hi) -> Column:
    return F.least(F.greatest(_c(x), F.lit(lo)), F.lit(hi))


def signed_pct_text(x, decimals: int = 1) -> Column:
    """'+12.3%' / '-4.0%' formatting."""
    return F.format_string(f"%+.{decimals}f%%", _c(x))


SNAP_DP = 6
MOST_SCALED = 9e18  # just under the end of BIGINT


def round_half_up(x, dp: int = 2) -> Column:
    """Presentation rounding that any engine reproduces bit-for-bit.

    Snap to 6 decimals first (absorbs summation-order noise such as
    30021.184999999 vs 30021.185000001), then round half up — using only IEEE
    multiply / add / floor, so Spark and an SQL oracle agree exactly. ``floor`` yields a
    BIGINT, which ends at 9.22e18; values whose scaled form would pass it are rounded as
    decimals instead.
    """
    c = _c(x)
    if dp >= SNAP_DP:
        snapped = F.floor(c * 10.0**dp + 0.5) / 10.0**dp
    else:
        snapped = F.floor(F.floor(c * 10.0**SNAP_DP + 0.5) / 10.0**SNAP_DP * 10.0**dp + 0.5) / 10.0**dp
    return F.when(F.abs(c) * 10.0 ** max(dp, SNAP_DP) < MOST_SCALED, snapped).otherwise(F.round(c, dp))
