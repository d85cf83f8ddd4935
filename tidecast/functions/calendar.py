"""Calendar column expressions (JVM-side, codegen friendly — no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season of each calendar month, and weekday names 0=Monday.
SEASON_MONTHS = {
    "Winter": (12, 1, 2),
    "Spring": (3, 4, 5),
    "Summer": (6, 7, 8),
}
SEASON_FALLBACK = "Fall"
SEASON_ORDER = ("Winter", "Spring", "Summer", "Fall")
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def season(month) -> Column:
    m = _c(month)
    expr = F.when(m.isin(*SEASON_MONTHS["Winter"]), "Winter")
    expr = expr.when(m.isin(*SEASON_MONTHS["Spring"]), "Spring")
    expr = expr.when(m.isin(*SEASON_MONTHS["Summer"]), "Summer")
    return expr.otherwise(SEASON_FALLBACK)


def season_order(season_col) -> Column:
    s = _c(season_col)
    expr = None
    for i, name in enumerate(SEASON_ORDER):
        expr = F.when(s == name, i) if expr is None else expr.when(s == name, i)
    return expr


def normalize_season(season_col) -> Column:
    """Input synonym: an incoming ``Autumn`` label is ``Fall``."""
    s = F.initcap(F.trim(_c(season_col)))
    return F.when(s == "Autumn", F.lit("Fall")).otherwise(s)


def weekday0(date) -> Column:
    """Day of week, 0 = Monday .. 6 = Sunday."""
    return F.weekday(_c(date))


def day_name(date) -> Column:
    return F.date_format(_c(date), "EEEE")


def month_start(date) -> Column:
    return F.trunc(_c(date), "MM")


def week_ending_sunday(date) -> Column:
    """Weekly bucket labelled by the Sunday that closes the ISO week."""
    return F.date_add(F.trunc(_c(date), "week"), 6)


def temporal_features(df, date: str = "date"):
    """Year, Month, ISO Week, DayOfWeek (0=Mon), Quarter, DayOfYear and Season."""
    d = F.col(date)
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "week": F.weekofyear(d),
            "day_of_week": weekday0(d),
            "quarter": F.quarter(d),
            "day_of_year": F.dayofyear(d),
            "season": season(F.month(d)),
        }
    )


def temporal_features7(df, date: str = "date", with_week: bool = True):
    """The seven model features: year, month, day, week, day_of_week, quarter, day_of_year."""
    d = F.col(date)
    cols = {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
    }
    if with_week:
        cols["week"] = F.weekofyear(d)
    cols.update({"day_of_week": weekday0(d), "quarter": F.quarter(d), "day_of_year": F.dayofyear(d)})
    return df.withColumns(cols)


FEATURES7 = ["year", "month", "day", "week", "day_of_week", "quarter", "day_of_year"]
