"""Row-wise date parsing by the shape of a text.

Each row is parsed on its own (no whole-column format guessing). What is left of a text without its digits is its shape:
it says which layouts can apply, so that one look-up replaces a try of each. Year-first shapes are read as such; where
the year is last, the day is first unless the middle number cannot be a month. The parts are put in one order and read
by one fixed format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts, by what separates the numbers (one- or two-digit days and months everywhere).
DATE_LAYOUTS = (
    "yyyy-M-d", "yyyy/M/d", "yyyyMMdd",
    "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yy", "d/M/yy",
    "M-d-yyyy", "M/d/yyyy", "M.d.yyyy", "M-d-yy", "M/d/yy",
    "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Short names beside the first three letters of each.
MORE_SHORT = {"sept": "september"}
# Fixed value: two-digit years from this one on belong to the 1900s.
CENTURY_TURN = 69

# Timestamps with a time part are cut to their date first.
_TIME_SUFFIX = r"[T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm])?(Z|[+-]\d{2}:?\d{2})?$"
_DIGITS = "0123456789"


def _part(parts: Column, n: int) -> Column:
    return F.coalesce(F.get(parts, n), F.lit(""))


def _ordered(year: Column, month: Column, day: Column) -> Column:
    """year-month-day, two-digit years with their century."""
    short = F.when(year >= F.lit(str(CENTURY_TURN)), F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))
    return F.concat_ws("-", F.when(F.length(year) == 2, short).otherwise(year), month, day)


def _from_numbers(text: Column, dotted: Column) -> Column:
    """Three numbers with one separator twice; ``dotted``: that it is a dot."""

    def use(p):
        first, middle, last = (_part(p, n) for n in range(3))
        few = lambda x: F.length(x).between(1, 2)
        year_first = (F.length(first) == 4) & few(middle) & few(last) & ~dotted
        year_last = few(first) & few(middle) & ((F.length(last) == 4) | ((F.length(last) == 2) & ~dotted))
        month = F.lpad(middle, 2, "0").between("01", "12")
        day_first = F.when(month, _ordered(last, middle, first)).otherwise(_ordered(last, first, middle))
        return F.when(year_first, _ordered(first, middle, last)).when(year_last, day_first)

    return _bind(F.split(F.translate(text, "/.", "--"), "-"), use)


def _month_number(name: Column) -> Column:
    """1 to 12 of a month's full or short name in lower case, as text; else NULL."""
    known = F.when(F.lit(False), "")
    for n, month in enumerate(MONTHS, 1):
        known = known.when(name.isin(month, month[:3], *(k for k, v in MORE_SHORT.items() if v == month)), str(n))
    return known


def _from_names(text: Column, shape: Column) -> Column:
    """A month by name between day and year, or before both."""

    def use(x):
        place = F.replace(x["shape"], x["name"], F.lit("#"))
        between = F.when(place == " # ", F.split(x["text"], " ")).when(place == "-#-", F.split(x["text"], "-"))
        before = F.when(place == "# , ", F.split(F.replace(x["text"], F.lit(","), F.lit("")), " "))

        def by_place(parts, day, name):
            fits = F.length(_part(parts, day)).between(1, 2) & (_part(parts, name) == x["name"]) & (F.length(_part(parts, 2)) == 4)
            return F.when(fits, F.concat_ws("-", _part(parts, 2), _month_number(x["name"]), _part(parts, day)))

        ordered = F.coalesce(_bind(between, lambda p: by_place(p, 0, 1)), _bind(before, lambda p: by_place(p, 1, 0)))
        return F.when(_month_number(x["name"]).isNotNull(), ordered)

    return _bind(F.struct(text.alias("text"), shape.alias("shape"), F.translate(shape, " ,-", "").alias("name")), use)


def parse_date(col) -> Column:
    """The date in a text of any of ``DATE_LAYOUTS``, whatever time follows it; else NULL."""
    c = F.col(col) if isinstance(col, str) else col
    raw = F.trim(c.cast("string"))
    text = F.lower(F.when(F.contains(raw, F.lit(":")), F.regexp_replace(raw, _TIME_SUFFIX, "")).otherwise(raw))

    def use(x):
        ordered = (
            F.when(x["shape"].isin("--", "//", ".."), _from_numbers(x["text"], x["shape"] == ".."))
            .when((x["shape"] == "") & (F.length(x["text"]) == 8), F.concat_ws("-", F.substring(x["text"], 1, 4), F.substring(x["text"], 5, 2), F.substring(x["text"], 7, 2)))
            .when(F.length(x["shape"]) > 4, _from_names(x["text"], x["shape"]))
        )
        return F.call_function("try_to_date", ordered, F.lit("yyyy-M-d"))

    # one-element arrays bind what is used many times, so that it is computed once
    return _bind(_bind(text, lambda t: F.struct(t.alias("text"), F.translate(t, _DIGITS, "").alias("shape"))), use)


def _bind(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def parse_sales(col) -> Column:
    """Numeric coercion: anything that is not a number becomes NULL (ANSI-safe)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(c.cast("string")).try_cast("double")
