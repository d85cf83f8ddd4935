"""Canonical column names and declared schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical sales fact columns.
STORE = "store"
DATE = "date"
SALES = "sales"

# Canonical long series columns.
PERIOD = "period"
VALUE = "value"

# Declared 4-column CSV contract of the Spark intake path (all nullable).
CSV_CONTRACT = T.StructType(
    [
        T.StructField("Date", T.StringType(), True),
        T.StructField("Sales", T.DoubleType(), True),
        T.StructField("Store", T.IntegerType(), True),
        T.StructField("Weekly_Sales", T.DoubleType(), True),
    ]
)

FORECAST = T.StructType(
    [
        T.StructField("step", T.IntegerType(), False),
        T.StructField("period", T.DateType(), True),
        T.StructField("forecast", T.DoubleType(), True),
        T.StructField("lower_ci", T.DoubleType(), True),
        T.StructField("upper_ci", T.DoubleType(), True),
    ]
)


def all_string(columns: list[str]) -> T.StructType:
    """Schema with every column STRING: CSV is read without an inference pass."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
