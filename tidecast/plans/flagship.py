"""The flagship report: monthly totals with trend against the previous month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import eda, windows
from ..sources.testdata import sales_fact
from .registry import rnd


def monthly_trend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = eda.monthly_trends(sales_fact(spark, sf_dir))
    return rnd(windows.period_trend(monthly, order="month", value="avg_sales"))
