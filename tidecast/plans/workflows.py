"""End-to-end flows composed from the operators (lazy DataFrames; callers pick the sinks).

* ``eda_bundle``      — every EDA section (agg_eda_bundle)
* ``chart_bundle``    — the data behind every chart (§2.13), drawing is the caller's
* ``upload_flow``     — file → validation → enriched fact → EDA + model + forecast (query lifecycle A)
* ``recommendations`` — fact → monthly series → every rule (lifecycle B)

The two bundles read the fact twice at most: once for a stored rollup that all sections are merged from, once for the
values that decide the median, whiskers and histogram (``operators/rollup.py``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import clean, eda, forecast, ml, recommend, rollup, series
from ..sources import intake


def eda_bundle(fact: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every EDA section; correlations are those of sales with each numeric column and the calendar's."""
    k = list(keys)
    numeric = [c for c in eda.numeric_columns(fact, exclude=["sales", *k]) if c not in rollup.CALENDAR]
    r = rollup.rollup(fact, k, numeric)
    monthly, seasons, stores = rollup.monthly(r), rollup.seasons(r), rollup.stores(r)
    return {
        "overall_stats": rollup.overall(r),
        "monthly_trends": monthly,
        "seasonal_patterns": seasons,
        "seasonality_strength": eda.strength_of(seasons, k),
        "peak_low_periods": eda.peak_low_of(monthly.select(*k, "month", "total_sales"), k),
        "store_analysis": eda.ranking_of(stores, k),
        "store_overview": eda.overview_of(stores, k),
        "day_of_week": rollup.weekdays(r),
        "year_analysis": rollup.years(r),
        "correlations": rollup.correlations(r),
    }


def chart_bundle(fact: DataFrame, top_n: int = 10, bins: int = 50) -> dict[str, DataFrame]:
    """chart_sales_over_time, chart_seasonality, chart_season, chart_store, chart_year, chart_distribution."""
    r = rollup.rollup(fact)
    box, histogram = rollup.charts(r, bins)
    return {
        "chart_sales_over_time": rollup.daily(r),
        "chart_seasonality": rollup.monthly(r),
        "chart_season": rollup.seasons(r),
        "chart_store": eda.ranking_of(rollup.stores(r), n=top_n),
        "chart_year": rollup.years(r),
        "chart_distribution": histogram,
        "chart_box": box,
    }


def upload_flow(spark: SparkSession, path: str, horizon_days: int = 365, **rf_params) -> dict[str, DataFrame]:
    """Validate an uploaded file and derive everything the reference's upload step produces."""
    valid, rejected, report = intake.validate_csv(spark, path)
    fact = clean.preprocess(valid, extract_features=False)
    out = eda_bundle(fact)
    out.update({"valid": valid, "rejected": rejected, "validation_report": report, "store_summary": eda.store_summary(fact)})
    daily = eda.daily_totals(fact)
    from ..functions.calendar import FEATURES7, temporal_features7

    feats = temporal_features7(daily, "date")
    model, data = ml.train(feats, FEATURES7, "sales", ["date"], **rf_params)
    preds = ml.daily_forecast(model, daily, horizon_days)
    out.update({
        "model_metrics": ml.metrics(model.transform(data)),
        "predictions": forecast.decorate(preds, daily),
        "monthly_predictions": forecast.prediction_monthly(preds, daily),
        "insights": forecast.insights(preds),
    })
    return out


def recommendations(fact: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Monthly totals (months without sales kept as 0) → every recommendation rule per series."""
    k = list(keys)
    s = series.complete(series.aggregate(fact, "MS", k, positive=False), "MS", k, fill_value=0.0)
    return recommend.bundle(s, k)


def daily_feature_table(valid: DataFrame, missing_strategy: str = "drop") -> DataFrame:
    """The Spark-side preparation path: validated rows → daily totals → missing-value strategy →
    the seven calendar features, ordered by date at the edge."""
    from ..functions.calendar import temporal_features7

    daily = eda.daily_totals(valid)
    daily = clean.handle_missing(daily, missing_strategy, keys=(), subset=["date", "sales"])
    return temporal_features7(daily, "date").orderBy("date")
