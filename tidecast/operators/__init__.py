"""DataFrame -> DataFrame operators.

clean (dedupe, fills, missing-value strategies), eda (descriptive aggregates), quantile (skew-safe exact
quantiles), windows (order-dependent series operators), series (period aggregation, calendars, validation),
stationarity (ADF / KPSS / variance ratio), arima (CSS-ARIMA / SARIMA per series), forecast (baselines and
forecast-table operators), ml (MLlib training, scoring, lag forecasting), recommend (rules R1-R13),
quality (checks Q1-Q8).
"""
