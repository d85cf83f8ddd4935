"""tidecast — Spark-native retail sales analytics and forecasting.

Every operator is a DataFrame -> DataFrame function. Operators that work
per series take ``keys`` (a list of grouping columns) so one call serves a
single store or millions of series. The library never creates a session,
never collects data to the driver and never sets cluster configuration;
callers own the session (see ``tidecast.session`` for the test helper).
"""

__all__ = ["schema", "session"]
