"""Queries for model training / scoring (§2.10) and model-based forecasts (fc_rf_daily, fc_rf_lag,
fc_dates_product). Model outputs are not SQL-expressible: rows-only checks, plus
property tests in ``tests/test_ml.py``."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.calendar import FEATURES7, temporal_features7
from ..functions.numeric import round_half_up
from ..operators import encode, ml
from ..operators import series as ts
from ..sinks.tables import shared_path
from ..sources.testdata import ENRICHED_CTE, FACT_CTE, sales_fact
from .registry import register, rnd, with_ctes

FEATURES = ["store", "quantity", "discount", "tax", *FEATURES7]
ROW_KEY = ["order_key", "line_number", "product"]
# On every sales row: a shallower forest, as one of depth 20 grows a leaf for every other row. The forecasts
# on daily totals (fc_rf_daily) fit the full one, the lag forecasts all 100 trees at depth 10.
SMALL_RF = {"numTrees": 20, "maxDepth": 8}


def enriched(spark, sf):
    return temporal_features7(sales_fact(spark, sf), "date")


def trained(spark, sf):
    return ml.train(enriched(spark, sf), FEATURES, "sales", ROW_KEY, **SMALL_RF)


@register(
    "ml_assemble",
    with_ctes(FACT_CTE)
    + """SELECT order_key, line_number, product, [quantity, discount, tax, CAST(year(date) AS DOUBLE), CAST(month(date) AS DOUBLE),
       CAST(day(date) AS DOUBLE), CAST(week(date) AS DOUBLE), CAST(isodow(date) - 1 AS DOUBLE), CAST(quarter(date) AS DOUBLE),
       CAST(dayofyear(date) AS DOUBLE)] AS features FROM fact WHERE sales IS NOT NULL""",
)
def q_ml_assemble(spark, sf):
    a = ml.assemble(enriched(spark, sf), ["quantity", "discount", "tax", *FEATURES7], "sales")
    return a.select(*ROW_KEY, vector_to_array("features").alias("features"))


SCALED = ["store__code", "quantity", "discount", "tax", *FEATURES7]


@register(
    "ml_encode_scale",
    with_ctes(FACT_CTE, ENRICHED_CTE)
    + """, e AS (SELECT order_key, line_number, product, CAST(dense_rank() OVER (ORDER BY store) - 1 AS DOUBLE) AS store__code, quantity, discount, tax, year, month, day(date) AS day,
       week, day_of_week, quarter, day_of_year FROM efact),
f AS (SELECT {figures} FROM e)
SELECT order_key, line_number, product, store__code, [{scaled}] AS features FROM e, f""".format(
        figures=", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in SCALED),
        scaled=", ".join(f"round(({c} - m_{c}) / s_{c}, 4)" for c in SCALED),
    ),
)
def q_ml_encode_scale(spark, sf):
    df = enriched(spark, sf)
    coded = encode.scaled(encode.apply_codes(df, encode.label_codes(df, ["store"]), ["store"]), SCALED)
    return coded.select(*ROW_KEY, "store__code", F.transform("features", lambda v: round_half_up(v, 4)).alias("features"))


@register("ml_label_codes", with_ctes(FACT_CTE) + """SELECT 'store' AS "column", store AS label, dense_rank() OVER (ORDER BY store) - 1 AS code FROM (SELECT DISTINCT store FROM fact)""")
def q_ml_label_codes(spark, sf):
    """Ranges of seven labels, so that codes run on across many."""
    return encode.label_codes(sales_fact(spark, sf), ["store"], range_labels=7)


@register("ml_split")
def q_ml_split(spark, sf):
    s = ml.split(sales_fact(spark, sf), ROW_KEY)
    return s.groupBy("is_train").agg(F.count(F.lit(1)).alias("rows"))


@register("ml_rf_train")
def q_ml_rf_train(spark, sf):
    model, data = trained(spark, sf)
    return ml.metrics(model.transform(data))


@register("ml_metrics")
def q_ml_metrics(spark, sf):
    """MAE, RMSE and R² of the train and of the test rows, each on their own."""
    model, data = trained(spark, sf)
    return ml.metrics(model.transform(data))


@register("ml_importance")
def q_ml_importance(spark, sf):
    model, _ = trained(spark, sf)
    return ml.importance(model, FEATURES)


@register("ml_save_load")
def q_ml_save_load(spark, sf):
    model, data = trained(spark, sf)
    again = ml.load(ml.save(model, shared_path(spark, "rf-sales")))
    return again.transform(data).select(*ROW_KEY, "is_train", "prediction")


@register("ml_predict")
def q_ml_predict(spark, sf):
    """Scoring input with an unseen store label and the 'tax' feature missing (→ 0)."""
    model, _ = trained(spark, sf)
    score = enriched(spark, sf).drop("tax").withColumn("store", F.concat(F.lit("new-"), F.col("store")))
    return ml.predict(model, score, FEATURES).select(*ROW_KEY, "prediction")


@register("ml_train_csv")
def q_ml_train_csv(spark, sf):
    from ..sources import intake
    from .q_io import upload_csv

    valid, _, _ = intake.validate_csv(spark, upload_csv(spark, sf))
    df = temporal_features7(valid.withColumn("quantity", F.col("quantity").try_cast("double")), "date")
    model, data = ml.train(df, ["store", "quantity", *FEATURES7], "sales", ["order_key", "line"], **SMALL_RF)
    return ml.metrics(model.transform(data))


def daily(spark, sf):
    d = ts.aggregate(sales_fact(spark, sf), "D", positive=False)
    return temporal_features7(d.withColumnRenamed("period", "date").withColumnRenamed("value", "sales"), "date")


@register("fc_rf_daily")
def q_fc_rf_daily(spark, sf):
    d = daily(spark, sf)
    model, _ = ml.train(d, FEATURES7, "sales", ["date"])  # the full forest: 100 trees, depth 20
    return ml.daily_forecast(model, d, 365)


@register("fc_dates_product")
def q_fc_dates_product(spark, sf):
    f = temporal_features7(sales_fact(spark, sf), "date")  # the numeric product key is its own code: no labels on the driver
    model, _ = ml.train(f, ["product", "quantity", *FEATURES7], "sales", ROW_KEY, **SMALL_RF)
    return ml.dates_products(model, f, "2001-12-01", 30)


@register("fc_rf_lag")
def q_fc_rf_lag(spark, sf):
    m = ts.aggregate(sales_fact(spark, sf), "MS", ["store"])
    return ml.lag_forecast(m, 12, ["store"], maxDepth=10)  # 100 trees


@register(
    "ml_metrics_table",
    with_ctes(FACT_CTE)
    + """, p AS (SELECT sales, quantity * 1500.0 AS prediction, order_key % 5 < 4 AS is_train FROM fact WHERE sales IS NOT NULL)
SELECT CASE WHEN is_train THEN 'train' ELSE 'test' END AS split, round(avg(abs(sales - prediction)), 2) AS mae,
       round(sqrt(avg((sales - prediction) * (sales - prediction))), 2) AS rmse, count(*) AS n,
       round(1 - sum((sales - prediction) * (sales - prediction)) / (count(*) * var_pop(sales)), 4) AS r2 FROM p GROUP BY is_train""",
)
def q_ml_metrics_table(spark, sf):
    """The metrics on a prediction table that SQL can make too: quantity times a fixed price."""
    f = sales_fact(spark, sf).where("sales is not null")
    scored = f.select("sales", (F.col("quantity") * 1500.0).alias("prediction"), (F.col("order_key") % 5 < 4).alias("is_train"))
    return rnd(ml.metrics(scored), overrides={"r2": 4})
