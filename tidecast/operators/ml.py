"""Model training and scoring with MLlib (distributed end to end — no driver-side frames).

* features: label codes as a joined table for string columns (``encode``), then ``VectorAssembler``
  and an optional ``StandardScaler``;
* split: deterministic ``pmod(xxhash64(row key), 100) < 80`` — stable under
  repartitioning and executor loss, unlike ``randomSplit`` over a re-read source;
* model: the forest a ``RandomForestRegressor`` describes, grown on packed rows (``grow``) and read back as MLlib's model, splits of
  too few rows folded back (``forest``); metrics in one aggregate per split;
* persistence: the code table as Parquet beside a ``PipelineModel`` directory.

Recursive multi-step forecasting keeps the lag window in an array column and
cuts lineage with a reliable ``checkpoint()`` into the cluster's checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.attach import attach_row
from ..functions.calendar import temporal_features7
from ..session import cut_lineage, ensure_parallelism, fit_parts
from . import grow
from .encode import apply_codes, label_codes, label_rows
from .forest import with_min_split

# Reference model defaults.
RF_DEFAULTS = {"numTrees": 100, "maxDepth": 20, "minInstancesPerNode": 2, "seed": 42}
MIN_SPLIT = 5
TRAIN_PERCENT = 80
PREDICTION_BAND = 0.10


def assemble(df: DataFrame, features: Sequence[str], label: str | None = None, out: str = "features") -> DataFrame:
    """ml_assemble: drop rows with NULL features / label, then one vector column."""
    need = list(features) + ([label] if label else [])
    clean = df.dropna(subset=need)
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(clean)


def text_columns(df: DataFrame, features: Sequence[str]) -> list[str]:
    return [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]


def feature_stages(features: Sequence[str], texts: Sequence[str], scale: bool = False) -> list:
    """Stages over coded rows: assemble, optionally standardise.

    Codes are ordinal numbers (as a label encoder feeds a forest), so a key with millions of values never becomes a
    categorical split needing millions of bins.
    """
    cols = [f"{c}__code" if c in texts else c for c in features]
    stages = [VectorAssembler(inputCols=cols, outputCol="features_raw" if scale else "features", handleInvalid="keep")]
    if scale:
        stages.append(StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True))
    return stages


@dataclass(frozen=True)
class CodedModel:
    """A fitted pipeline behind the label codes of its text columns."""

    pipeline: PipelineModel
    codes: DataFrame
    texts: list[str]

    @property
    def stages(self) -> list:
        return self.pipeline.stages

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(apply_codes(df, self.codes, self.texts))


def split(df: DataFrame, key: Sequence[str], train_percent: int = TRAIN_PERCENT) -> DataFrame:
    """ml_split: deterministic hash split on a row key (xxhash64 seed 42) → ``is_train``."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(*[F.col(c) for c in key]), F.lit(100)) < train_percent)


def train(
    df: DataFrame, features: Sequence[str], label: str = "sales", key: Sequence[str] | None = None, scale: bool = False,
    max_bins: int = 64, min_split: int = MIN_SPLIT, **rf_params,
) -> tuple[CodedModel, DataFrame]:
    """ml_rf_train: label codes, feature pipeline and random forest on the train split.

    No node of fewer than ``min_split`` rows is split. Returns the fitted model and the split input (``is_train`` column). The training
    columns (coded features, label) are persisted while fitting (``DISK_ONLY``: a table that fills the storage memory leaves
    small executors no heap, as its chunks take two regions each; rebuilt from lineage if an executor is lost) in partitions of
    bounded size, because fitting makes several passes (limits of bins, packing) that would otherwise each re-run the whole input plan;
    they are released before this returns.
    """
    params = {**RF_DEFAULTS, **rf_params}
    params["maxDepth"] = min(int(params["maxDepth"]), 30)
    key = list(key or [*features, label])
    whole = split(df.dropna(subset=[*features, label]), key)
    texts = text_columns(df, features)
    seen = whole.where("is_train").select(*features, label)
    labels = label_rows(seen, texts) if texts else None
    codes = label_codes(seen, texts, labels=labels)
    # no feature is NULL here, so a text column's labels count all rows without another pass
    n = labels.where(F.col("column") == texts[0]).agg(F.sum("rows")).first()[0] or 0 if texts else seen.count()
    stages = feature_stages(features, texts, scale)
    coded = apply_codes(seen, codes, texts).select(*stages[0].getInputCols(), label)
    fitting = coded.repartition(fit_parts(df.sparkSession, n)).persist(StorageLevel.DISK_ONLY)
    try:
        rf = RandomForestRegressor(labelCol=label, featuresCol="features", featureSubsetStrategy="all", maxBins=max_bins, **params)
        prepared = Pipeline(stages=stages).fit(fitting)
        numbers = [vector_to_array("features")[i] for i in range(len(features))] if scale else [F.col(c) for c in stages[0].getInputCols()]
        fitted = grow.fit(rf, prepared.transform(fitting) if scale else fitting, numbers)
    finally:
        fitting.unpersist()
    folded = with_min_split(fitted, df.sparkSession, min_split)
    model = CodedModel(PipelineModel([*prepared.stages, folded]), codes, texts)
    return model, whole


def metrics(scored: DataFrame, label: str = "sales", prediction: str = "prediction", by: str | None = "is_train") -> DataFrame:
    """ml_metrics: MAE, RMSE, R² per split in ONE aggregate (R² = 1 - SSE / SST)."""
    err = F.col(label) - F.col(prediction)
    grp = [F.when(F.col(by), "train").otherwise("test").alias("split")] if by else []
    g = scored.groupBy(*grp).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("__sse"),
        (F.count(F.lit(1)) * F.var_pop(label)).alias("__sst"),
        F.count(F.lit(1)).alias("n"),
    )
    return g.withColumn("r2", 1 - F.try_divide(F.col("__sse"), F.col("__sst"))).drop("__sse", "__sst")


def importance(model: CodedModel, names: Sequence[str]) -> DataFrame:
    """ml_importance: feature importances zipped with feature names, ranked (model metadata, #features rows)."""
    rf = model.stages[-1]
    vals = rf.featureImportances.toArray().tolist()
    spark = _active_session()
    rows = [(n, float(v)) for n, v in zip(names, vals)]
    df = spark.createDataFrame(rows, "feature string, importance double")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def _active_session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def save(model: CodedModel, path: str) -> str:
    """ml_save_load: persist the whole fitted model (codes, scaler, forest)."""
    model.codes.write.mode("overwrite").parquet(f"{path}/codes")
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    return path


def load(path: str) -> CodedModel:
    pipeline = PipelineModel.load(f"{path}/pipeline")
    inputs = next(s.getInputCols() for s in pipeline.stages if isinstance(s, VectorAssembler))
    codes = _active_session().read.parquet(f"{path}/codes")
    return CodedModel(pipeline, codes, [c.removesuffix("__code") for c in inputs if c.endswith("__code")])


def predict(model: CodedModel, df: DataFrame, features: Sequence[str], defaults: dict | None = None) -> DataFrame:
    """ml_predict: score any table; missing numeric features are 0, missing string features empty."""
    defaults = defaults or {}
    out = df
    for c in features:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(defaults.get(c, "" if c in model.texts else 0)))
    return model.transform(out)


# --- forecasts --------------------------------------------------------------------------------------
def daily_forecast(model: CodedModel, history: DataFrame, n: int = 365, keys: Sequence[str] = (), date: str = "date",
                   band: float = PREDICTION_BAND, extra: dict | None = None) -> DataFrame:
    """fc_rf_daily: score the next ``n`` days after each series' last date with a ±10 % band."""
    from .forecast import future_calendar

    cal = future_calendar(history, n, keys, date)
    for c, v in (extra or {}).items():
        cal = cal.withColumn(c, F.lit(v))
    scored = model.transform(cal)
    return scored.select(
        *keys, "step", date, F.col("prediction").alias("predicted_sales"),
        (F.col("prediction") * (1 - band)).alias("lower_bound"), (F.col("prediction") * (1 + band)).alias("upper_bound"),
    )


def dates_products(model: CodedModel, products: DataFrame, start: str, days: int, product_col: str = "product",
                   quantity_col: str = "quantity", default_quantity: float = 1.0) -> DataFrame:
    """fc_dates_product: every product × each of ``days`` dates from ``start`` (explode, no join)."""
    if quantity_col in products.columns:  # one row per product: its average quantity (deterministic)
        p = products.groupBy(product_col).agg(F.avg(quantity_col).alias(quantity_col))
    else:
        p = products.select(product_col).distinct().withColumn(quantity_col, F.lit(default_quantity))
    grid = p.select("*", F.explode(F.sequence(F.to_date(F.lit(start)), F.date_add(F.to_date(F.lit(start)), days - 1))).alias("date"))
    grid = temporal_features7(grid, "date")
    return model.transform(grid).select(product_col, quantity_col, "date", F.col("prediction").alias("predicted_sales"))


LAG_FEATURES = [f"lag_{i}" for i in range(1, 13)] + ["month", "quarter"]


def lag_training_table(series: DataFrame, keys: Sequence[str] = (), period: str = "period", value: str = "value", n_lags: int = 12) -> DataFrame:
    """Rows with all ``n_lags`` lags present, plus month and quarter."""
    from .windows import lags

    t = lags(series, n_lags, period, value, keys)
    t = t.withColumns({"month": F.month(period), "quarter": F.quarter(period)})
    return t.dropna(subset=[f"lag_{i}" for i in range(1, n_lags + 1)])


def lag_forecast(
    series: DataFrame, steps: int = 12, keys: Sequence[str] = (), period: str = "period", value: str = "value",
    checkpoint_every: int = 4, z: float = 1.96, **rf_params,
) -> DataFrame:
    """fc_rf_lag: one forest pooled over all series on 12 lags + month + quarter, then recursive forecasting.

    The driver loop runs over *steps* (≤ horizon), each a distributed ``transform`` on
    one row per series; the lag window is an array column shifted by one per step.
    The forest is fitted on the earlier ``TRAIN_PERCENT`` of the periods; interval: ± z · std of each
    series' residuals in the later ones, which it has not seen. Missing periods take the value before.
    Series of fewer than 12 periods get their last value, without an interval, and say so in ``status``.
    """
    from .series import fixed_intervals

    keys = list(keys)
    series = fixed_intervals(series.select(*keys, period, value), "MS", keys, period, value).drop("filled")
    table = ensure_parallelism(lag_training_table(series, keys, period, value)).persist(StorageLevel.MEMORY_AND_DISK)
    params = {"numTrees": RF_DEFAULTS["numTrees"], "maxDepth": RF_DEFAULTS["maxDepth"], "seed": RF_DEFAULTS["seed"], **rf_params}
    try:
        cut = table.agg(F.percentile(F.unix_date(period), TRAIN_PERCENT / 100)).first()[0]
        early = F.lit(True) if cut is None else F.unix_date(period) <= cut
        assembler = VectorAssembler(inputCols=LAG_FEATURES, outputCol="features")
        rf = RandomForestRegressor(labelCol=value, featuresCol="features", featureSubsetStrategy="all", **params)
        model = Pipeline(stages=[assembler, rf]).fit(table.where(early))
        missed = model.transform(table.where(~early)).withColumn("__e", F.col(value) - F.col("prediction"))
        resid = cut_lineage(missed.groupBy(*keys).agg(F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("resid_std")))
    finally:
        table.unpersist()

    w = Window.partitionBy(*keys).orderBy(F.desc(period)) if keys else Window.orderBy(F.desc(period))
    last12 = series.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= 12)
    ends = last12.groupBy(*keys).agg(
        F.max(period).alias("__last"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("__r").alias("r"), F.col(value).alias("v")))), lambda s: s["v"]).alias("window"),
    )
    state = ends.where(F.size("window") == 12).withColumn("made", F.array().cast("array<double>"))
    for h in range(1, steps + 1):
        nxt = F.add_months("__last", F.lit(h))
        feats = state.withColumns(
            {**{f"lag_{i}": F.col("window")[i - 1] for i in range(1, 13)}, "month": F.month(nxt), "quarter": F.quarter(nxt)}
        )
        state = model.transform(feats).select(
            *keys, "__last", F.slice(F.concat(F.array("prediction"), F.col("window")), 1, 12).alias("window"),
            F.concat("made", F.array("prediction")).alias("made"),
        )
        if checkpoint_every and h % checkpoint_every == 0 and h < steps:
            state = cut_lineage(state)
    long = state.select(*keys, "__last", F.lit("forest").alias("status"), F.posexplode("made").alias("__h", "forecast"))
    short = ends.where(F.size("window") < 12).select(
        *keys, "__last", F.lit("short history").alias("status"), F.posexplode(F.array_repeat(F.col("window")[0], steps)).alias("__h", "forecast")
    )
    j = attach_row(long.unionByName(short), resid, keys, "left")
    half = F.when(F.col("status") == "forest", z * F.col("resid_std"))
    return j.select(
        *keys, (F.col("__h") + 1).cast("int").alias("step"), F.add_months("__last", F.col("__h") + 1).alias(period), "forecast",
        (F.col("forecast") - half).alias("lower_ci"), (F.col("forecast") + half).alias("upper_ci"), "status",
    )
