"""Known-answer tests on the hand-computed fixtures (FIXTURES.md) and edge cases."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.functions.dates import parse_date
from tidecast.operators import clean, eda, recommend as rec, stationarity as st
from tidecast.operators.quantile import exact_quantiles
from tidecast.sources import intake

D = dt.date


# --- F4 null handling ----------------------------------------------------------------------------
@pytest.fixture()
def f4(spark):
    rows = [(D(2023, 1, 1), 1000.0), (D(2023, 1, 2), None), (D(2023, 1, 3), 2000.0), (D(2023, 1, 4), None), (D(2023, 1, 5), 3000.0)]
    return spark.createDataFrame(rows, "date date, sales double").withColumn("store", F.lit("1"))


def _vals(df):
    return [r.sales for r in df.orderBy("date").collect()]


def test_f4_drop(f4):
    assert clean.handle_missing(f4, "drop").count() == 3


def test_f4_ffill(f4):
    assert _vals(clean.forward_fill(f4)) == [1000, 1000, 2000, 2000, 3000]


def test_f4_bfill(f4):
    assert _vals(clean.backward_fill(f4)) == [1000, 2000, 2000, 3000, 3000]


def test_f4_mean(f4):
    assert _vals(clean.mean_fill(f4)) == [1000, 2000, 2000, 2000, 3000]


def test_leading_and_trailing_gaps(spark):
    rows = [(D(2023, 1, d), v) for d, v in [(1, None), (2, 5.0), (3, None), (4, 7.0), (5, None)]]
    df = spark.createDataFrame(rows, "date date, sales double").withColumn("store", F.lit("9"))
    assert _vals(clean.forward_fill(df)) == [5, 5, 5, 7, 7]
    assert _vals(clean.backward_fill(df)) == [5, 5, 7, 7, 7]


# --- F8 small monthly series A -----------------------------------------------------------------------
@pytest.fixture()
def f8a(spark):
    vals = [100.0, 120.0, 110.0, 130.0, 125.0, 140.0]
    return spark.createDataFrame([(D(2021, i + 1, 1), v) for i, v in enumerate(vals)], "period date, value double")


def test_f8_demand(f8a):
    r = rec.demand(f8a).first()
    assert r.overall_mean == pytest.approx(120.8333, abs=1e-4)
    assert r.overall_std == pytest.approx(14.2887, abs=1e-4)
    assert r.overall_median == pytest.approx(122.5)
    assert r.high_threshold == pytest.approx(127.9777, abs=1e-4)
    assert r.low_threshold == pytest.approx(113.6890, abs=1e-4)
    assert (r.high_demand_count, r.low_demand_count, r.peak_value, r.lowest_value) == (2, 2, 140.0, 100.0)
    assert r.volatility == pytest.approx(0.118251, abs=1e-6)


def test_f8_elasticity(f8a):
    r = rec.elasticity(f8a).first()
    assert r.volatility_index == pytest.approx(11.58, abs=0.01)
    assert r.change_sensitivity == pytest.approx(12.47, abs=0.01)
    assert r.elasticity_score == pytest.approx(12.02, abs=0.01)
    assert r.elasticity_type == "MODERATELY ELASTIC"


def test_f8_stock_and_pricing(f8a):
    s = rec.stock(f8a).orderBy("month_num").collect()
    assert [x.percentage_change for x in s] == pytest.approx([-17.24, -0.69, -8.97, 7.59, 3.45, 15.86], abs=0.01)
    assert [(x.action, x.priority) for x in s] == [
        ("DECREASE", "MEDIUM"), ("MAINTAIN", "LOW"), ("DECREASE", "LOW"), ("INCREASE", "MEDIUM"), ("MAINTAIN", "LOW"), ("INCREASE", "HIGH")]
    p = rec.pricing(f8a).orderBy("month_num").collect()
    assert [x.strategy.split()[0] for x in p] == ["AGGRESSIVE", "LIGHT", "LIGHT", "NORMAL", "NORMAL", "PREMIUM"]


def test_f8_variance_ratio(f8a):
    r = st.variance_ratio(f8a).first()
    assert r.variance_ratio == pytest.approx(0.583333, abs=1e-6)
    assert r.interpretation.startswith("Possibly stationary")


def test_festival_has_twelve_rows_per_series(f8a):
    assert rec.festival(f8a).count() == 12


# --- dates ---------------------------------------------------------------------------------------
def test_mixed_date_formats(spark):
    raw = ["05-02-2010", "5/2/2010", "2010-02-05", "bad", "12/25/2020", "5 Feb 2010", "2010-02-05 13:45:00", "05.02.2010", "2010/02/05", None]
    df = spark.createDataFrame([(x,) for x in raw], "t string")
    got = [r.d for r in df.select(parse_date("t").alias("d")).collect()]
    feb5 = D(2010, 2, 5)
    assert got == [feb5, feb5, feb5, None, D(2020, 12, 25), feb5, feb5, feb5, feb5, None]


def test_validation_report_and_rejects(spark):
    rows = [("2024-01-01", "10", "S1"), ("02/01/2024", "x", "S1"), ("junk", "5", "S2"), ("03-01-2024", "7.5", "S2")]
    raw = spark.createDataFrame(rows, "`Order Date` string, `Total Sales` string, `Store Code` string")
    valid, rejected, report = intake.validate_frame(raw)
    assert sorted((r.store, r.date, r.sales) for r in valid.collect()) == [("S1", D(2024, 1, 1), 10.0), ("S2", D(2024, 1, 3), 7.5)]
    assert sorted(r.reason for r in rejected.collect()) == ["bad date", "bad sales"]
    rep = report.first()
    assert (rep.records_in, rep.records_valid, rep.records_dropped, rep.is_valid) == (4, 2, 2, True)


def test_missing_columns_rejected(spark):
    no_date = spark.createDataFrame([("1", "2")], "a string, sales string")
    no_sales = spark.createDataFrame([("2024-01-01", "2")], "date string, b string")
    with pytest.raises(ValueError, match="Date"):
        intake.validate_frame(no_date)
    with pytest.raises(ValueError, match="Sales"):
        intake.validate_frame(no_sales)


# --- exact quantiles under skew -------------------------------------------------------------------
def test_exact_quantiles_hot_key_and_hot_value(spark):
    rng = np.random.default_rng(3)
    hot = [("hot", 42.0)] * 3000 + [("hot", float(x)) for x in rng.normal(50, 10, 3000)]
    cold = [(f"k{i % 5}", float(x)) for i, x in enumerate(rng.exponential(20, 3000))]
    df = spark.createDataFrame(hot + cold, "k string, v double")
    got = {r.k: (r.q1, r.med, r.q3) for r in exact_quantiles(df, "v", [0.25, 0.5, 0.75], ["k"], ["q1", "med", "q3"]).collect()}
    for k in got:
        vals = np.array([v for kk, v in hot + cold if kk == k])
        assert got[k] == pytest.approx(tuple(np.percentile(vals, [25, 50, 75])), rel=1e-12, abs=1e-9)
    allv = np.array([v for _, v in hot + cold])
    g = exact_quantiles(df, "v", [0.5], names=["m"]).first().m
    assert g == pytest.approx(float(np.percentile(allv, 50)), rel=1e-12)


# --- F1 retail CSV (FIXTURES.md F1; path given by TIDECAST_F1_CSV, skipped when unset) -------------------
F1 = os.environ.get("TIDECAST_F1_CSV", "")


@pytest.mark.skipif(not (F1 and os.path.exists(F1)), reason="F1 fixture file not configured")
def test_f1_intake_and_eda(spark):
    valid, _, report = intake.validate_csv(spark, F1)
    assert report.first().records_valid == 371
    o = eda.overall_statistics(valid).first()
    assert o.total_sales == pytest.approx(2005422.42, abs=0.01)
    assert o.avg_sales == pytest.approx(5405.4513, abs=1e-4)
    assert o.median_sales == pytest.approx(4881.6, abs=1e-6)
    assert o.std_dev == pytest.approx(3635.6419, abs=1e-4)
    months = {r.month: r.total_sales for r in eda.monthly_trends(valid).collect()}
    assert months["2025-07"] == pytest.approx(214278.75, abs=0.01)
    assert months["2025-02"] == pytest.approx(119817.28, abs=0.01)
    seasons = {r.season: (r.records, r.total_sales) for r in eda.seasonal_patterns(valid.drop("season")).collect()}
    assert seasons["Winter"][0] == 98 and seasons["Winter"][1] == pytest.approx(494481.91, abs=0.01)
    stores = {r.store: r.avg_sales for r in eda.store_metrics(valid).collect()}
    assert stores["S04"] == pytest.approx(6043.7936, abs=1e-4)
    corr = {r.variable: r.correlation for r in eda.correlation_analysis(
        valid.select("sales", *[F.col(c).try_cast("double").alias(c) for c in ("price", "quantity_sold", "inventory_level", "rainfall", "temperature")])).collect()}
    assert corr["price"] == pytest.approx(0.785, abs=1e-3)


def test_log_bucket_order_and_extremes(spark):
    from tidecast.operators.quantile import log_bucket

    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(0, 1, 500), rng.lognormal(3, 2, 500), -rng.lognormal(1, 3, 300), [0.0] * 50,
                           [2.0 ** k for k in range(-30, 60)], [np.nextafter(2.0 ** k, 0) for k in range(-30, 60)],
                           [5e-324, -5e-324, 1e308, -1e308]])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    rows = sorted(df.select("v", log_bucket(F.col("v")).alias("b")).collect(), key=lambda r: r.v)
    assert all(rows[i].b <= rows[i + 1].b for i in range(len(rows) - 1))
    probs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(df, "v", probs, names=[f"p{i}" for i in range(len(probs))]).first()
    assert list(got) == pytest.approx(list(np.percentile(vals, [p * 100 for p in probs])), rel=1e-12)


def test_forward_fill_rows_hot_store_spans_blocks(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(6000):  # the hot store: 6000 rows over 30 days, long leading gap, random gaps
        v = None if (i < 900 or rng.random() < 0.4) else float(i)
        rows.append(("hot", D(2024, 1, 1) + dt.timedelta(days=i % 30), i, v))
    for i in range(300):
        rows.append((f"s{i % 3}", D(2024, 1, 1) + dt.timedelta(days=i % 10), i, None if rng.random() < 0.5 else float(-i)))
    rows.append(("empty", D(2024, 1, 1), 0, None))
    df = spark.createDataFrame(rows, "store string, date date, seq long, sales double")
    got = {(r.store, r.date, r.seq): r.sales for r in clean.forward_fill_rows(df, "sales", ["store"], ["date"], ["seq"], blocks=16).collect()}
    # brute force on the driver (small fixture)
    want = {}
    by_store = {}
    for s, d, q, v in rows:
        by_store.setdefault(s, []).append((d, q, v))
    for s, items in by_store.items():
        items.sort(key=lambda t: (t[0], t[1]))
        first = next((v for _, _, v in items if v is not None), None)
        last = None
        for d, q, v in items:
            last = v if v is not None else last
            want[(s, d, q)] = v if v is not None else (last if last is not None else first)
    assert got == want
