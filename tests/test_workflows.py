"""End-to-end flows and the recommendation invariants of the reference's test suite."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import recommend as rec
from tidecast.plans import workflows

MONTHS = {"January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"}


@pytest.fixture(scope="module")
def f9(spark):
    """Seasonal 36-month series from 2010-02 (F9 shape), two series so every rule runs grouped."""
    rng = np.random.default_rng(42)
    rows = []
    for sid, scale in (("a", 1.0), ("b", 0.5)):
        for i in range(36):
            month = dt.date(2010 + (i + 1) // 12, (i + 1) % 12 + 1, 1)
            rows.append((sid, month, float(scale * (2e8 + 5e7 * np.sin(2 * np.pi * i / 12) + rng.normal(0, 2e7)))))
    return spark.createDataFrame(rows, "sid string, period date, value double")


def test_twelve_month_coverage(f9):
    for df in (rec.stock(f9, ["sid"]), rec.pricing(f9, ["sid"]), rec.festival(f9, ["sid"])):
        got = {}
        for r in df.select("sid", "month").collect():
            got.setdefault(r.sid, set()).add(r.month)
        assert got == {"a": MONTHS, "b": MONTHS}


def test_stock_pricing_alignment(f9):
    s = rec.stock(f9, ["sid"]).select("sid", "month_num", "action")
    p = rec.pricing(f9, ["sid"]).select("sid", "month_num", "strategy")
    for r in s.join(p, ["sid", "month_num"]).collect():
        if r.action == "INCREASE":
            assert r.strategy in ("PREMIUM PRICING", "NORMAL PRICING")
        if r.action == "DECREASE":
            assert r.strategy in ("LIGHT DISCOUNT", "AGGRESSIVE DISCOUNT")


def test_demand_thresholds_bracket_mean(f9):
    for r in rec.demand(f9, ["sid"]).collect():
        assert r.low_threshold <= r.overall_mean <= r.high_threshold


def test_bundle_has_every_section(f9):
    b = rec.bundle(f9, ["sid"])
    assert {"demand_analysis", "price_elasticity", "revenue_optimization", "competitive_positioning", "stock_recommendations",
            "inventory_optimization", "pricing_recommendations", "festival_promotions", "summary", "quick_wins"} <= set(b)
    assert b["summary"].count() == 2 and b["revenue_optimization"].count() == 4
    j = rec.bundle_json(f9, ["sid"]).collect()
    assert len(j) == 2 and all('"festival_promotions"' in r.recommendations_json for r in j)


def test_upload_flow(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [
        (f"{(dt.date(2024, 1, 1) + dt.timedelta(days=i)).strftime('%d-%m-%Y')}", f"S{i % 3}", f"{1000 + 500 * np.sin(i / 9) + rng.normal(0, 50):.2f}")
        for i in range(240)
    ] + [("not a date", "S1", "5"), ("01-02-2024", "S2", "oops")]
    raw = spark.createDataFrame(rows, "`Sale Date` string, `Store No` string, `Net Sales` string")
    path = str(tmp_path / "upload")
    raw.coalesce(1).write.option("header", True).csv(path)
    out = workflows.upload_flow(spark, path, horizon_days=30, numTrees=5, maxDepth=4)
    rep = out["validation_report"].first()
    assert (rep.records_in, rep.records_valid, rep.records_dropped) == (242, 240, 2)
    assert out["rejected"].count() == 2
    assert out["predictions"].count() == 30
    assert out["monthly_predictions"].agg(F.sum("days_in_month")).first()[0] == 30
    assert out["overall_stats"].first().total_records == 240
    assert {r.split for r in out["model_metrics"].collect()} == {"train", "test"}


def test_recommendations_from_fact(spark):
    rows = [(f"S{s}", dt.date(2023, 1, 1) + dt.timedelta(days=d), float(100 + d % 30 + 10 * s)) for s in range(2) for d in range(400)]
    fact = spark.createDataFrame(rows, "store string, date date, sales double")
    b = workflows.recommendations(fact, ["store"])
    assert b["stock_recommendations"].count() == 24
