"""Moments, distribution figures and bundles: edge groups, refinement of hot buckets, how often the fact is read."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast.operators import eda, forecast, moments, quantile, recommend, rollup
from tidecast.plans import workflows


def sales_rows(n=3000, stores=7, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        store = "hot" if rng.random() < 0.35 else f"s{rng.randrange(stores)}"
        v = None if rng.random() < 0.03 else round(rng.gauss(5e3, 2e3), 2)
        rows.append((store, dt.date(2022, 1, 1) + dt.timedelta(days=rng.randrange(800)), v, rng.randrange(50), 7.25, rng.random() if i % 9 else None))
    return [*rows, ("alone", dt.date(2022, 5, 5), 12.5, 3, 7.25, 0.5), ("none", dt.date(2022, 5, 5), None, 3, 7.25, 0.5)]


SCHEMA = "store string, date date, sales double, quantity int, flat double, share double"


def counted(spark, rows, schema=SCHEMA):
    """The rows, and how often they have been read so far."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema), lambda: seen.value / len(rows)


def test_bundles_read_the_fact_twice(spark):
    for make in (workflows.eda_bundle, workflows.chart_bundle):
        fact, reads = counted(spark, sales_rows())
        for df in make(fact).values():
            df.collect()
        assert reads() == 2
    fact, reads = counted(spark, sales_rows())
    eda.overall_statistics(fact).collect()
    assert reads() == 2
    fact, reads = counted(spark, sales_rows())
    eda.box_plot(fact, keys=["store"]).collect()
    assert reads() == 2


def test_bundle_sections_equal_the_single_operators(spark):
    fact = spark.createDataFrame(sales_rows(), SCHEMA)
    def same(got, want):
        cols = want.columns
        plain = [c for c, t in want.dtypes if t != "double"]
        a, b = (sorted(df.select(*cols).collect(), key=lambda r: str([r[c] for c in plain])) for df in (got, want))
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for c in cols:
                assert x[c] == (pytest.approx(y[c], rel=1e-9, abs=1e-9) if isinstance(y[c], float) else y[c]), c

    for keys in ([], ["region"]):
        f = fact.withColumn("region", F.substring("store", 1, 1)) if keys else fact
        b = workflows.eda_bundle(f, keys)
        want = {
            "monthly_trends": eda.monthly_trends(f, keys), "seasonal_patterns": eda.seasonal_patterns(f, keys), "seasonality_strength": eda.seasonality_strength(f, keys),
            "peak_low_periods": eda.peak_low_periods(f, keys), "store_analysis": eda.store_ranking(f, keys), "store_overview": eda.store_overview(f, keys),
            "day_of_week": eda.weekday_analysis(f, keys), "year_analysis": eda.year_analysis(f, keys),
        }
        for name, df in want.items():
            same(b[name], df)
        corr = eda.correlation_analysis(eda_features(f), columns=[*rollup.CALENDAR, "quantity", "flat", "share"], keys=keys)
        same(b["correlations"], corr)


def test_cells_are_days_and_stores_not_their_pairs(spark):
    """As many as there are days and stores; rows without either have a cell too."""
    rows = [(f"s{i % 40}" if i % 50 else None, dt.date(2022, 1, 1) + dt.timedelta(days=i // 40) if i % 70 else None, float(i), 1, 2.0, 0.5) for i in range(2000)]
    fact = spark.createDataFrame(rows, SCHEMA)
    r = rollup.rollup(fact, columns=["quantity"])
    days, stores = ({x[k] for x in rows} for k in (1, 0))
    assert r.days.count() + r.shops.count() == len(days) + len(stores) and {x.date for x in r.days.collect()} == days and {x.store for x in r.shops.collect()} == stores
    for cells in (r.days, r.shops):
        assert cells.agg(F.sum("records"), F.sum("total")).first()[:] == (2000, sum(x[2] for x in rows))
    one = rollup.overall(r).first()
    assert (one.total_records, one.total_stores, one.date_range_start, one.date_range_end) == (2000, 40, min(days - {None}), max(days - {None}))


def eda_features(fact):
    from tidecast.functions.calendar import temporal_features

    return temporal_features(fact)


def test_nothing_dies_on_constant_single_or_empty_groups(spark):
    fact = spark.createDataFrame(sales_rows(), SCHEMA)
    got = {(r.store, r.variable): r.correlation for r in eda.correlation_analysis(fact, columns=["quantity", "flat", "share"], keys=["store"]).collect()}
    assert not any(v == "flat" or s in ("alone", "none") for s, v in got)
    held = [(r[2], r[3]) for r in sales_rows() if r[0] == "hot" and r[2] is not None]
    assert abs(got["hot", "quantity"] - np.corrcoef(*zip(*held))[0, 1]) < 6e-4
    for some in (fact, fact.limit(0), fact.where("store = 'none'"), fact.where("store = 'alone'")):
        for df in [*workflows.eda_bundle(some).values(), *workflows.chart_bundle(some).values()]:
            df.collect()
    pairs = spark.createDataFrame([("a", 5.0, 1.0), ("a", 5.0, 2.0), ("b", 1.0, 4.0), ("b", 2.0, 4.0), ("c", 1.0, 1.0), ("d", 1.0, 1.0), ("d", 2.0, 3.0)], "k string, actual double, predicted double")
    assert {r.k: r.correlation for r in forecast.metrics(pairs, keys=["k"]).collect()} == {"a": None, "b": None, "c": None, "d": pytest.approx(1.0)}


def test_merged_moments_keep_precision_far_from_zero(spark):
    rng = np.random.default_rng(5)
    x = 1.7e9 + rng.normal(0, 1, 4000)
    y = -3e8 + 0.5 * (x - 1.7e9) + rng.normal(0, 1, 4000)
    rows = [(int(i % 3), int(i % 97), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "k int, part int, x double, y double")
    states = df.groupBy("k", "part").agg(*moments.pair_state(F.col("x"), F.col("y"), "p_"))
    twice = moments.merge(moments.merge(states.withColumn("half", F.col("part") % 2), ["k", "half"], ["p_"]), ["k"], ["p_"])
    for r in twice.select("*", moments.pearson("p_").alias("r")).collect():
        a, b = x[r.k :: 3], y[r.k :: 3]
        assert r.p_n == a.size and abs(r.r - np.corrcoef(a, b)[0, 1]) < 1e-6 and abs(r.p_xx / a.size - a.var()) < 1e-4


values = st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, -0.0, 1.0, 1.0000000001, 2.0, 1e300, -1e300, 5e-324]), st.none())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), values), min_size=1, max_size=60))
def test_quantiles_of_any_values(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.k: tuple(r)[1:] for r in quantile.exact_quantiles(df, "v", probs, ["k"]).collect()}
    for k in "ab":
        own = [v for g, v in rows if g == k and v is not None]
        assert (k in got) == bool(own)
        if own:
            assert got[k] == pytest.approx(tuple(np.quantile(own, probs)), rel=1e-12, abs=1e-300)


def test_hot_buckets_are_cut_until_they_are_small(spark):
    rng = random.Random(2)
    close = [1000 + rng.random() * 1e-3 for _ in range(4000)]  # all of one bucket
    tight = [7.0 + k * 2.0**-50 for k in range(2000)]  # neighbours in the last bits
    rows = [("c", v) for v in close] + [("t", v) for v in tight] + [("e", 3.0)] * 500 + [("n", -v) for v in close]
    df = spark.createDataFrame(rows, "k string, v double")
    buckets = quantile.bucket_table(df, "v", ["k"])
    targets = quantile.rank_targets(buckets, [0.1, 0.5, 0.9], ["k"])
    located = quantile.locate(buckets, quantile.both_ranks(targets, ["k"]), ["k"], "bucket")
    held = quantile.bucket_values(df, "v", located, ["k"])
    for fan in (2, 16):
        found = quantile.values_at(held, located, ["k"], rank_values=30, fan=fan)
        got = {r.k: tuple(r)[1:] for r in quantile.solve(targets, found, ["k"], ["a", "b", "c"]).collect()}
        for k, own in (("c", close), ("t", tight), ("e", [3.0]), ("n", [-v for v in close])):
            assert got[k] == pytest.approx(tuple(np.quantile(own, [0.1, 0.5, 0.9])), rel=1e-15)


def test_box_and_histogram_against_all_values(spark):
    rng = random.Random(9)
    rows = [(k, v) for k in "ab" for v in [rng.gauss(100, 15) for _ in range(700)] + [rng.uniform(-300, 900) for _ in range(40)]] + [("c", 4.0)] * 3 + [("d", None)]
    df = spark.createDataFrame(rows, "k string, sales double")
    box, histogram = quantile.distribution(df, "sales", ["k"], 20)
    got = {r.k: r for r in box.collect()}
    counts = {(r.k, r.bin): r["count"] for r in histogram.collect()}
    for k in "abc":
        own = np.array([v for g, v in rows if g == k])
        q1, med, q3 = np.quantile(own, [0.25, 0.5, 0.75])
        inside = (own >= q1 - 1.5 * (q3 - q1)) & (own <= q3 + 1.5 * (q3 - q1))
        r = got[k]
        assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3), rel=1e-12)
        assert (r.lower_whisker, r.upper_whisker, r.outliers) == (own[inside].min(), own[inside].max(), (~inside).sum())
        want = np.histogram(own, 20)[0] if k != "c" else [3] + [0] * 19
        assert [counts[k, b] for b in range(20)] == list(want)
    assert "d" not in got


def test_far_outliers_add_a_row_not_a_bin_for_each_width(spark):
    fact = spark.createDataFrame([("a", 1.0), ("a", 4500.0), ("a", 3e13), ("b", -1e300), ("b", 1e300), ("c", 9.0), ("d", None)], "store string, sales double")
    rows = {}
    for r in eda.fixed_width_histogram(fact, keys=["store"]).orderBy("bin").collect():
        rows.setdefault(r.store, []).append((r.bin, r["count"], r.bin_start, r.bin_end))
    far = math.floor(3e13 / 2000)
    assert rows["a"] == [(0, 1, 0.0, 2000.0), (1, 0, 2000.0, 4000.0), (2, 1, 4000.0, 6000.0), (3, 0, 6000.0, far * 2000.0), (far, 1, far * 2000.0, (far + 1) * 2000.0)]
    assert len(rows["b"]) == 3 and sum(r[1] for r in rows["b"]) == 2 and rows["c"] == [(0, 1, 0.0, 2000.0)] and "d" not in rows
    spread = eda.store_value_histogram(fact.where("store <> 'b'"))
    assert spread.count() < 20 and spread.agg(F.sum("count")).first()[0] == 6


def test_recommendation_bundle_reads_the_series_once(spark):
    rows = [(f"S{s}", dt.date(2020 + i // 12, i % 12 + 1, 1), float(100 + 13 * (i % 5) + 10 * s)) for s in range(7) for i in range(30)]
    series, reads = counted(spark, rows, "store string, period date, value double")
    assert len(recommend.bundle_json(series, ["store"]).collect()) == 7
    assert reads() == 1
    series, reads = counted(spark, rows, "store string, period date, value double")
    shared = recommend.bundle(series, ["store"])
    plain = spark.createDataFrame(rows, "store string, period date, value double")
    for name, one in (("summary", recommend.summary), ("quick_wins", recommend.quick_wins), ("revenue_optimization", recommend.revenue)):
        assert sorted(shared[name].collect()) == sorted(one(plain, ["store"]).collect())
    assert reads() == 1
    assert len(recommend.bundle(plain.where("store = 'S1'").drop("store"))["summary"].collect()) == 1
