"""Inputs that the checked queries do not hold: huge totals, gaps, short history, junk keys, unreadable tables, mixed headers."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidecast.functions.dates import parse_date
from tidecast.functions.numeric import round_half_up
from tidecast.operators import eda, recommend
from tidecast.operators import forecast as fc
from tidecast.session import ensure_checkpoint_dir
from tidecast.sinks import tables as sk
from tidecast.sources import intake


def test_rounding_has_no_ceiling(spark):
    values = [9.3e12, 5e13, 3e16, -3e16, 1.0e300, 12345.675, -0.125, 1e12 + 0.25]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.r for r in df.orderBy("i").select(round_half_up("v", 2).alias("r")).collect()]
    assert got[:5] == values[:5]
    assert got[5] == pytest.approx(12345.68) and got[7] == 1e12 + 0.25


def test_annual_revenue_of_large_months(spark):
    rows = [("a", dt.date(2023, m, 1), 4e10 + m) for m in range(1, 13)]
    series = spark.createDataFrame(rows, "store string, period date, value double")
    out = recommend.revenue(series, ["store"]).first().asDict()
    assert max(v for v in out.values() if isinstance(v, float)) > 1.4e13


def months(store, first, n, skip=()):
    return [(store, dt.date(first + (m // 12), m % 12 + 1, 1), float(100 * (m % 12 + 1))) for m in range(n) if m not in skip]


def test_seasonal_naive_after_a_gap_and_on_short_history(spark):
    rows = months("gap", 2022, 24, skip={17}) + months("short", 2023, 5)
    series = spark.createDataFrame(rows, "store string, period date, value double")
    got = {}
    for r in fc.seasonal_naive(series, 12, 12, ["store"]).collect():
        got.setdefault(r.store, {})[r.period] = (r.forecast, r.status)
    assert [got["gap"][dt.date(2024, m, 1)][0] for m in (1, 2, 3, 12)] == [100.0, 200.0, 300.0, 1200.0]
    assert got["gap"][dt.date(2024, 6, 1)] == (500.0, "seasonal")  # June 2023 is missing: May stands in
    short = got["short"]
    assert len(short) == 12 and short[dt.date(2023, 6, 1)] == (500.0, "short history")
    assert short[dt.date(2024, 1, 1)] == (100.0, "seasonal")


def test_histograms_keep_empty_bins(spark):
    fact = spark.createDataFrame([(1.0,), (2.0,), (1001.0,), (None,)], "sales double")
    rows = eda.histogram(fact, bins=50).orderBy("bin").collect()
    assert [r.bin for r in rows] == list(range(50)) and sum(r["count"] for r in rows) == 3
    fixed = eda.fixed_width_histogram(fact, width=100.0).orderBy("bin").collect()
    assert [(r.bin, r["count"]) for r in fixed] == [(0, 2), *((b, 0) for b in range(1, 10)), (10, 1)]
    forecast = spark.createDataFrame([("a", 1.0), ("a", 7.0)], "store string, forecast double")
    assert [r["count"] for r in fc.forecast_histogram(forecast, 6, ["store"]).orderBy("bin").collect()] == [1, 0, 0, 0, 0, 1]


def test_risk_follows_the_band(spark):
    daily = spark.createDataFrame([(dt.date(2024, 1, d), 100.0) for d in range(1, 29)], "date date, sales double")
    pred = spark.createDataFrame([(dt.date(2024, 2, 1), 100.0, 90.0, 110.0), (dt.date(2024, 2, 2), 100.0, 85.0, 110.0), (dt.date(2024, 2, 3), 100.0, 50.0, 150.0)], "date date, predicted_sales double, lower_ci double, upper_ci double")
    risks = [r.risk_level for r in fc.decorate(pred, daily).orderBy("date").collect()]
    assert risks == ["Low", "Medium", "High"]
    plain = pred.select("date", "predicted_sales")
    assert {r.risk_level for r in fc.decorate(plain, daily).collect()} == {"Medium"}
    assert {r.risk_level for r in fc.decorate(plain, daily, band=0.2).collect()} == {"High"}


def stored(spark, rows):
    return spark.createDataFrame(rows, "user_id string, store_id string, date string, sales double, n int")


def test_upsert_counts_junk_keys_and_rewrites_only_its_months(spark):
    path = sk.shared_path(spark, "months")
    first = stored(spark, [(str(u), "s", f"2024-{m:02d}-03", float(u), 0) for u in (1, 2, 3) for m in (1, 2, 3)])
    sk.write_stored(sk.upsert(spark, path, [first], order="n"), path)
    files = {f for d, _, fs in os.walk(path.removeprefix("file:")) for f in [os.path.join(d, x) for x in fs if x.endswith(".parquet")]}
    batch = stored(spark, [("1", "s", "03-02-2024", 50.0, 1), ("1", "s", "3 February 2024", 60.0, 2), ("x", "s", "2024-02-03", 1.0, 3), ("2", "s", "bad", 1.0, 4), ("2", None, "2024-02-03", 1.0, 5)])
    assert sk.upsert_report([batch]).first().asDict() == {"stored": 2, "failed": 3}
    sk.write_stored(sk.upsert(spark, path, [batch], order="n"), path)
    table = {(r.user_id, r.date.month): r.sales for r in spark.read.parquet(path).collect()}
    assert table == {**{(u, m): float(u) for u in (1, 2, 3) for m in (1, 2, 3)}, (1, 2): 60.0}
    after = {f for d, _, fs in os.walk(path.removeprefix("file:")) for f in [os.path.join(d, x) for x in fs if x.endswith(".parquet")]}
    assert all("sale_month=2024-02" in f for f in files ^ after)


def test_upsert_onto_an_unreadable_table_fails_and_changes_nothing(spark):
    path = sk.shared_path(spark, "broken")
    local = path.removeprefix("file:")
    os.makedirs(local)
    with open(f"{local}/part-0.parquet", "wb") as f:
        f.write(b"not a parquet file")
    batch = stored(spark, [("1", "s", "2024-01-01", 1.0, 1)])
    with pytest.raises(Exception):
        sk.write_stored(sk.upsert(spark, path, [batch], order="n"), path)
    assert open(f"{local}/part-0.parquet", "rb").read() == b"not a parquet file"


DATES = {
    "12-25-2024": dt.date(2024, 12, 25), "25 December 2024": dt.date(2024, 12, 25), "Dec 25, 2024": dt.date(2024, 12, 25), "december 25, 2024": dt.date(2024, 12, 25),
    "25/12/24": dt.date(2024, 12, 25), "20241225": dt.date(2024, 12, 25), "12/25/2024 10:30 AM": dt.date(2024, 12, 25), "2024-12-25T10:30:00Z": dt.date(2024, 12, 25),
    "05-06-2024": dt.date(2024, 6, 5), "12.25.2024": dt.date(2024, 12, 25), "01/02/95": dt.date(1995, 2, 1), "25 dec 2024": dt.date(2024, 12, 25),
    "1/5/24 9:30": dt.date(2024, 5, 1), "25-Dec-2024": dt.date(2024, 12, 25), "Sept 5, 2024": dt.date(2024, 9, 5), "5-september-2024": dt.date(2024, 9, 5), "5 sept 2024": dt.date(2024, 9, 5),
    "2024.1.1": None, "1.1.24": None, "1-1/2024": None, "12 dec5 2024": None, "2024 Dec 25": None, "Decem 5, 2024": None, "13-13-2024": None, "00-05-2024": None, " , ": None,
    "31-02-2024": None, "99999999": None, "soon": None, "": None, "Foo 25, 2024": None,
}


def test_date_layouts(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "t string")
    assert {r.t: r.d for r in df.select("t", parse_date("t").alias("d")).collect()} == DATES


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Sales,Store\n2024-01-01,5,x\n")
    (tmp_path / "b.csv").write_text("Store,Date,Sales,Note\ny,2024-01-02,6,n\nz,bad,7,\n")
    (tmp_path / "c.csv").write_text("Order Date,Weekly_Sales\n2024-01-03,8\n")
    valid, rejected, report = intake.validate_csv(spark, str(tmp_path))
    assert sorted((r.store, r.date.day, r.sales) for r in valid.collect()) == [("1", 3, 8.0), ("x", 1, 5.0), ("y", 2, 6.0)]
    assert rejected.count() == 1 and report.first().records_in == 4


def test_fallback_only_for_missing_or_invalid_sources(spark, tmp_path):
    (tmp_path / "good.csv").write_text("Date,Sales\n2024-01-01,5\n")
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    path, valid, _, _ = intake.load_with_fallback(spark, [str(tmp_path / "none.csv"), str(tmp_path / "other.csv"), str(tmp_path / "good.csv")])
    assert path.endswith("good.csv") and valid.count() == 1
    with pytest.raises(ValueError):
        intake.load_with_fallback(spark, [str(tmp_path / "other.csv")])
    with pytest.raises(Exception) as e:
        intake.load_with_fallback(spark, ["nosuchscheme://x/y.csv", str(tmp_path / "good.csv")])
    assert not isinstance(e.value, ValueError)


def test_shared_folder_must_be_named_off_local_masters():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_package_reaches_the_workers(spark, tmp_path):
    import subprocess
    import sys

    code = (
        "import importlib.util, sys\n"
        f"spec = importlib.util.spec_from_file_location('__spark_entry__', {os.path.abspath('__spark_entry__.py')!r})\n"
        "E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', E.queries()['ts_adf'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "rows " in out.stdout, out.stderr[-2000:]
