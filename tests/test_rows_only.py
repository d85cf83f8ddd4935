"""Direct checks for operators that have no SQL oracle (files, JSON documents, model rankings)."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import arima, stationarity as st
from tidecast.sinks import log_table as lt
from tidecast.sinks import tables as sk
from tidecast.sources import intake


def test_upload_manifest_reasons(spark, tmp_path):
    (tmp_path / "good.csv").write_text("Date,Sales\n2024-01-01,5\n")
    (tmp_path / "EMPTY.CSV").write_text("")
    (tmp_path / "notes.txt").write_text("hello")
    sub = tmp_path / "nested"
    sub.mkdir()
    (sub / "big.csv").write_text("x" * 2048)
    got = {r.file_name: (r.accepted, r.reject_reason, r.length) for r in intake.upload_manifest(spark, str(tmp_path), max_bytes=1024).collect()}
    assert got["good.csv"][0] is True and got["good.csv"][2] > 0
    assert got["EMPTY.CSV"][:2] == (False, "empty file")
    assert got["notes.txt"][:2] == (False, "not a .csv file")
    assert got["big.csv"][:2] == (False, "file too large")


def test_json_report_structure(spark):
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=d), float(10 * d + (1 if s == "a" else 2))) for s in ("a", "b") for d in range(5)]
    pred = spark.createDataFrame(rows, "store string, date date, predicted_sales double")
    docs = {r.store: json.loads(r.report_json) for r in sk.json_report(pred, ["store"]).collect()}
    a = docs["a"]
    assert a["summary"]["total_predictions"] == 5 and a["summary"]["max"] == 41.0
    assert [p["date"] for p in a["predictions"]] == [f"2024-01-0{d}" for d in range(1, 6)]
    assert a["metadata"]["start"] == "2024-01-01" and a["metadata"]["end"] == "2024-01-05"


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(3)
    rows = []
    for sid in ("w1", "w2"):
        y = np.cumsum(rng.normal(0, 1, 90)) + 100
        rows += [(sid, dt.date(2010 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "sid string, period date, value double")


def test_compare_orders_ranks_follow_aic(walks):
    res = arima.compare_orders(walks, ["sid"]).collect()
    for sid in ("w1", "w2"):
        mine = [r for r in res if r.sid == sid and r.converged]
        best = min(mine, key=lambda r: (r.aic, r.p, r.q))
        assert best.aic_rank == 1
        assert sorted(r.aic_rank for r in mine) == list(range(1, len(mine) + 1))


def test_prepared_random_walk_is_stationary(walks):
    prepared, report = st.prepare_stationary(walks, ["sid"], max_d=2)
    rep = {r.sid: r for r in report.collect()}
    assert all(r.d >= 1 and r.is_ready for r in rep.values())
    n = {r.sid: r["count"] for r in prepared.groupBy("sid").count().collect()}
    assert all(n[s] == 90 - rep[s].d for s in n)


def test_delete_and_replace_tenant(spark):
    rows = [(u, f"s{u % 3}", dt.date(2024, 1, 1) + dt.timedelta(days=d), float(u * 100 + d)) for u in range(1, 41) for d in range(3)]
    df = spark.createDataFrame(rows, "user_id bigint, store_id string, date date, sales double")
    path = sk.shared_path(spark, "tenant-test")
    lt.append(spark, path, df, order="user_id")
    lt.delete_tenant(spark, path, 7)
    t = lt.read(spark, path)
    users = {r.user_id for r in t.select("user_id").distinct().collect()}
    assert users == set(range(1, 41)) - {7} and t.count() == 39 * 3
    new = spark.createDataFrame([(9, "s9", dt.date(2025, 1, 1), 1.0)], "user_id bigint, store_id string, date date, sales double")
    lt.replace_tenants(spark, path, new)
    t = lt.read(spark, path)
    assert [tuple(r) for r in t.where("user_id = 9").select("store_id", "sales").collect()] == [("s9", 1.0)]
    assert t.where("user_id != 9").count() == 38 * 3
