"""The log table: appends rewrite nothing, commits are whole or not there, reads are last-wins, compaction changes no row."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidecast.sinks import log_table as lt
from tidecast.sinks import tables as sk
from tidecast.sources import intake, tenant

SCHEMA = "user_id string, store_id string, date string, sales double, n int"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def local(path):
    return path.removeprefix("file:")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(local(path)) for f in names}


def stored(spark, path):
    return sorted((r.user_id, r.store_id, r.date, r.sales) for r in lt.read(spark, path).collect())


@pytest.fixture()
def path(spark):
    p = sk.shared_path(spark, "log")
    lt.append(spark, p, rows(spark, *[(str(u), "s", f"2024-{m:02d}-03", float(u), 0) for u in (1, 2, 3) for m in (1, 2)]), order="n")
    return p


def test_a_small_upload_rewrites_nothing(spark, path):
    before = files(path)
    lt.append(spark, path, rows(spark, ("1", "s", "03-02-2024", 50.0, 1), ("1", "s", "3 Feb 2024", 60.0, 2), ("x", "s", "2024-02-03", 1.0, 3), ("2", None, "2024-02-03", 1.0, 4), ("9", "s", "bad", 1.0, 5)), order="n")
    after = files(path)
    assert before.items() <= after.items() and len(after) > len(before)
    assert [r for r in stored(spark, path) if r[0] == 1] == [(1, "s", dt.date(2024, 1, 3), 1.0), (1, "s", dt.date(2024, 2, 3), 60.0)]
    assert len(stored(spark, path)) == 6


def test_later_batches_win_and_filters_reach_the_partitions(spark, path):
    for v in (10.0, 20.0):
        lt.append(spark, path, rows(spark, ("2", "s", "2024-01-03", v, 99 - int(v))), order="n")
    assert (2, "s", dt.date(2024, 1, 3), 20.0) in stored(spark, path)
    scan = tenant.tenant_scan(lt.read(spark, path), 2, start_date="2024-02-01")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "tenant_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [(r.store_id, r.sales) for r in scan.collect()] == [("s", 2.0)]


def test_a_killed_replacement_leaves_the_old_state(spark, path, monkeypatch):
    old = stored(spark, path)

    def killed(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(lt, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            lt.replace_tenants(spark, path, rows(spark, ("1", "t", "2024-05-05", 7.0, 1)), order="n")
    assert stored(spark, path) == old
    # a file that is no whole commit counts for nothing, and its number is not used again
    broken = f"{local(path)}/{lt.COMMITS}/{lt.state(spark, path).version + 1:012d}.json"
    with open(broken, "w") as f:
        f.write('{"version": 99, "bat')
    assert stored(spark, path) == old
    lt.replace_tenants(spark, path, rows(spark, ("1", "t", "2024-05-05", 7.0, 1)), order="n")
    assert [r for r in stored(spark, path) if r[0] == 1] == [(1, "t", dt.date(2024, 5, 5), 7.0)] and len(stored(spark, path)) == 5
    assert open(broken).read().startswith('{"version": 99')


def test_two_writers_take_their_changes_one_after_the_other(spark, path, monkeypatch):
    whole, lost = lt.state, []

    def slow(spark_, path_):
        seen = whole(spark_, path_)
        if not lost:  # another upload is committed between reading the state and writing the next
            lost.append(1)
            lt.append(spark, path, rows(spark, ("8", "s", "2024-03-03", 8.0, 1)), order="n")
        return seen

    monkeypatch.setattr(lt, "state", slow)
    lt.commit(spark, path, lambda s: lt.replace(s, streams={**s.streams, "x": 1}))
    monkeypatch.undo()
    assert (8, "s", dt.date(2024, 3, 3), 8.0) in stored(spark, path) and lt.state(spark, path).streams == {"x": 1}


def test_a_stream_batch_counts_once(spark, path):
    batch = rows(spark, ("1", "s", "2024-01-03", 70.0, 1))
    lt.append(spark, path, batch, order="n", stream=("u", 4))
    lt.append(spark, path, rows(spark, ("1", "s", "2024-01-03", 80.0, 1)), order="n", stream=("u", 5))
    lt.append(spark, path, batch, order="n", stream=("u", 4))
    assert (1, "s", dt.date(2024, 1, 3), 80.0) in stored(spark, path)


def test_compaction_and_vacuum(spark, path):
    lt.append(spark, path, rows(spark, ("2", "s", "2024-01-03", 20.0, 1), ("3", "s", "2024-01-03", 30.0, 1)), order="n")
    lt.delete_tenant(spark, path, 3)
    want = stored(spark, path)
    seen = lt.state(spark, path)
    lt.compact(spark, path)
    assert stored(spark, path) == want and len(lt.state(spark, path).batches) == 1 and not lt.state(spark, path).dropped
    lt.append(spark, path, rows(spark, ("2", "s", "2024-01-03", 21.0, 0)), order="n")  # on top of the folded batch
    assert (2, "s", dt.date(2024, 1, 3), 21.0) in stored(spark, path)
    assert lt.vacuum(spark, path) == []
    gone = lt.vacuum(spark, path, after_hours=-1)
    assert {f"data/batch={f}" for f in seen.batches} <= set(gone) and any(g.startswith("dropped") for g in gone)
    assert (2, "s", dt.date(2024, 1, 3), 21.0) in stored(spark, path)
    empty = sk.shared_path(spark, "none")
    assert lt.read(spark, empty).count() == 0 and lt.compact(spark, empty) == 0


def test_listing_of_odd_names(spark, tmp_path):
    for name, text in {"a b.csv": "x", "c+d.CSV": "yy", "é%20,.csv": "z", "empty.csv": "", "note.txt": "n", "_hidden.csv": "h", ".dot.csv": "d"}.items():
        (tmp_path / "deep" / "er").mkdir(parents=True, exist_ok=True)
        (tmp_path / "deep" / "er" / name).write_text(text)
    (tmp_path / "big.csv").write_text("b" * 100)
    got = {r.file_name: (r.length, r.reject_reason, r.accepted) for r in intake.upload_manifest(spark, str(tmp_path), max_bytes=50).collect()}
    assert got == {"a b.csv": (1, None, True), "c+d.CSV": (2, None, True), "é%20,.csv": (1, None, True), "empty.csv": (0, "empty file", False), "note.txt": (1, "not a .csv file", False), "big.csv": (100, "file too large", False)}
    (tmp_path / "none").mkdir()
    assert intake.upload_manifest(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        intake.upload_manifest(spark, str(tmp_path / "missing"))
    assert intake.upload_manifest(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 6
