"""MLlib smoke / property tests on the deterministic F3/F6 shapes."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tidecast import session
from tidecast.functions.calendar import FEATURES7, temporal_features7
from tidecast.operators import encode, forest, grow, ml
from tidecast.plans import q_ml

from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def f6(spark):
    rows = [(dt.date(2022, 1, 1) + dt.timedelta(days=i), float(100 + 2 * i + 10 * (i % 7))) for i in range(100)]
    return temporal_features7(spark.createDataFrame(rows, "date date, sales double"), "date")


def test_train_predict_save_load(spark, f6, tmp_path):
    model, data = ml.train(f6, FEATURES7, "sales", ["date"], numTrees=10, maxDepth=5)
    m = {r.split: r for r in ml.metrics(model.transform(data)).collect()}
    assert set(m) == {"train", "test"} and m["train"].r2 > 0.8
    imp = ml.importance(model, FEATURES7).collect()
    assert len(imp) == 7 and abs(sum(r.importance for r in imp) - 1) < 1e-6
    path = ml.save(model, str(tmp_path / "m"))
    again = ml.load(path)
    a = [r.prediction for r in model.transform(data).orderBy("date").collect()]
    b = [r.prediction for r in again.transform(data).orderBy("date").collect()]
    assert a == b


def test_thirty_future_days(spark, f6):
    model, _ = ml.train(f6, FEATURES7, "sales", ["date"], numTrees=5, maxDepth=4)
    fc = ml.daily_forecast(model, f6, 30).collect()
    assert len(fc) == 30 and all(r.predicted_sales is not None and r.lower_bound <= r.predicted_sales <= r.upper_bound for r in fc)
    assert min(r.date for r in fc) == dt.date(2022, 4, 11)


def test_split_is_deterministic(spark, f6):
    a = {r.date: r.is_train for r in ml.split(f6, ["date"]).collect()}
    b = {r.date: r.is_train for r in ml.split(f6.repartition(7), ["date"]).collect()}
    assert a == b and 60 <= sum(a.values()) <= 95


def test_unseen_category_and_missing_feature(spark, f6):
    df = f6.withColumn("store", F.when(F.col("day") % 2 == 0, "A").otherwise("B"))
    model, _ = ml.train(df, ["store", *FEATURES7], "sales", ["date"], numTrees=5, maxDepth=4)
    score = df.withColumn("store", F.lit("never-seen")).drop("quarter")
    out = ml.predict(model, score, ["store", *FEATURES7]).collect()
    assert len(out) == 100 and all(r.prediction is not None for r in out)


def test_lag_forecast_twelve_steps(spark):
    rows = [("s", dt.date(2015 + i // 12, i % 12 + 1, 1), float(100 + (i % 12) * 5 + i)) for i in range(48)]
    series = spark.createDataFrame(rows, "sid string, period date, value double")
    fc = ml.lag_forecast(series, 12, ["sid"], numTrees=10, maxDepth=5, checkpoint_every=4).orderBy("step").collect()
    assert [r.step for r in fc] == list(range(1, 13))
    assert fc[0].period == dt.date(2019, 1, 1)
    assert all(r.lower_ci <= r.forecast <= r.upper_ci for r in fc)


def test_codes_run_on_across_ranges(spark):
    rng = random.Random(1)
    labels = sorted({"".join(rng.choice("abzAZ09é") for _ in range(rng.randint(0, 4))) for _ in range(300)}, key=lambda t: t.encode())
    rows = [(t, "x" if i % 2 else None) for i, t in enumerate(labels * 2)] + [(None, "y")] + [("hot", "x")] * 500
    df = spark.createDataFrame(rows, "store string, kind string")
    want = sorted({*labels, "hot"}, key=lambda t: t.encode())
    for size in (1, 20, 10_000):
        codes = encode.label_codes(df, ["store", "kind"], range_labels=size)
        got = {(r.column, r.label): r.code for r in codes.collect()}
        assert got == {**{("store", t): i for i, t in enumerate(want)}, ("kind", "x"): 0, ("kind", "y"): 1}
    coded = encode.apply_codes(spark.createDataFrame([("hot",), (None,), ("never",)], "store string"), codes, ["store"])
    assert {r.store: r["store__code"] for r in coded.collect()} == {"hot": want.index("hot"), None: len(want), "never": len(want)}
    assert encode.label_codes(df.limit(0), ["store"]).count() == 0


def test_scaling_leaves_constant_columns_at_zero(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (4.0, 5)], "a double, b int")
    got = [r.features for r in encode.scaled(df, ["a", "b"]).orderBy("a").collect()]
    assert [x[1] for x in got] == [0.0] * 3 and sum(x[0] for x in got) == pytest.approx(0)


def test_no_split_of_too_few_rows(spark, f6, tmp_path):
    noisy = f6.withColumn("sales", F.col("sales") + F.pmod(F.hash("date"), F.lit(97)))
    train = {}
    for least in (2, 12):
        model, data = ml.train(noisy, FEATURES7, "sales", ["date"], numTrees=7, maxDepth=12, min_split=least)
        path = ml.save(model, str(tmp_path / f"m{least}"))
        rf = str(next((tmp_path / f"m{least}" / "pipeline" / "stages").glob("*RandomForest*")))
        table = forest.nodes(spark, rf).collect()
        splits = [r for r in table if r.leftChild >= 0]
        assert splits and all(r.rawCount >= least for r in splits)
        train[least] = {(r.tree, r.id): r for r in table}
        # scoring is a walk through the node table
        for row in ml.load(path).transform(data.limit(20)).collect():
            total = 0.0
            for t in range(7):
                at = train[least][t, 0]
                while at.leftChild >= 0:
                    left = row.features[at.split.featureIndex] <= at.split.leftCategoriesOrThreshold[0]
                    at = train[least][t, at.leftChild if left else at.rightChild]
                total += at.prediction
            assert row.prediction == pytest.approx(total / 7)
    assert len(train[12]) < len(train[2])
    # folding is idempotent, and trees of one leaf stay
    again = forest.fold(forest.nodes(spark, rf), 12)
    assert again.count() == len(train[12])
    assert forest.fold(forest.nodes(spark, rf), 10**6).where("id = 0 and leftChild = -1").count() == 7


def test_a_fit_has_no_more_tasks_than_cores(spark):
    """Each task of a forest's pass makes and shuffles the figures of every node, whatever the shuffle partitions are."""
    cores = spark.sparkContext.defaultParallelism
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * cores))
    try:
        many = spark.range(4 * cores * session.TASK_ROWS)
        dealt = session.ensure_parallelism(many)
        assert dealt.rdd.getNumPartitions() == cores and dealt.count() == many.count()
        few = spark.range(session.TASK_ROWS + 1)
        assert session.ensure_parallelism(few).rdd.getNumPartitions() == min(2, cores)
        assert session.ensure_parallelism(few.limit(0)).rdd.getNumPartitions() == 1
        assert session.ensure_parallelism(many, few).rdd.getNumPartitions() == min(2, cores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def stumps(x, n, y, limits, least, depth):
    """(rows, sum, feature, bin, children) of the tree that a plain search finds; ``x`` has bins, ``n`` draws."""
    rows, total, best = n.sum(), (n * y).sum(), (0.0, None, None)
    for f, own in enumerate(limits if depth else []):
        for b in range(len(own)):
            left = x[f] <= b
            m, s = n[left].sum(), (n * y)[left].sum()
            if m >= least and rows - m >= least:
                gain = (s * s / m + (total - s) ** 2 / (rows - m) - total * total / rows) / rows
                best = max(best, (gain, -f, -b), key=lambda g: g[0])
    if best[1] is None or best[0] <= 1e-9:
        return rows, total, None, None, ()
    f, b = -best[1], -best[2]
    left = x[f] <= b
    return rows, total, f, b, tuple(stumps(x[:, side], n[side], y[side], limits, least, depth - 1) for side in (left, ~left))


@pytest.mark.parametrize("memory", [256, 0])
def test_trees_are_those_of_a_plain_search(spark, memory):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 4)), rng.random(), 7.0, float(rng.randint(0, 90))) for _ in range(900)]
    rows = [(a, b, c, d, 10 * a + 20 * (b > 0.3) * a + d % 7 + 1000) for a, b, c, d in rows]
    df = spark.createDataFrame(rows, "x0 double, x1 double, x2 double, x3 double, y double").repartition(3).cache()
    rf = RandomForestRegressor(numTrees=3, maxDepth=4, minInstancesPerNode=9, maxBins=32, seed=5, maxMemoryInMB=memory)
    forest_, limits, mean = grow.grow(rf, df, 4)
    assert limits[0].tolist() == [0.5, 1.5, 2.5, 3.5] and limits[2].size == 0 and all(v.size <= 31 for v in limits)
    blocks = grow.pack(df, limits, mean, 3, 1.0, 5).collect()
    bins = np.concatenate([np.frombuffer(b.bins, np.uint8).reshape(4, -1) for b in blocks], axis=1)
    draws = np.concatenate([np.frombuffer(b.draws, np.uint8).reshape(3, -1) for b in blocks], axis=1).astype(float)
    y = np.concatenate([np.frombuffer(b.y) for b in blocks])
    assert bins.shape == (4, 900) and 0.9 < draws.mean() < 1.1 and abs(y.sum()) < 1e-6

    def same(tree, node, want):
        n, s, f, b, children = want
        assert tree.figures[node][:2] == pytest.approx((n, s)) and (tree.left[node] < 0) == (not children)
        if children:
            assert (tree.feature[node], tree.bin[node]) == (f, b)
            for side in (0, 1):
                same(tree, tree.left[node] + side, children[side])

    for t, tree in enumerate(forest_):
        same(tree, 0, stumps(bins, draws[t], y, limits, 9, 4))
        assert len(tree.left) > 9
    stored = list(grow.node_rows(forest_, limits, mean))
    squares = {(t, r[0]): r[3][2] for t, r in stored}
    for t, tree in enumerate(forest_):  # children's squares add up, leaves of the last level included
        for i, left in enumerate(tree.left):
            assert left < 0 or squares[t, i] == pytest.approx(squares[t, left] + squares[t, left + 1])


def test_rows_are_kept_as_bytes_not_as_objects(spark, f6, monkeypatch):
    """MLlib's fit keeps each row as objects of some 200 bytes, more than executors hold, and reads them in every pass."""
    fitted, packed = [], []
    fit, pack = RandomForestRegressor._fit, grow.pack

    def kept(*args):
        packed.append(pack(*args))
        return packed[-1]

    monkeypatch.setattr(RandomForestRegressor, "_fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    monkeypatch.setattr(grow, "pack", kept)
    _, data = ml.train(f6, FEATURES7, "sales", ["date"], numTrees=6, maxDepth=4)
    assert all(n <= 1 for n in fitted)
    n = data.where("is_train").count()
    size = packed[0].selectExpr("sum(length(bins) + length(draws) + length(y))").first()[0]
    assert size == n * (len(FEATURES7) + 6 + 8)


def test_a_forest_predicts_as_well_as_mllibs(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), float(rng.randint(0, 9)), rng.random()) for i in range(3000)]
    df = spark.createDataFrame([(i, a, b, c, 50 * a * b + 10 * (c > 0.5) + rng.random()) for i, a, b, c in rows], "id long, a double, b double, c double, sales double")
    whole = ml.split(df, ["id"])
    settings = {"numTrees": 10, "maxDepth": 6, "minInstancesPerNode": 2, "seed": 1}
    rf = RandomForestRegressor(labelCol="sales", featureSubsetStrategy="all", maxBins=64, **settings)
    theirs = rf.fit(ml.assemble(whole.where("is_train"), ["a", "b", "c"]))
    model, data = ml.train(df, ["a", "b", "c"], "sales", ["id"], **settings)
    want = {r.split: r for r in ml.metrics(theirs.transform(ml.assemble(whole, ["a", "b", "c"]))).collect()}
    got = {r.split: r for r in ml.metrics(model.transform(data)).collect()}
    for part in ("train", "test"):
        assert got[part].n == want[part].n and got[part].rmse < 1.1 * want[part].rmse
    assert model.stages[-1].featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.02)
    scaled, data = ml.train(df, ["a", "b", "c"], "sales", ["id"], scale=True, **settings)
    assert {r.split: r.rmse for r in ml.metrics(scaled.transform(data)).collect()} == pytest.approx({k: r.rmse for k, r in got.items()}, rel=0.05)


def test_metrics_are_those_of_the_train_and_of_the_test_rows(spark, monkeypatch):
    """Rows the forest was fitted on say nothing of how well it predicts others, so the two parts are never pooled."""
    kept = []
    monkeypatch.setattr(q_ml, "trained", lambda *a, f=q_ml.trained: kept.append(f(*a)) or kept[0])
    got = {r.split: r for r in q_ml.q_ml_metrics(spark, SF_SMALL).collect()}
    model, data = kept[0]
    assert set(got) == {"train", "test"} and sum(r.n for r in got.values()) == q_ml.enriched(spark, SF_SMALL).dropna(subset=[*q_ml.FEATURES, "sales"]).count()
    scored = model.transform(data).cache()
    for part, own in (("train", scored.where("is_train")), ("test", scored.where("not is_train"))):
        for name in ("mae", "rmse", "r2"):
            assert got[part][name] == pytest.approx(RegressionEvaluator(labelCol="sales", metricName=name).evaluate(own))


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float64])
def test_blocks_give_back_their_rows(kind):
    values = [np.arange(5 * n).reshape(5, n).astype(kind) for n in (1, 7, 14, 20, 50)]
    blocks = pa.concat_arrays([grow.blocks_of(v, 7) for v in values])
    assert max(len(b) for b in blocks.to_pylist()) == 5 * 7 * np.dtype(kind).itemsize
    lengths = np.array([len(b) // (5 * np.dtype(kind).itemsize) for b in blocks.to_pylist()])
    assert (grow.side_by_side(blocks, lengths, 5, kind) == np.concatenate(values, axis=1)).all()
    assert (grow.side_by_side(blocks[2:], lengths[2:], 5, kind) == np.concatenate(values[2:], axis=1)).all()


def test_memory_of_a_fit_does_not_grow_with_its_rows(spark, monkeypatch):
    """What Spark caches, reads back and hands to a worker at a time is bounded, and a pass still has one task a core."""
    cores = spark.sparkContext.defaultParallelism
    for rows in (0, 1, session.TASK_ROWS * cores, 10**7, 10**9):
        parts = session.fit_parts(spark, rows)
        assert parts >= 1 and rows <= parts * session.PART_ROWS
        assert parts <= cores or parts % cores == 0
    assert session.fit_parts(spark, session.TASK_ROWS * cores) == cores and session.fit_parts(spark, session.TASK_ROWS + 1) == min(2, cores)

    monkeypatch.setattr(session, "PART_ROWS", 100)
    packed, seen, pack, best = [], [], grow.pack, grow.best_splits

    def kept(*args):
        packed.append(pack(*args))
        return packed[-1]

    def looked(df, *args):
        if not seen:
            own = packed[-1].groupBy(F.spark_partition_id()).agg(F.sum(F.length("y") / 8).alias("n"), F.max(F.length("bins") + F.length("draws") + F.length("y")).alias("b"))
            seen.append((df.rdd.getNumPartitions(), packed[-1].storageLevel, own.collect()))
        return best(df, *args)

    monkeypatch.setattr(grow, "pack", kept)
    monkeypatch.setattr(grow, "best_splits", looked)
    rng = random.Random(6)
    rows = [(i, rng.choice("abc"), rng.random()) for i in range(6000)]
    df = spark.createDataFrame([(i, s, a, 10 * a + (s == "a")) for i, s, a in rows], "id long, store string, a double, sales double")
    model, data = ml.train(df, ["store", "a"], "sales", ["id"], numTrees=20, maxDepth=6)
    tasks, level, parts = seen[0]
    assert tasks <= cores and not level.useMemory and level.useDisk
    assert sum(r.n for r in parts) == data.where("is_train").count() and max(r.n for r in parts) <= 200
    assert max(r.b for r in parts) <= grow.BLOCK_BYTES
    assert {r.split: r.r2 > 0.97 for r in ml.metrics(model.transform(data)).collect()} == {"train": True, "test": True}
