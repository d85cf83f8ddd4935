"""Growing a random forest on packed rows: MLlib's regression forest, its passes counted by numpy.

MLlib keeps a row with its draws as objects of some 200 bytes and updates one figure at a time; the passes over rows x
trees x features are then bound by memory, and rows that no longer fit are written as Java objects and read back in
every pass. Here a task packs its rows once, in small blocks: a byte per feature (its bin), a byte per tree (how often the tree
drew the row), the label. Blocks are kept on disk, in partitions of bounded size, so that no task's memory grows with the
table; a task takes as many of them as there are per core. A pass over the blocks counts and sums the labels by tree, node, feature and bin; Spark adds up
the tasks' figures per group of nodes, and the best split of each node, nothing else, goes to the driver.

The forest is the one that ``RandomForestRegressor`` describes: every row and every feature, draws from Poisson(rate) per
tree, splits between the bins of ``maxBins`` quantiles (between all values where they are fewer) by the fall in variance, the
first of equal ones, ``minInstancesPerNode`` and ``minInfoGain``, depth by depth. ``maxMemoryInMB`` bounds a pass: more
nodes are taken in several passes. Its result is MLlib's model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.tables import shared_path

#: Rows that are packed or counted at a time.
BLOCK_ROWS = 1 << 15
#: Bytes of a block. Spark hands over many blocks at a time (10,000 by default), so these bound what a worker holds.
BLOCK_BYTES = 1 << 11
#: Nodes whose figures are added up together.
NODES = 128
#: Gains below this part of a node's mean square are rounding.
ROUNDING = 1e-12


@dataclass
class Tree:
    """Nodes in the order they were made: a node's children are ``left`` and ``left`` + 1, or it is a leaf (-1)."""

    feature: list = field(default_factory=lambda: [0])
    bin: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    gain: list = field(default_factory=lambda: [-1.0])
    figures: list = field(default_factory=lambda: [(0.0, 0.0, 0.0)])  # rows, sum and squares of the centred label

    def split(self, node: int, feature: int, at: int, gain: float) -> list[int]:
        self.feature[node], self.bin[node], self.left[node], self.gain[node] = feature, at, len(self.left), gain
        for column, first in ((self.feature, 0), (self.bin, 0), (self.left, -1), (self.gain, -1.0), (self.figures, (0.0, 0.0, 0.0))):
            column += [first, first]
        return [self.left[node], self.left[node] + 1]

    def table(self, wanted: list[int], bins: int) -> tuple:
        """Arrays to walk by (a leaf leads to itself, whatever the bin), the place of each wanted node, and how many they are."""
        left = np.array(self.left)
        leaf, slot = left < 0, np.full(len(left), -1)
        slot[wanted] = np.arange(len(wanted))
        return np.array(self.feature), np.where(leaf, bins, self.bin), np.where(leaf, np.arange(len(left)), left), slot, len(wanted)


def bin_limits(rows: DataFrame, features: int, max_bins: int) -> tuple[list[np.ndarray], float, int]:
    """Upper limits of each feature's bins (the last bin has none), the label's mean and the number of rows; all rows count."""
    column = [F.col(f"x{i}") for i in range(features)]
    *seen, mean, n = rows.agg(*[F.approx_count_distinct(c) for c in column], F.avg("y"), F.count(F.lit(1))).first()
    if not n:
        raise ValueError("a forest needs rows to be fitted on")
    part = [i / max_bins for i in range(1, max_bins)]
    none = F.lit(None).cast("array<double>")
    sets = [F.sort_array(F.collect_set(c)) if k <= 2 * max_bins else none for c, k in zip(column, seen)]  # the estimates are rough
    parts = [F.percentile_approx(c, part) if k > max_bins // 2 else none for c, k in zip(column, seen)]
    found = rows.agg(*sets, *parts).first()
    limits = []
    for i in range(features):
        every, quantiles = found[i], found[features + i]
        if every is None or quantiles is not None and len(every) > max_bins:
            limits.append(np.unique(quantiles))
        else:
            own = np.array(every)
            middle = own[:-1] / 2 + own[1:] / 2
            limits.append(np.where(np.isfinite(middle), middle, own[:-1]))
    return limits, mean, n


def blocks_of(values: np.ndarray, rows: int) -> pa.Array:
    """Lines of equal length cut into blocks of so many columns: each block line by line, the last one shorter."""
    lines, n = values.shape
    whole = n // rows * rows
    sizes = [lines * rows * values.itemsize] * (whole // rows) + [lines * (n - whole) * values.itemsize] * (whole < n)
    data = values[:, :whole].reshape(lines, -1, rows).transpose(1, 0, 2).tobytes() + values[:, whole:].tobytes()
    offsets = np.cumsum([0, *sizes], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def side_by_side(blocks: pa.Array, lengths: np.ndarray, lines: int, kind: type) -> np.ndarray:
    """The lines that ``blocks_of`` cut, from blocks of so many columns each."""
    cuts = np.flatnonzero(np.diff(lengths)) + 1  # blocks of one length are taken together
    parts = []
    for i, j in zip([0, *cuts], [*cuts, len(lengths)]):
        data = np.frombuffer(b"".join(blocks[i:j].to_pylist()), kind)
        parts.append(data.reshape(j - i, lines, -1).transpose(1, 0, 2).reshape(lines, -1))
    return np.concatenate(parts, axis=1)


def unpacked(batch: pa.RecordBatch, features: int, trees: int, kind: type) -> Iterator[tuple]:
    """Bins, draws and labels of some ``BLOCK_ROWS`` rows at a time."""
    lengths = pc.binary_length(batch.column(2)).to_numpy() // 8
    part = np.cumsum(lengths) // BLOCK_ROWS
    for own in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(part)) + 1):
        if len(own):
            some, sizes = batch.slice(own[0], len(own)), lengths[own]
            yield (*(side_by_side(some.column(i), sizes, *of) for i, of in enumerate(((features, kind), (trees, np.uint8)))), side_by_side(some.column(2), sizes, 1, np.float64)[0])


def pack(rows: DataFrame, limits: list[np.ndarray], mean: float, trees: int, rate: float, seed: int) -> DataFrame:
    """Blocks of rows: bins (feature by feature), draws (tree by tree) and centred labels."""
    kind = np.uint8 if max(map(len, limits)) < 256 else np.uint16
    block_rows = max(1, BLOCK_BYTES // (len(limits) * np.dtype(kind).itemsize + trees + 8))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed % (1 << 63), TaskContext.get().partitionId()])

        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            *x, y = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(len(limits) + 1))
            y = y - mean
            bins = np.stack([np.searchsorted(limit, v).astype(kind) for v, limit in zip(x, limits)])
            draws = np.minimum(rng.poisson(rate, (trees, len(y))), 255).astype(np.uint8)
            return pa.RecordBatch.from_arrays([blocks_of(v, block_rows) for v in (bins, draws, y[None])], names=["bins", "draws", "y"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return rows.mapInArrow(blocks, "bins binary, draws binary, y binary")


def walk(bins: np.ndarray, steps: int, feature: np.ndarray, at_bin: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The node of each row after so many steps from the root."""
    flat, rows, start = bins.ravel(), np.arange(bins.shape[1]), feature * bins.shape[1]
    at = np.zeros(bins.shape[1], dtype=np.int64)
    for _ in range(steps):
        right = flat[start[at] + rows] > at_bin[at]
        at = left[at]
        at += right
    return at


def best_splits(packed: DataFrame, group: dict[int, tuple], level: int, features: int, bins: int, trees: int, least: int, last: bool) -> DataFrame:
    """tree, slot, figures (rows, sum, squares) of each node of the group, its best split and its gain, by one pass over the rows.

    ``group`` has a tree's arrays and slots. Tasks send what isn't zero, per ``NODES`` nodes of a tree; these are added up in the
    order of the tasks, so that reruns agree. On the last level squares are counted by bin too, as its children are leaves that
    no pass follows: ``below`` are the left child's figures.
    """
    kinds = 3 if last else 2
    kind = np.uint8 if bins <= 256 else np.uint16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {t: (np.zeros((3, k)), np.zeros((kinds, features, k * bins))) for t, (*_, k) in group.items()}
        for batch in batches:
            for x, drawn, y in unpacked(batch, features, trees, kind):
                for t, (feature, at_bin, left, slots, k) in group.items():
                    rows = np.flatnonzero(drawn[t])
                    own = np.take(x, rows, axis=1)
                    slot = slots[walk(own, level, feature, at_bin, left)]
                    if slot.size and slot.min() < 0:
                        here = np.flatnonzero(slot >= 0)
                        rows, own, slot = rows[here], np.take(own, here, axis=1), slot[here]
                    n = drawn[t][rows].astype(np.float64)
                    s = n * y[rows]
                    whole, cells = sums[t]
                    figures = (n, s, s * y[rows])
                    for i, v in enumerate(figures):
                        whole[i] += np.bincount(slot, v, k)
                    slot = slot * bins
                    for f in range(features):
                        cell = slot + own[f]
                        for i in range(kinds):
                            cells[i, f] += np.bincount(cell, figures[i], k * bins)
        task = TaskContext.get().partitionId()
        for t, (whole, cells) in sums.items():
            k = whole.shape[1]
            cells = cells.reshape(kinds, features, k, bins)
            for first in range(0, k, NODES):
                own = cells[:, :, first : first + NODES].reshape(kinds, -1)
                some = np.flatnonzero(own[0])
                sent = (whole[:, first : first + NODES], some, own[:, some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.int32()) for v in (t, first, task)] + [pa.array([v.tobytes()], pa.binary()) for v in sent],
                    names=["tree", "first", "task", "whole", "some", "cells"],
                )

    def choose(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["task"])
        whole = sum(np.frombuffer(r["whole"]).reshape(3, -1) for r in parts)
        k = whole.shape[1]
        cells = np.zeros((kinds, features * k * bins))
        for r in parts:
            cells[:, np.frombuffer(r["some"], np.int64)] += np.frombuffer(r["cells"]).reshape(kinds, -1)
        cells = cells.reshape(kinds, features, k, bins).cumsum(axis=3).transpose(0, 2, 1, 3)  # kind, node, feature, bins up to this
        n, s = cells[:2]
        rows, total = whole[0][:, None, None], whole[1][:, None, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            falls = (s * s / n + (total - s) ** 2 / (rows - n) - total * total / rows) / rows
        falls = np.where((n >= least) & (rows - n >= least), falls, -1.0).reshape(k, -1)
        place, each = falls.argmax(axis=1), np.arange(k)
        below = cells.reshape(kinds, k, -1)[:, each, place]
        node = {"tree": [parts[0]["tree"]] * k, "slot": parts[0]["first"] + each, "figures": list(whole.T)}
        return pa.table({**node, "feature": place // bins, "bin": place % bins, "gain": falls[each, place], "below": list(below.T)})

    figures = packed.mapInArrow(count, "tree int, first int, task int, whole binary, some binary, cells binary")
    return figures.groupBy("tree", "first").applyInArrow(choose, "tree long, slot long, figures array<double>, feature long, bin long, gain double, below array<double>")


def groups(wanted: list[tuple[int, int]], most: int) -> Iterator[dict[int, list[int]]]:
    """tree -> nodes, at most ``most`` nodes at a time."""
    for i in range(0, len(wanted), most):
        out: dict[int, list[int]] = {}
        for t, node in wanted[i : i + most]:
            out.setdefault(t, []).append(node)
        yield out


def grow(rf: RandomForestRegressor, rows: DataFrame, features: int) -> tuple[list[Tree], list[np.ndarray], float]:
    """The trees, the limits of the bins and the label's mean, from rows of x0, x1, … and y."""
    trees, depth = rf.getNumTrees(), rf.getMaxDepth()
    cores = rows.sparkSession.sparkContext.defaultParallelism  # what a task sends grows with nodes or quantiles, not with its rows: a task a core
    limits, mean, n = bin_limits(rows.coalesce(cores), features, min(rf.getMaxBins(), 1 << 16))
    bins = max(map(len, limits)) + 1
    packed = pack(rows, limits, mean, trees, rf.getSubsamplingRate(), rf.getSeed()).persist(StorageLevel.DISK_ONLY)
    dealt = packed.coalesce(cores)
    forest = [Tree() for _ in range(trees)]
    wanted = [(t, 0) for t in range(trees)]
    most = max(1, (rf.getMaxMemoryInMB() << 20) // (24 * features * bins))
    try:
        for level in range(max(1, depth)):
            following = []
            for nodes in groups(wanted, most):
                group = {t: forest[t].table(own, bins) for t, own in nodes.items()}
                found = best_splits(dealt, group, level, features, bins, trees, max(1, rf.getMinInstancesPerNode()), level == depth - 1)
                for r in sorted(found.collect(), key=lambda r: (r.tree, r.slot)):
                    tree, node = forest[r.tree], nodes[r.tree][r.slot]
                    rows, _, squares = tree.figures[node] = tuple(r.figures)
                    if depth and rows and r.gain >= rf.getMinInfoGain() and r.gain > ROUNDING * squares / rows:
                        children = tree.split(node, r.feature, r.bin, r.gain)
                        if level == depth - 1:
                            tree.figures[-2:] = [tuple(r.below), tuple(a - b for a, b in zip(r.figures, r.below))]
                        following += [(r.tree, child) for child in children]
            wanted = following
    finally:
        packed.unpersist()
    return forest, limits, mean


def node_rows(forest: list[Tree], limits: list[np.ndarray], mean: float) -> Iterator[tuple]:
    """The forest's nodes as MLlib stores them: treeID, (id, prediction, impurity, stats, rows, gain, children, split)."""
    for t, tree in enumerate(forest):
        for i, (n, s, q) in enumerate(tree.figures):
            centre = s / n if n else 0.0
            impurity = max(0.0, q / n - centre * centre) if n else 0.0
            stats = [n, s + n * mean, q + 2 * mean * s + n * mean * mean]
            left = tree.left[i]
            split = (tree.feature[i], [float(limits[tree.feature[i]][tree.bin[i]])], -1) if left >= 0 else (-1, [], -1)
            yield t, (i, centre + mean, impurity, stats, int(n), tree.gain[i], left, left + 1 if left >= 0 else -1, split)


def fit(rf: RandomForestRegressor, df: DataFrame, columns: Sequence[Column]) -> RandomForestRegressionModel:
    """ml_rf_train's forest: ``rf``'s settings, fitted on ``columns`` (the vectors' numbers) and labels of ``df``.

    The model's folder is that of a forest of the same settings on one row; its nodes are replaced by those grown here.
    """
    spark = df.sparkSession
    other = [p for p in ("bootstrap", "weightCol", "minWeightFractionPerNode") if rf.isSet(p)]
    if other:
        raise ValueError(f"not known to this forest: {', '.join(other)}")
    rows = df.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(rf.getLabelCol()).cast("double").alias("y"))
    forest, limits, mean = grow(rf, rows, len(columns))
    path = shared_path(spark, "forest-grown")
    one = spark.createDataFrame([(Vectors.dense([0.0] * len(columns)), 0.0)], [rf.getFeaturesCol(), rf.getLabelCol()])
    rf.fit(one).write().overwrite().save(path)
    schema = "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, " \
        "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
    spark.createDataFrame(list(node_rows(forest, limits, mean)), schema).write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestRegressionModel.load(path)
