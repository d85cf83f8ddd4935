"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


#: Edges that a task holds at once.
FOREST_EDGES = 1 << 20


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to the least node of each component of these edges: (node, least), without the least nodes themselves."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: u.size], ends[u.size :]
    root = np.arange(nodes.size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    child = np.flatnonzero(root != np.arange(nodes.size))
    return nodes[child], nodes[root[child]]


def _task_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as a forest of stars, a bounded number of edges at a time."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in batches:
        held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        if held[0].size >= FOREST_EDGES:
            held = list(forest(*held))
            if held[0].size >= FOREST_EDGES // 2:  # a forest this wide leaves the task as it is
                yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["u", "v"])
                held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    if held[0].size:
        yield pa.RecordBatch.from_arrays([pa.array(h) for h in forest(*held)], ["u", "v"])


def star_labels(edges: DataFrame) -> DataFrame:
    """(u, v): every node that is not its component's least, with that least node. ``edges``: longs u > v.

    Edges become stars within each task first. Each round is two grouped minima and two joins on the edges alone, written to the shared checkpoint
    folder; the rounds grow with the logarithm of the longest chain.
    """
    edges = cut_lineage(edges.mapInArrow(_task_forests, "u long, v long").distinct())
    state = _state(edges)
    while state[0]:
        edges = cut_lineage(_small_star(_large_star(edges)))
        last, state = state, _state(edges)
        if state == last:
            break
    return edges
