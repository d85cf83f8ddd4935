"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets a target number of words: shares by weight, stopping at ``cap`` times the source's size,
the excess going to the others by weight until none is above. A document is taken ``floor(target / size of
its source)`` times, and once more with the fraction that is left as its inclusion probability.

The flight phase moves these probabilities, three documents at a time, along the null-space of the two
balancing constraints (words taken and documents taken), in a random direction that keeps each expectation,
until one of the three reaches 0 or 1. A source's documents fly in hashed blocks of ``BLOCK`` and from the
largest down; each block leaves two undecided documents at most, and these fly again, in blocks, until one
block per source is left. The landing there drops the constraint on documents, decides the last one by its
probability, and then makes up for the words this missed by swapping taken for untaken documents of that
block, while a swap brings the total nearer. Everything random follows from hashes of the rows, so reruns agree.

Defined results: null text has size 0 and is never taken; a null source is a source, last in order;
repeated rows are units of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textkit import numbered, sorted_groups, text_bytes, text_slices, word_spans

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
#: Documents that fly together.
BLOCK = 4096
#: Swaps at most after a landing.
SWAPS = 8
_EPS = 1e-9


def sized(docs: DataFrame, mark: Column) -> DataFrame:
    """doc_id, source, mark, size (words of the text)."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                first = word_spans(*text_bytes(part.column("text")))[2]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "mark")), pa.array(np.diff(first).astype(np.int64))], ["doc_id", "source", "mark", "size"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", mark.alias("mark"), "text")
    return picked.mapInArrow(run, "doc_id long, source string, mark long, size long")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, documents, source_size, target: one row per source.

    With sources in order of cap / weight, those before some place stop at their cap and the rest share what
    is left by weight; the place is the first where the share is within the source's cap. Further places
    would take more from what is left than those sources' shares, so theirs is the largest such level.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * cap)
    full = F.col("most") / F.col("weight")
    every, order = Window.partitionBy(), Window.orderBy(full, F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) * share - before) / after
    shared = weighed.withColumn("level", F.when(level <= full, level)).withColumn("level", F.max("level").over(every))
    return shared.select("source", "documents", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target"))


def fly(size: np.ndarray, prob: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Probabilities after the flight (0 or 1 but for two units at most), or after the landing too."""
    s, p, draws = size.astype(float).tolist(), prob.astype(float).tolist(), rng.random(size.size + 8).tolist()
    waiting = [i for i in range(len(p) - 1, -1, -1) if _EPS < p[i] < 1 - _EPS]
    active: list[int] = []
    while True:
        while waiting and len(active) < 3:
            active.append(waiting.pop())
        if len(active) == 3:
            a, b, c = (s[i] for i in active)
            u = [b - c, c - a, a - b] if not a == b == c else [1.0, -1.0, 0.0]  # (1, 1, 1) x (a, b, c)
        elif len(active) == 2 and (s[active[0]] == s[active[1]] or land):
            a, b = (s[i] for i in active)
            u = [1.0, -1.0] if a == b else [b, -a]
        elif len(active) == 1 and land:
            u = [1.0]
        else:
            break
        up = min((1 - p[i]) / v if v > 0 else -p[i] / v for i, v in zip(active, u) if v)
        down = min(p[i] / v if v > 0 else (p[i] - 1) / v for i, v in zip(active, u) if v)
        step = up if draws.pop() * (up + down) < down else -down
        for i, v in zip(active, u):
            p[i] += step * v
        still = [i for i in active if _EPS < p[i] < 1 - _EPS]
        for i in set(active) - set(still):
            p[i] = float(round(p[i]))
        active = still
    out = np.array(p)
    near = np.abs(out - np.round(out)) <= _EPS
    out[near] = np.round(out[near])
    return _swapped(size.astype(float), out, prob) if land else out


def _swapped(size: np.ndarray, taken: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Swaps a taken for an untaken unit, of those that were open, while that lessens the words over or under."""
    free = (prob > _EPS) & (prob < 1 - _EPS)
    over = float((taken - prob) @ size)
    for _ in range(SWAPS):
        ins, outs = np.flatnonzero(free & (taken == 1)), np.flatnonzero(free & (taken == 0))
        if not ins.size or not outs.size:
            break
        outs = outs[np.argsort(size[outs], kind="stable")]
        place = np.searchsorted(size[outs], size[ins] - over)
        pairs = [(ins, outs[np.clip(place + d, 0, outs.size - 1)]) for d in (-1, 0)]
        left = [np.abs(over - size[a] + size[b]) for a, b in pairs]
        side = int(left[1].min() < left[0].min())
        n = int(left[side].argmin())
        if left[side][n] >= abs(over) - _EPS:
            break
        a, b = (int(x[n]) for x in pairs[side])
        taken[a], taken[b] = 0.0, 1.0
        over += size[b] - size[a]
    return taken


_COLUMNS = ("key", "block", "doc_id", "mark", "size", "source_size", "target", "base", "prob")
_SCHEMA = "key long, block long, doc_id long, mark long, size long, source_size long, target double, base int, prob double"


def _flight(rows: DataFrame, level: int) -> DataFrame:
    """One flight in each (key, block); ``lands`` tells whether the block is the source's only one."""

    def run(batches):
        for group in sorted_groups(batches, ["key", "block"]):
            size, prob = group.column("size").to_numpy(), group.column("prob").to_numpy()
            ids = group.column("doc_id").fill_null(-1).to_numpy()
            order = np.lexsort((ids, group.column("mark").to_numpy(), -size))
            key, block, lands = (group.column(c)[0].as_py() for c in ("key", "block", "lands"))
            rng = np.random.default_rng([key % 2**63, key < 0, block, level])
            done = np.empty(len(prob))
            done[order] = fly(size[order], prob[order], rng, lands)
            yield from group.select(_COLUMNS[:-1]).append_column("prob", pa.array(done)).combine_chunks().to_batches()

    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, _SCHEMA)


def sample(docs: DataFrame, mark: Column, block: int = BLOCK, **shares) -> DataFrame:
    """doc_id, mark, size, source_size, target, copies: how often the mix takes each row."""
    rows = cut_lineage(sized(docs, mark))
    per_source = cut_lineage(targets(rows, **shares))
    most = per_source.agg(F.max("documents")).first()[0] or 0
    joined = rows.join(per_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    ratio = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = joined.withColumn("ratio", ratio).select(
        F.xxhash64("source").alias("key"), F.ceil(F.col("documents") / block).alias("blocks"), "doc_id", "mark", "size", "source_size", "target",
        F.floor(F.col("ratio") + _EPS).cast("int").alias("base"), F.greatest(F.lit(0.0), F.col("ratio") - F.floor(F.col("ratio") + _EPS)).alias("prob"),
    )
    open_ = (F.col("prob") > 0) & (F.col("prob") < 1)
    decided = start.where(~open_).withColumn("block", F.lit(0)).select(*_COLUMNS)
    flying = start.where(open_).withColumn("block", F.pmod(F.xxhash64("mark", "doc_id"), F.col("blocks")))
    level, fan = 0, max(2, block // 2)
    widest = -(-most // block)
    while True:
        flown = cut_lineage(_flight(flying.withColumn("lands", F.col("blocks") <= 1), level))
        if widest <= 1:
            return decided.unionByName(flown).select("doc_id", "mark", "size", "source_size", "target", (F.col("base") + F.col("prob").cast("int")).alias("copies"))
        decided = decided.unionByName(flown.where(~open_))
        level, widest = level + 1, -(-widest // fan)
        # two units a block at most are left: blocks of the next flight take the leftovers of ``fan`` blocks
        flying = flown.where(open_).withColumn("block", F.floor(F.col("block") / fan))
        flying = flying.withColumn("blocks", F.lit(widest))


def _hashable(docs: DataFrame) -> list[Column]:
    """The columns in a form that has a hash: those that hold a map, as text."""
    maps = [f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()]
    return [F.to_json(F.struct(F.col(f"`{c}`").alias("v"))) if c in maps else F.col(f"`{c}`") for c in docs.columns]


def mix(docs: DataFrame, **shares) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``; a row taken twice stands twice."""
    taken = sample(docs, F.xxhash64(*_hashable(docs)), **shares).groupBy(F.col("doc_id").alias("of_id"), F.col("mark").alias("of_mark")).agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows, names = numbered(docs)
    once = rows.withColumn("mark", F.xxhash64(*_hashable(rows))).dropDuplicates([names["doc_id"], "mark"])
    same = once[names["doc_id"]].cast("long").eqNullSafe(taken["of_id"]) & (once["mark"] == taken["of_mark"])
    each = once.join(taken, same).select(*names.values(), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("n"))
    return each.drop("n").toDF(*names)
