"""Hard negatives for contrastive training, by exact inner products of Kronecker-packed candidates.

The candidates of a block lie side by side in one wide integer for each component: every candidate has a field of its
own, and its component, less the block's least so that it isn't negative, stands in it. An anchor multiplies each of
these integers once, by its component less the anchors' least, and the sum of the products holds all candidates' sums of
products, one in each field. Fields are as wide as the greatest sum that their bounds allow, so that none reaches into
the next, and what the two shifts have added is taken off again: scores are exact.

An anchor's positives are looked for among the rows of its label only, dealt to blocks of anchors and shards of a label;
its negatives among all rows, in blocks of anchors and shards of rows. Of each shard come the few best rows, which are
merged. Pairs of (block, shard) are all that is ever in one task. The search of a stated set of anchors against all rows
grows with their product.

Defined results: rows of null id, null label, or a vector that is null or holds null or non-finite components take no
part; missing components of a shorter vector count as 0; equal anchor rows count once; rows of an anchor's own id are
never its positives; candidates that stand twice count twice; ties go to the smaller id; an anchor without positives, or a
positive without negatives in its range, gives no row. Components of 2^62 or more after scaling, and scores beyond 64
bits, fail with a message.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies between these percentages of the positive's.
LEAST_PERCENT, MOST_PERCENT = 50, 95
#: Components in a shard of candidates, and in a block of anchors.
SHARD_CELLS = 1 << 19
ANCHOR_CELLS = 1 << 16
#: Candidates in one wide integer.
PACK_ROWS = 2048


def quantised(vectors: DataFrame, id_column: str, label_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """id, label, x: floor(scale * component) as longs, of the rows that take part."""
    wide = F.transform(F.col(f"`{vector_column}`"), lambda v: v.cast("double"))
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").alias("label"), wide.alias("v"))
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    cell = lambda v: F.when(F.abs(v) < 2.0**62 / scale, F.floor(v * float(scale))).otherwise(F.raise_error(F.lit("a component is too large to be scored exactly")))
    return rows.select("id", "label", F.transform("v", cell).alias("x"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of list values as a matrix of longs, missing components 0."""
    out, at = np.zeros((len(column), width), np.int64), 0
    for chunk in column.chunks:
        sizes = np.diff(chunk.offsets.to_numpy())
        rows = np.repeat(np.arange(at, at + sizes.size), sizes)
        out[rows, np.arange(rows.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = chunk.flatten().to_numpy()
        at += sizes.size
    return out


class Packed:
    """Candidates packed for anchors whose components lie between ``low`` and ``high``."""

    def __init__(self, x: np.ndarray, low: int, high: int):
        self.rows, self.width = x.shape
        self.low = low
        self.least = int(x.min(initial=0))
        reach = int(x.max(initial=0)) - self.least
        most = max(1, self.width * (high - low) * reach)
        self.bytes = next((b for b in (4, 8) if most < 1 << 8 * b), -(-most.bit_length() // 8))
        #: Sums of int64 do where every term of a score's correction fits.
        self.narrow = self.bytes <= 8 and self.width * max(abs(low), abs(high), 1) * max(abs(self.least), abs(int(x.max(initial=0))), 1) < 1 << 59
        cells = (x.astype(np.uint64) - np.uint64(self.least % (1 << 64))) if self.width else np.zeros((self.rows, 0), np.uint64)
        self.components = []
        for k in range(0, self.rows, PACK_ROWS):
            part = cells[k : k + PACK_ROWS].T
            self.components.append([int.from_bytes(self._fields(c), "little") for c in part])
        wide = x if self.narrow else x.astype(object)
        self.sums = wide.sum(axis=1) if self.width else np.zeros(self.rows, np.int64)

    def _fields(self, cells: np.ndarray) -> bytes:
        if self.bytes in (4, 8):
            return cells.astype(f"<u{self.bytes}").tobytes()
        out = np.zeros((cells.size, self.bytes), np.uint8)
        out[:, :8] = cells.astype("<u8").view(np.uint8).reshape(-1, 8)
        return out.tobytes()

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The anchor's inner product with every candidate: longs, or Python integers where those might not do."""
        factors = [a - self.low for a in anchor]
        out = []
        for k, components in enumerate(self.components):
            total = 0
            for factor, packed in zip(factors, components):
                if factor:
                    total += factor * packed
            n = min(PACK_ROWS, self.rows - k * PACK_ROWS)
            raw = total.to_bytes(n * self.bytes, "little")
            if self.bytes in (4, 8):
                out.append(np.frombuffer(raw, f"<u{self.bytes}"))
            else:
                out.append(np.array([int.from_bytes(raw[i : i + self.bytes], "little") for i in range(0, len(raw), self.bytes)], object))
        fields = np.concatenate(out) if out else np.zeros(0, np.uint32)
        fields = fields.astype(np.int64 if self.narrow else object)
        return fields + self.low * self.sums + (self.least * sum(anchor) - self.width * self.low * self.least)


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k of ``rows`` with the highest scores, ties to the smaller id."""
    if rows.size > 4 * k:
        least = np.partition(scores[rows], rows.size - k)[rows.size - k]
        rows = rows[scores[rows] >= least]
    return rows[np.lexsort((ids[rows], -scores[rows]))[:k]]


def _long(values) -> pa.Array:
    try:
        return pa.array(values.tolist(), pa.int64())
    except (OverflowError, pa.ArrowInvalid) as e:
        raise OverflowError("a score doesn't fit in 64 bits") from e


def _both(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, Packed] | None:
    lengths = [int(np.max(np.diff(c.offsets.to_numpy()), initial=0)) for t in (anchors, rows) for c in t.column("x").chunks if len(c)]
    width = max(lengths, default=0)
    a = matrix(anchors.column("x"), width)
    return a, Packed(matrix(rows.column("x"), width), int(a.min(initial=0)), int(a.max(initial=0)))


_FOUND = "anchor long, mark long, id long, score long"
_MINED = "anchor long, mark long, place int, positive long, positive_score long, id long, score long"


def _nearest(k: int):
    """The k best rows of other ids for each anchor."""
    schema = pa.schema([(n, pa.int64()) for n in ("anchor", "mark", "id", "score")])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        a, packed = _both(anchors, rows)
        ids, out = rows.column("id").to_numpy(), []
        for own, mark, x in zip(anchors.column("id").to_pylist(), anchors.column("mark").to_pylist(), a.tolist()):
            scores = packed.scores(x)
            at = best(scores, ids, np.flatnonzero(ids != own), k)
            out.append(pa.table([pa.array([own] * at.size, pa.int64()), pa.array([mark] * at.size, pa.int64()), pa.array(ids[at]), _long(scores[at])], schema=schema))
        return pa.concat_tables(out)

    return run


def _between(k: int, low: int, high: int):
    """For each anchor and positive the k best rows of another label within the range of its score."""
    kinds = {"place": pa.int32()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in ("anchor", "mark", "place", "positive", "positive_score", "id", "score")])

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        a, packed = _both(anchors, rows)
        ids, out = rows.column("id").to_numpy(), []
        labels = rows.column("label").combine_chunks().dictionary_encode()
        if isinstance(labels, pa.ChunkedArray):
            labels = labels.chunk(0)
        code = {v: n for n, v in enumerate(labels.dictionary.to_pylist())}
        label = labels.indices.to_numpy()
        cols = (anchors.column(c).to_pylist() for c in ("id", "mark", "label", "positives"))
        for own, mark, kind, positives, x in zip(*cols, a.tolist()):
            scores = packed.scores(x)
            other = np.flatnonzero(label != code.get(kind, -1))
            for p in positives:
                score = p["score"]
                floor, top = -(-low * score // 100), high * score // 100
                if floor > top:
                    continue
                at = best(scores, ids, other[(scores[other] >= floor) & (scores[other] <= top)], k)
                if at.size:
                    same = lambda v, t=pa.int64(): pa.array([v] * at.size, t)  # noqa: B023, E731
                    out.append(pa.table([same(own), same(mark), same(p["place"], pa.int32()), same(p["id"]), same(score), pa.array(ids[at]), _long(scores[at])], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _anew(*names: str) -> list[Column]:
    """Columns under names of their own, as both sides of a pairing come from the same rows."""
    return [F.col(c).alias(c) for c in names]


def _each(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    most_percent: int = MOST_PERCENT,
    shard_cells: int = SHARD_CELLS,
    anchor_cells: int = ANCHOR_CELLS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor``: a condition on ``id`` and ``label``. Rank counts the negatives of one anchor and positive.
    """
    rows = quantised(vectors, id_column, label_column, vector_column).withColumn("mark", F.xxhash64("label", "x"))
    anchors = rows.where(is_anchor).distinct()
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    width = max(1, width or 1)
    shard_rows, anchor_rows = max(64, shard_cells // width), max(16, anchor_cells // width)

    # positives: blocks of a label's anchors with shards of its rows
    parts = rows.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    blocks = anchors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / anchor_rows).alias("blocks"))
    plan = parts.join(blocks, "label")
    asked = anchors.join(plan, "label").select("id", "mark", "x", F.xxhash64("label").alias("kind"), F.pmod(F.xxhash64("id", "mark"), "blocks").alias("block"), _each(F.col("shards")).alias("shard"))
    held = rows.join(plan, "label").withColumn("shard", F.pmod(F.xxhash64("id", "mark"), "shards")).select(*_anew("id", "x"), F.xxhash64("label").alias("kind"), _each(F.col("blocks")).alias("block"), "shard")
    keys = ["kind", "block", "shard"]
    near = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_nearest(positives), _FOUND)
    order = Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), "id")
    first = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    first = first.groupBy("anchor", F.col("mark").alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("positives"))
    sought = cut_lineage(anchors.join(first, (F.col("id") == F.col("anchor")) & (F.col("mark") == F.col("of"))).select("id", "mark", "label", "x", "positives"))

    # negatives: blocks of anchors with shards of all rows
    shards, wide = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(sought.count() / anchor_rows))
    left = sought.select("*", F.pmod(F.xxhash64("id", "mark"), F.lit(wide)).alias("block"), _each(F.lit(shards)).alias("shard"))
    right = rows.select(*_anew("id", "label", "x"), _each(F.lit(wide)).alias("block"), F.pmod(F.xxhash64("id", "mark"), F.lit(shards)).alias("shard"))
    mined = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_between(negatives, least_percent, most_percent), _MINED)
    order = Window.partitionBy("anchor", "mark", "place").orderBy(F.desc("score"), "id")
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
