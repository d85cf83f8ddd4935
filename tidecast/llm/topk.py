"""Exact top-k inner-product search by MaxScore over blocks of queries and shards of vectors.

A vector's components are terms, its quantised values their weights. In a shard, each term has the least and
greatest weight, which bounds what it can add to a query's score. A query takes its terms by falling bound:
the essential ones are those whose loss the threshold (the k-th best score so far) can't bear; their postings
are traversed for all the shard's vectors. The others are probed, in steps, only for vectors whose partial
score and remaining bound still reach the threshold. Each shard returns its k best; these are merged.

Queries and vectors meet as (query block, shard) pairs, which is all that is ever in one task; the pairs grow
with queries times rows, as the search is over the stated query set against all rows.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows of
null id; a query's own rows are those of its id; vectors of other lengths meet in the components they share;
repeated query rows count once; ties go to the smaller id; fewer candidates than k give all of them. Components of 2^62
or more after scaling, and scores beyond 64 bits, fail with a message.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192
QUERY_ROWS = 1024
#: Vectors scored in full to start the threshold, and terms probed at a time.
SEED_ROWS = 256
STEP = 8


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """id, x: floor(scale * component) as longs, of the vectors that take part."""
    wide = F.transform(F.col(vector_column), lambda v: v.cast("double"))
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), wide.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    cell = lambda v: F.when(F.abs(v) < 2.0**62 / scale, F.floor(v * float(scale))).otherwise(F.raise_error(F.lit("a component is too large to be scored exactly")))
    return rows.where(F.coalesce(finite, F.lit(False))).select("id", F.transform("v", cell).alias("x"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of list values as a matrix, missing components 0."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


def max_score(q: np.ndarray, x: np.ndarray, order_of_ids: np.ndarray, least: np.ndarray, most: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best of ``x`` for query ``q`` (by score, then id), without the rows ``own``."""
    bound = np.maximum(q * least, q * most)
    spread = bound - np.minimum(q * least, q * most)
    terms = np.argsort(-spread, kind="stable")
    terms = terms[(q[terms] != 0)]
    rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # rest[j]: bound of terms j and on
    alive = np.ones(x.shape[0], bool)
    alive[own] = False
    seed = np.flatnonzero(alive)[:SEED_ROWS]
    first = x[seed] @ q
    threshold = np.sort(first)[-k] if seed.size >= k else None
    if threshold is None:
        essential = terms.size
    else:
        # a vector with nothing but its least in the terms up to j can still be competitive
        low = np.concatenate([[0], np.cumsum((bound - spread)[terms])])
        reach = low + rest >= threshold
        essential = int(np.flatnonzero(reach)[-1]) + 1 if reach.any() else 1
        essential = min(terms.size, max(1, min(essential, terms.size - STEP)))
    part = x[:, terms[:essential]] @ q[terms[:essential]]
    at = essential
    rows = np.flatnonzero(alive)
    part = part[rows]
    while True:
        if threshold is not None:
            competitive = part + rest[at] >= threshold
            rows, part = rows[competitive], part[competitive]
        if at >= terms.size:
            break
        probe = terms[at : at + STEP]
        part = part + x[np.ix_(rows, probe)] @ q[probe]
        at += probe.size
        if threshold is not None and rows.size >= k:  # what is sure already can raise the threshold
            sure = part + (low[-1] - low[at])
            threshold = max(threshold, np.partition(sure, -k)[-k])
    best = np.lexsort((order_of_ids[rows], -part))[:k]
    return rows[best], part[best]


def _search(k: int):
    out_schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return out_schema.empty_table()
        lengths = [int(np.max(np.diff(c.offsets.to_numpy()), initial=0)) for t in (queries, vectors) for c in t.column("x").chunks if len(c)]
        width = max(lengths, default=0)
        q, x = matrix(queries.column("x"), width), matrix(vectors.column("x"), width)
        qid, vid = queries.column("id").to_numpy(), vectors.column("id").to_numpy()
        # sums of products under 2^53 are exact in doubles, which multiply faster
        reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1)
        if reach < 2**53:
            q, x = q.astype(float), x.astype(float)
        elif reach >= 2**62:  # Python's integers don't wrap
            q, x = q.astype(object), x.astype(object)
        least, most = x.min(axis=0), x.max(axis=0)
        by_id = np.argsort(vid, kind="stable")
        rows = []
        for n in range(len(qid)):
            own = by_id[np.searchsorted(vid, qid[n], "left", by_id) : np.searchsorted(vid, qid[n], "right", by_id)]
            best, score = max_score(q[n], x, vid, least, most, own, k)
            if reach >= 2**62 and any(abs(v) >= 2**63 for v in score):
                raise OverflowError("a score doesn't fit in 64 bits")
            rows.append((np.full(best.size, qid[n]), vid[best], score.astype(np.int64)))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*rows)], schema=out_schema)

    return run


def top_k(vectors: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, <id_column>, score: the k best of all rows for each row whose id satisfies ``is_query``."""
    rows = quantised(vectors, id_column, vector_column)
    queries = rows.where(is_query).distinct()
    n, m = rows.count(), queries.count()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(m / query_rows))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = queries.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), each(shards).alias("shard"))
    right = rows.select("id", "x", each(blocks).alias("block"), F.pmod(F.xxhash64("id", "x"), F.lit(shards)).alias("shard"))
    found = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(_search(k), "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")
