"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees of shards.

Distinct fingerprints are dealt to shards so that no link is lost: with the 64 bits cut into ``parts``
parts, two fingerprints that differ in ``radius`` bits at most agree on some choice of ``parts - radius``
parts, and each choice with its bits is a shard. In a shard a BK-tree hangs each fingerprint under its
parent by their Hamming distance, and a search follows only edges within the radius of its own distance.
More parts give smaller shards and more copies; ``parts`` follows the number of distinct fingerprints.
Trees travel with their shard through the shuffle: their total size grows with the corpus, so they are not
broadcast. A shard of more than ``SHARD_ROWS`` is dealt to pairs of salted blocks. Out of a shard come only
the links that join two of its parts, never all pairs; components are formed from those.

Defined results: null text counts as empty; a text of fewer words than a shingle has one shingle, no words
give fingerprint zero, which links like any other. One output row per input row; a null doc_id stays null
and never becomes a component's name unless all of the component's are null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import star_labels
from .textkit import SMALL_SLICE_BYTES, folded_words, numbered, releasing, sorted_groups, text_bytes, text_slices

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Shards of more distinct fingerprints are dealt to pairs of salted blocks of about this size.
SHARD_ROWS = 4096
#: Distinct fingerprints per shard that the number of parts aims at, if fingerprints were evenly spread.
SHARD_MEAN = 256
_STEP = 1 << 15


def fingerprints_of(arr, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprints (unsigned) of an Arrow string array's texts."""
    joined, starts, ends, first = folded_words(*text_bytes(arr))
    out = np.zeros(len(arr), np.uint64)
    view = memoryview(joined)
    for d in range(len(arr)):
        a, b = int(first[d]), int(first[d + 1])
        if a == b:
            continue
        n = max(1, b - a - words + 1)
        tally = np.zeros(64, np.int64)
        for k in range(a, a + n, _STEP):
            stop = min(k + _STEP, a + n)
            last = ends[min(k + words, b) - 1 : min(stop + words - 1, b)]
            h = b"".join([xxhash.xxh64_digest(view[s:e], SEED) for s, e in zip(starts[k:stop].tolist(), last.tolist())])
            tally += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[d] = np.packbits(tally * 2 > n).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, mark (hash of the text), fp (the fingerprint's 64 bits as a signed long)."""

    def run(batches):
        for batch in releasing(batches):
            for part in text_slices(batch, "text", SMALL_SLICE_BYTES):
                fp = fingerprints_of(part.column("text"), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(fp)], ["doc_id", "mark", "fp"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return picked.mapInArrow(run, "doc_id long, mark long, fp long")


class BKTree:
    """Node n's children: Hamming distance to n -> node."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at ``radius`` or less."""
        found, todo, values, children = [], [0] if self.values else [], self.values, self.children
        while todo:
            n = todo.pop()
            d = (values[n] ^ value).bit_count()
            if d <= radius:
                found.append(n)
            if edges := children[n]:
                todo += [c for e, c in edges.items() if d - radius <= e <= d + radius]
        return found

    def add(self, value: int) -> int:
        at, new = 0, len(self.values)
        if new:
            while True:
                d = (self.values[at] ^ value).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = new
                    break
                at = nxt
        self.values.append(value)
        self.children.append({})
        return new


class _Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def shard_links(fps: list[int], right: list[bool], pair: bool, radius: int) -> list[tuple[int, int]]:
    """Links that join two parts of the shard: numbers of fingerprints. ``pair``: only between left and right block."""
    tree, sets, at, out = BKTree(), _Sets(len(fps)), [], []
    for n, fp in enumerate(fps):
        if not (pair and right[n]):
            if not pair:
                out += [(n, at[m]) for m in tree.within(fp, radius) if sets.join(n, at[m])]
            tree.add(fp)
            at.append(n)
    if pair:
        for n, fp in enumerate(fps):
            if right[n]:
                out += [(n, at[m]) for m in tree.within(fp, radius) if sets.join(n, at[m])]
    return out


def _masks(parts: int, radius: int) -> list[int]:
    """Bits that two fingerprints within the radius share in one case at least, as signed longs."""
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    out = []
    for same in itertools.combinations(range(parts), parts - radius):
        mask = sum(((1 << edges[p + 1]) - 1) ^ ((1 << edges[p]) - 1) for p in same)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def parts_for(n: int, radius: int) -> int:
    """The fewest parts whose shards would hold SHARD_MEAN of n evenly spread fingerprints on average."""
    parts = radius + 1
    while parts < 2 * radius + 4 and n / 2 ** (64 * (parts - radius) / parts) > SHARD_MEAN:
        parts += 1
    return parts


def link_edges(distinct: DataFrame, n: int, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints (column ``fp``) that leave no component apart."""
    # a shard is known by a hash of its table and bits: should two meet, they are searched as one
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(_masks(parts_for(n, radius), radius))])
    dealt = distinct.select("fp", F.explode(tables).alias("shard"))
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    members = dealt.join(sizes, "shard").withColumn("salts", F.ceil(F.col("n") / shard_rows).cast("int")).withColumn("own", own)
    blocks = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(
        "shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("right"), "fp"
    )
    keys = ["shard", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(releasing(batches), keys):
            fps = group.column("fp").to_numpy()
            pair = group.column("low")[0].as_py() != group.column("high")[0].as_py()
            found = shard_links(fps.view(np.uint64).tolist(), group.column("right").to_pylist(), pair, radius)
            if found:
                a = fps[np.array(found)]
                yield pa.RecordBatch.from_arrays([pa.array(a.max(axis=1)), pa.array(a.min(axis=1))], ["u", "v"])

    return blocks.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInArrow(run, "u long, v long")


def cluster(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, mark, fp, label (the component's least fingerprint), component_id (its least doc_id)."""
    rows = cut_lineage(fingerprints(docs, words))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = star_labels(link_edges(distinct.select("fp"), distinct.count(), radius, shard_rows))
    named = distinct.join(links.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("label"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "label").join(ids, "label"), "fp").select("doc_id", "mark", "fp", "label", "component_id")


def with_fingerprint_text(clustered: DataFrame) -> DataFrame:
    return clustered.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows and columns of ``docs``, one row of each component: that of the least doc_id (then least mark)."""
    kept = cluster(docs, words, radius).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark")).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("of_id"), F.col("k.mark").alias("of_mark")).distinct()
    rows, names = numbered(docs)
    marked = rows.withColumn("mark", F.xxhash64(names["text"]))
    same = marked[names["doc_id"]].cast("long").eqNullSafe(kept["of_id"]) & (marked["mark"] == kept["of_mark"])
    return marked.join(kept, same, "left_semi").dropDuplicates([names["doc_id"], "mark"]).drop("mark").toDF(*names)
