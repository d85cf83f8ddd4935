"""Token-id output: documents packed into rows of equal length, best fit first.

Each task packs the documents of its partition in blocks of about ``block_tokens`` ids, so nothing is
shuffled and memory depends on the block or the longest document. A document (ids and one end id) longer than
a row is cut into full rows and a rest, losing nothing; rests and short documents are placed by falling
length, each into the row with the least room that still takes it. That row is found in a segment tree over
the room values 0 to the row length, whose leaves count the rows with just that room.

A packed row carries its ids (padded to the row length, little-endian), the cumulative lengths of its
segments, the positions where position ids start again at 0, and where each segment comes from (doc_id and
offset), so that the documents can be put together again.

Defined results: null or empty text is one end id; repeated rows are all packed; null ids stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .textkit import text_bytes, text_slices

ROW_TOKENS = 2048
BLOCK_TOKENS = 4 << 20
#: Ids of a byte vocabulary: the bytes themselves, then the end of a document and the padding.
END_ID, PAD_ID = 256, 257


class RoomTree:
    """Counts of rows by room; finds the least room that is at least as large as asked."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def least(self, room: int) -> int:
        """The least room >= the one asked for that some row has, or -1."""
        at, count = room + self.leaves, self.count
        if count[at]:
            return room
        while at > 1 and (at & 1 or not count[at + 1]):
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(lengths: list[int], row_tokens: int) -> list[list[int]]:
    """Items (numbers) of each row, placed by falling length into the row of least sufficient room."""
    tree, by_room, rows = RoomTree(row_tokens), {}, []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[item]
        room = tree.least(need)
        if room < 0:
            row, room = len(rows), row_tokens
            rows.append([])
        else:
            row = by_room[room].pop()
            tree.add(room, -1)
        rows[row].append(item)
        if room > need:
            by_room.setdefault(room - need, []).append(row)
            tree.add(room - need, 1)
    return rows


SCHEMA = pa.schema([
    ("block", pa.int64()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())),
    ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())), ("ids", pa.binary()),
])
SQL = "block long, row int, n_tokens int, doc_ids array<long>, doc_offsets array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary"


def pack_block(block: int, doc_ids: list, ids: list[np.ndarray], row_tokens: int, pad_id: int, kind: str) -> Iterator[pa.RecordBatch]:
    """Packed rows of one block's documents."""
    segments: list[tuple[int, int, int]] = []  # document, offset, length
    for d, x in enumerate(ids):
        segments += [(d, at, min(row_tokens, x.size - at)) for at in range(0, x.size, row_tokens)]
    whole = [[i] for i, s in enumerate(segments) if s[2] == row_tokens]
    rests = [i for i, s in enumerate(segments) if s[2] < row_tokens]
    rows = whole + [[rests[i] for i in row] for row in best_fit([segments[i][2] for i in rests], row_tokens)]
    for start in range(0, len(rows), 512):
        out: dict[str, list] = {name: [] for name in SCHEMA.names}
        for number, row in enumerate(rows[start : start + 512], start):
            parts = [segments[i] for i in row]
            edges = np.concatenate([[0], np.cumsum([n for _, _, n in parts])])
            line = np.full(row_tokens, pad_id, kind)
            for (d, at, n), a in zip(parts, edges.tolist()):
                line[a : a + n] = ids[d][at : at + n]
            for name, value in zip(SCHEMA.names, (block, number, int(edges[-1]), [doc_ids[d] for d, _, _ in parts], [at for _, at, _ in parts], edges.tolist(), edges[:-1].tolist(), line.tobytes())):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, schema=SCHEMA)


def pack_bytes(docs: DataFrame, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pack ``text`` under the byte vocabulary (ids are 16-bit). One row per packed row."""

    def run(batches):
        task = TaskContext.get()
        block, held, doc_ids, ids = (task.partitionId() if task else 0) << 32, 0, [], []
        for batch in batches:
            for part in text_slices(batch, "text"):
                buf, offsets = text_bytes(part.column("text"))
                for d, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    doc_ids.append(d)
                    ids.append(np.append(buf[a:b].astype("<u2"), np.uint16(END_ID)))
                    held += b - a + 1
                if held >= block_tokens:
                    yield from pack_block(block, doc_ids, ids, row_tokens, PAD_ID, "<u2")
                    block, held, doc_ids, ids = block + 1, 0, [], []
        if ids:
            yield from pack_block(block, doc_ids, ids, row_tokens, PAD_ID, "<u2")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SQL)


def pack_ids(encoded: DataFrame, end_id: int, pad_id: int, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pack ``ids`` (little-endian unsigned 32-bit, as the encoder writes them); rows keep that width."""

    def run(batches):
        task = TaskContext.get()
        block, held, doc_ids, ids = (task.partitionId() if task else 0) << 32, 0, [], []
        for batch in batches:
            for d, x in zip(batch.column("doc_id"), batch.column("ids")):
                doc_ids.append(d.as_py())
                ids.append(np.append(np.frombuffer(x.as_buffer() or b"", "<u4") if x.is_valid else np.zeros(0, "<u4"), np.uint32(end_id)))
                held += ids[-1].size
                if held >= block_tokens:
                    yield from pack_block(block, doc_ids, ids, row_tokens, pad_id, "<u4")
                    block, held, doc_ids, ids = block + 1, 0, [], []
        if ids:
            yield from pack_block(block, doc_ids, ids, row_tokens, pad_id, "<u4")

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, SQL)


def token_ids(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids of ``text`` (null: none) by a byte-level vocabulary file, as ``pack_ids`` takes them.

    Ids come from the tiktoken library in each task: this is about rows of ids, not about merging.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))

    def run(batches):
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids = [np.asarray(encoding.encode_ordinary(t or ""), "<u4").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def position_ids(cu_seqlens: list[int], row_tokens: int) -> np.ndarray:
    """Position ids of one packed row: from 0 in every segment, and in the padding."""
    edges = np.array([*cu_seqlens[:-1], cu_seqlens[-1]])
    out = np.arange(row_tokens)
    return out - edges[np.searchsorted(edges, out, "right") - 1]
