"""Byte-level BPE encoding and decoding over overlapping chunks.

A text longer than ``chunk_chars`` is cut into chunks that overlap by ``overlap_chars``; every chunk is
pre-tokenised by itself, in whatever task holds it. Two neighbouring chunks resynchronise at the first
boundary of the overlap that both found: the left chunk's boundaries are right up to two characters
before its end, and the splitting pattern never looks back, so from a shared boundary on the right
chunk's pre-tokens are the whole text's. Each chunk is then encoded between its two stitches, and the
pieces' ids are put together per document. Texts of one chunk need neither stitch nor shuffle. If two
chunks of a text share no boundary (say a run of letters longer than the overlap), that text is put
together again and split in one go, so results never depend on the chunking.

Defined results: null or empty text -> no ids; every input row gives one output row, repeated rows too;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import text_slices

# Fixed value: the splitting pattern of the rank files, which ``pretoken_ends`` follows by character classes.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The code points of White_Space, and the suffixes that the pattern splits off after an apostrophe.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Distinct pre-tokens whose ids a Python worker remembers.
MEMO = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 token, blank, rank per line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    kinds = np.array(first, dtype="U1")
    out = np.full(0x110000, OTHER, np.uint8)
    out[kinds == "L"] = LETTER
    out[kinds == "N"] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def pretoken_ends(text: str, classes: np.ndarray) -> np.ndarray:
    """End offsets (code points) of the matches of SPLIT_PATTERN, which cover the whole text.

    A pre-token is a run of one class, with these turns: a white-space run gives up its last character
    before something else, and if that is a blank it opens the next pre-token; a lone apostrophe that no
    blank precedes takes a following suffix with it.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = classes[code]
    cut = np.zeros(n + 1, bool)  # cut[i]: a pre-token ends before character i
    cut[1:n] = kind[1:] != kind[:-1]
    cut[n] = True
    begins = np.flatnonzero(cut[1:n]) + 1  # where a run of another class begins
    after = begins[kind[begins - 1] == SPACE]
    cut[after - 1] = True  # the run gives up its last character,
    cut[after[code[after - 1] == 32]] = False  # which goes with what follows if it is a blank
    marks = np.flatnonzero(code == 39)
    if marks.size:
        for i in marks.tolist():
            if i and (not cut[i] or code[i - 1] == 32):
                continue  # inside a run, or opened by a blank
            for suffix in SUFFIXES:
                if text.startswith(suffix, i + 1):
                    cut[i + 1] = False
                    cut[i + 1 + len(suffix)] = True
                    break
    return np.flatnonzero(cut[1:]) + 1


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank merges first, the leftmost on ties."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 48:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    # long pre-tokens: linked parts and a heap of pairs, n log n
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        offer(i)
    alive = bytearray(b"\x01") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
            continue  # one of the two parts has changed since
        j = nxt[i]
        alive[j] = 0
        end[i], nxt[i] = end[j], nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class _Memo(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers; forgets all when it is full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, token: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        got = self[token] = np.array(merge_ranks(token.encode(), self.ranks), "<u4").tobytes()
        return got


class Codec:
    """What a task needs: ranks, the table back, character classes. Built once per Python worker."""

    _held: dict[int, Codec] = {}

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray):
        self.memo, self.classes = _Memo(ranks), classes
        size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token

    @classmethod
    def of(cls, shared) -> Codec:
        key = shared.id if hasattr(shared, "id") else id(shared)
        if key not in cls._held:
            cls._held.clear()
            packed, classes = shared.value
            cls._held[key] = cls(packed, np.frombuffer(classes, np.uint8))
        return cls._held[key]

    def ends(self, text: str) -> np.ndarray:
        return pretoken_ends(text, self.classes)

    def encode(self, text: str, ends: np.ndarray | None = None, first: int = 0) -> bytes:
        """Ids of ``text[first:ends[-1]]`` cut at ``ends``."""
        stops = (self.ends(text) if ends is None else ends).tolist()
        starts = [first, *stops[:-1]] if stops else []
        return b"".join(map(self.memo.__getitem__, [text[a:b] for a, b in zip(starts, stops)]))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Vocabulary:
    """Ranks as a broadcast variable: a fixed file of some 50,000 tokens, about a megabyte whatever the corpus."""

    def __init__(self, spark: SparkSession, path: str):
        self.shared = spark.sparkContext.broadcast((read_ranks(path), _classes().tobytes()))


IDS = "doc_id long, n_tokens long, ids binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _emit(kind: str, codec: Codec, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    n = pa.array([len(x) // 4 for x in ids], pa.int64())
    doc = pa.array(doc_ids, pa.int64())
    if kind == "ids":
        return pa.RecordBatch.from_arrays([doc, n, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
    sha = [hashlib.sha256(x).hexdigest() for x in ids]
    back = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
    return pa.RecordBatch.from_arrays([doc, n, pa.array(sha, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _flat(shared, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts of one chunk."""

    def run(batches):
        codec = Codec.of(shared)
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield _emit(kind, codec, part.column("doc_id").to_pylist(), [codec.encode(t or "") for t in part.column("text").to_pylist()])

    return run


def _chunker(chunk: int, overlap: int):
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                for doc, mark, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "mark", "text"))):
                    step, rows = chunk - overlap, {"doc_id": [], "mark": [], "chunk": [], "text": [], "last": []}
                    for k, at in enumerate(range(0, max(1, len(text) - overlap), step)):
                        for name, value in zip(rows, (doc, mark, k, text[at : at + chunk], at + chunk >= len(text))):
                            rows[name].append(value)
                    yield pa.RecordBatch.from_pydict(rows, schema=_CHUNKS)

    return run


_CHUNKS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("chunk", pa.int32()), ("text", pa.string()), ("last", pa.bool_())])


def _boundaries(shared, chunk: int, overlap: int):
    """Per chunk: the boundaries that can serve as a stitch, in the head's and in the tail's overlap.

    Positions count from the chunk's own start for the head, from the next chunk's start for the tail.
    A stitch follows something that is not white space, so that a piece looks the same by itself.
    """

    def run(batches):
        codec = Codec.of(shared)
        for batch in batches:
            for part in text_slices(batch, "text"):
                heads, tails = [], []
                for text, last in zip(part.column("text").to_pylist(), part.column("last").to_pylist()):
                    ends = codec.ends(text)
                    ends = ends[ends < len(text)]
                    ends = ends[codec.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)[ends - 1]] != SPACE]
                    heads.append(ends[ends <= overlap].tolist())
                    step = chunk - overlap
                    tails.append([] if last else (ends[(ends >= step) & (ends <= len(text) - 2)] - step).tolist())
                kept = [part.column(c) for c in ("doc_id", "mark", "chunk", "last")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["doc_id", "mark", "chunk", "last", "heads", "tails"])

    return run


def _pieces(shared):
    def run(batches):
        codec = Codec.of(shared)
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids = [codec.encode(t[a : len(t) if b is None else b]) for t, a, b in zip(texts, part.column("from").to_pylist(), part.column("to").to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "mark", "chunk")), pa.array(ids, pa.binary())], ["doc_id", "mark", "chunk", "ids"])

    return run


def _joined(shared, kind: str):
    """One row per long text: the ids of its pieces, or its whole text where chunks found no stitch."""

    def run(batches):
        codec = Codec.of(shared)
        for batch in batches:
            for i in range(batch.num_rows):
                doc, pieces, texts, copies = (batch.column(c)[i].as_py() for c in ("doc_id", "pieces", "texts", "copies"))
                ids = codec.encode("".join(x["text"] for x in sorted(texts, key=lambda x: x["chunk"]))) if texts else b"".join(x["ids"] for x in sorted(pieces, key=lambda x: x["chunk"]))
                yield _emit(kind, codec, [doc] * copies, [ids] * copies)

    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, kind: str = "ids", chunk_chars: int = 32768, overlap_chars: int = 1024) -> DataFrame:
    """Encode ``text`` of every row. ``kind``: "ids" (ids as little-endian unsigned 32-bit integers in a binary
    column, see ``decode``) or "digest" (SHA-256 of the ids and of the bytes decoded from them)."""
    if not 0 < overlap_chars < chunk_chars // 2:
        raise ValueError("the overlap must be shorter than half a chunk")
    schema, shared = {"ids": IDS, "digest": DIGEST}[kind], vocabulary.shared
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long_text = F.length("text") > chunk_chars
    flat = rows.where(~long_text).mapInArrow(_flat(shared, kind), schema)

    # a long text's rows are known by id and content; repeated rows are encoded once and counted
    keyed = rows.where(long_text).withColumn("mark", F.xxhash64("text"))
    copies = keyed.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    deal = ("doc_id", "mark", "chunk")
    chunks = keyed.mapInArrow(_chunker(chunk_chars, overlap_chars), "doc_id long, mark long, chunk int, text string, last boolean").repartition(*deal).dropDuplicates(deal)
    seen = chunks.mapInArrow(_boundaries(shared, chunk_chars, overlap_chars), "doc_id long, mark long, chunk int, last boolean, heads array<int>, tails array<int>")
    whole = Window.partitionBy("doc_id", "mark")
    chain = whole.orderBy("chunk")
    step = chunk_chars - overlap_chars
    cuts = (
        seen.withColumn("stitch", F.array_min(F.array_intersect("tails", F.lead("heads").over(chain))))  # seen from the next chunk
        .withColumn("whole", F.max(F.col("stitch").isNull() & ~F.col("last")).over(whole))
        .select(*deal, "whole", F.coalesce(F.lag("stitch").over(chain), F.lit(0)).alias("from"), F.when(~F.col("last"), F.col("stitch") + step).alias("to"))
    )
    cut = chunks.join(cuts.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("chunk").alias("c"), "whole", "from", "to"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")) & (F.col("chunk") == F.col("c")))
    pieces = cut.where(~F.col("whole")).mapInArrow(_pieces(shared), "doc_id long, mark long, chunk int, ids binary")
    unstitched = cut.where("whole").select(*deal, F.when(F.col("last"), F.col("text")).otherwise(F.substring("text", 1, step)).alias("text"))
    parts = pieces.select(*deal, "ids", F.lit(None).cast("string").alias("text")).unionByName(unstitched.withColumn("ids", F.lit(None).cast("binary")))
    gathered = parts.groupBy("doc_id", "mark").agg(
        F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("chunk", "ids"))).alias("pieces"),
        F.collect_list(F.when(F.col("text").isNotNull(), F.struct("chunk", "text"))).alias("texts"),
    )
    number = copies.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "copies")
    long_rows = gathered.join(number, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m"))).select("doc_id", "pieces", "texts", "copies").mapInArrow(_joined(shared, kind), schema)
    return flat.unionByName(long_rows)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, decoded (bytes): the tokens' bytes one after the other; null ids stay null."""
    shared = vocabulary.shared

    def run(batches):
        codec = Codec.of(shared)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([None if x is None else codec.decode(x) for x in part.column("ids").to_pylist()], pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
