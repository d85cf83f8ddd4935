"""Helpers shared by the operators: row slices of Arrow batches and vectorised word spans and hashes.

Word = maximal run of bytes other than space and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``; UTF-8
never uses those bytes inside a longer character, so byte spans and code-point spans agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step works on at once.
SLICE_BYTES = 4 << 20
#: The same for steps that hold some dozen arrays of their words at once.
SMALL_SLICE_BYTES = 1 << 20
_WINDOW = 1 << 20
_U = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MIX = _U(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under column names c0, c1, ..., and each column's name there: so no name of a caller's meets one of ours."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after each the worker gives freed memory back, which it would otherwise keep for its next task."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of the batch whose texts hold about ``max_bytes`` at most (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    bounds = np.concatenate([[0], np.cumsum(_lengths(batch.column(column)))])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + max_bytes, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def _offsets(arr) -> np.ndarray:
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    raw = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32) if arr.buffers()[1] is not None else np.zeros(1, np.int64)
    return raw[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)


def _lengths(arr) -> np.ndarray:
    if len(arr) == 0:
        return np.zeros(0, np.int64)
    n = np.diff(_offsets(arr))
    if arr.null_count:
        n = np.where(arr.is_null().to_numpy(zero_copy_only=False), 0, n)
    return n


def text_bytes(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the n + 1 offsets; null counts as empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = _offsets(arr)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside``, cut at every text's border."""
    n = inside.size
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, and for each text the index of its first word (n + 1 values)."""
    starts, ends = spans_of(~_SPACE[buf], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def folded_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words with one blank between them; starts, ends, and each text's first word."""
    starts, ends, first = word_spans(buf, offsets)
    size = ends - starts
    begin = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    low = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[at + np.repeat(begin, size)] = low[at + np.repeat(starts, size)]
    return out.tobytes(), begin, begin + size, first


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > _WINDOW:
        return _powers(_BASE, n), _powers(_BASE_INV, n)
    if "up" not in _cache:
        _cache["up"], _cache["down"] = _powers(_BASE, _WINDOW), _powers(_BASE_INV, _WINDOW)
    return _cache["up"][:n], _cache["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _MIX
    return h ^ (h >> _U(29))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte values from prefix sums, then mixed.

    ``fold`` reads A-Z as a-z. Spans are in order; work goes window by window, so that scratch
    memory depends on the window or the longest span, not on the text.
    """
    values, out, i, n = _FOLDED if fold else _BYTE, np.empty(starts.size, _U), 0, starts.size
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _WINDOW, "right")))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        up, down = _power_tables(hi - lo)
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(values[buf[lo:hi]] * up, out=total[1:])
        s = starts[i:j] - lo
        out[i:j] = (total[ends[i:j] - lo] - total[s]) * down[s]
        i = j
    return mix(out)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` consecutive hashes (len - size + 1 values)."""
    m = max(0, h.size - size + 1)
    out = np.zeros(m, _U)
    for k in range(size):
        out = out * _U(_BASE) + h[k : k + m]
    return mix(out)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of a stream that is sorted by integer ``keys``, each as one table; holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, cols)):
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
