"""Elias-Fano sequences over a byte buffer: vectorised access and successor search with numpy."""

from __future__ import annotations

import struct

import numpy as np

_U = np.uint64
_HEAD = struct.Struct("<QQQQ")


def _packed(bits: np.ndarray) -> bytes:
    """Little-endian bits, padded so that any 8 bytes from a used byte on can be read as one word."""
    raw = np.packbits(bits, bitorder="little").tobytes()
    return raw + bytes(-len(raw) % 8 + 8)


def encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of unsigned 64-bit values."""
    v = np.ascontiguousarray(values, dtype=_U)
    n = v.size
    top = int(v[-1]) if n else 0
    low = min(57, max(0, ((top + 1) // max(n, 1)).bit_length() - 1))
    high = (v >> _U(low)).astype(np.int64)
    marks = np.zeros(n + (top >> low) + 1 if n else 0, np.uint8)
    marks[high + np.arange(n)] = 1
    upper = _packed(marks)
    lower = b""
    if low:
        parts = []
        for at in range(0, n, 1 << 17):  # bits as bytes, a piece at a time
            piece = v[at : at + (1 << 17)].view(np.uint8).reshape(-1, 8)
            parts.append(np.unpackbits(piece, axis=1, bitorder="little")[:, :low].reshape(-1))
        lower = _packed(np.concatenate(parts)) if parts else b""
    return _HEAD.pack(n, low, len(upper), len(lower)) + upper + lower


class Sequence:
    """Reads an encoded sequence in place (a memory map or bytes)."""

    def __init__(self, buf, at: int = 0):
        self.n, self.low, up, lo = _HEAD.unpack_from(buf, at)
        at += _HEAD.size
        self.words = np.frombuffer(buf, "<u8", up // 8, at)
        self.bytes_used = _HEAD.size + up + lo
        self._lower = np.ndarray((max(lo - 7, 0),), "<u8", buf, at + up, (1,)) if lo else None
        # directory: zeros before each word of the upper bits
        zeros = 64 - np.bitwise_count(self.words).astype(np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)])

    def _select(self, rank: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the rank-th (from 0) one or zero of the upper bits."""
        before = np.arange(self.zeros.size) * 64 - self.zeros if ones else self.zeros
        w = np.searchsorted(before, rank, "right") - 1
        x = self.words[w] if ones else ~self.words[w]
        left, pos = rank - before[w], w * 64
        for width in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & _U((1 << width) - 1)).astype(np.int64)
            go = left >= count
            left = left - np.where(go, count, 0)
            x = np.where(go, x >> _U(width), x)
            pos = pos + np.where(go, width, 0)
        return pos

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(i.size, _U)
        bit = i * self.low
        return (self._lower[bit >> 3] >> (bit & 7).astype(_U)) & _U((1 << self.low) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(_U) << _U(self.low)) | self._low(i)

    def _bucket(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller upper part."""
        out = np.zeros(high.size, np.int64)
        some = high > 0
        k = high[some] - 1
        out[some] = self._select(k, False) - k
        return out

    def successor(self, target: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """First position with a value at or over the target, within [start, stop) if given (else stop)."""
        target = np.asarray(target, _U)
        lo, hi = np.zeros(target.size, np.int64), np.full(target.size, self.n, np.int64)
        if self.n:
            high, most = target >> _U(self.low), self.get(np.array([self.n - 1]))[0] >> _U(self.low)
            reach = np.minimum(high, most).astype(np.int64)
            a, b = self._bucket(reach), self._bucket(np.minimum(reach + 1, int(most)))
            b[reach >= int(most)] = self.n
            a[high > most] = self.n
            lo, hi = a, np.maximum(a, b)
        if start is not None:
            lo, hi = np.clip(lo, start, stop), np.clip(hi, start, stop)
        wanted = target & _U((1 << self.low) - 1)
        todo = np.flatnonzero(lo < hi)
        while todo.size:  # halve what is left of each bucket
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._low(mid) < wanted[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
            todo = todo[lo[todo] < hi[todo]]
        return lo

    def find(self, target: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Position of the target, or -1."""
        target = np.asarray(target, _U)
        at = self.successor(target, start, stop)
        end = self.n if stop is None else stop
        there = at < end
        there[there] = self.get(at[there]) == target[there]
        return np.where(there, at, -1)
