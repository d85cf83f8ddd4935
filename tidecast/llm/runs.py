"""Periodic runs of words: maximal stretches that repeat with some period, and texts with the repeats taken out.

A run of period q is a stretch of at least ``max(least, repeats * q)`` consecutive words in which words q apart are the
same, q is the smallest such period, and no neighbouring word extends it. Every word of a run stands in it ``repeats``
times or more, so a word that is rarer than that within its segment is in no run of the segment and splits it. The
parts are counted anew, until no segment changes. Rounds work on all unsettled segments of a slice at once; segments
that shrink too slowly for that are split one word at a time, counting only the smaller part.

Surviving segments are lag-scanned, lags B to 2B - 1 at a time for B = 1, 2, 4, ...: a run with such a period holds two
neighbouring aligned blocks of B words at least that come back q words later. Blocks and what follows are compared by
hashes of B words, one comparison a word and level; neighbouring hits of one lag make a chain, which is extended by less
than a block on either side and then compared word by word. Chains within a run found before have a smaller period (a
stretch of two periods decides that), so that there are never more words to extend than a few for each word of the
segment. The whole scan takes the words times the logarithm of the longest segment.

Defined results: null or empty text has no words and no runs, and collapses to the empty text; words are told apart by
64-bit hashes of their bytes, case included. A text is worked on whole, in one task; rows are independent of each other,
so repeated rows are answered alike and skew does not matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import mix, span_hashes, text_bytes, text_slices, word_spans

REPEATS = 4
LEAST = 6
#: Rounds over all segments go on while they leave this share of the unsettled words at most.
SHRINK = 0.75
_STEP = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.zeros(0, np.int64)


def split_one(ids: list[int], a: int, b: int, repeats: int, least: int) -> list[tuple[int, int]]:
    """Parts of ids[a:b] in which each word stands ``repeats`` times or more, of ``least`` words or more."""
    where: dict[int, list[int]] = {}
    for i in range(a, b):
        where.setdefault(ids[i], []).append(i)
    counts = Counter({w: len(at) for w, at in where.items()})
    out, todo = [], [(a, b, counts, [w for w, n in counts.items() if n < repeats])]
    while todo:
        a, b, counts, rare = todo.pop()
        if b - a < least:
            continue
        while rare and not 0 < counts[rare[-1]] < repeats:
            rare.pop()
        if not rare:
            out.append((a, b))
            continue
        w = rare[-1]
        at = where[w][bisect_left(where[w], a)]
        counts[w] -= 1
        parts = [(a, at), (at + 1, b)]
        small, large = sorted(parts, key=lambda p: p[1] - p[0])
        own = Counter(ids[small[0] : small[1]])
        for x, n in own.items():
            counts[x] -= n
            if counts[x] < repeats:
                rare.append(x)
        todo.append((*large, counts, rare))
        todo.append((*small, own, [x for x, n in own.items() if n < repeats]))
    return out


def frequent_segments(ids: np.ndarray, first: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments left by recursive splitting; ``first``: where each text's words begin (n + 1 values)."""
    words = int(ids.max(initial=0)) + 1
    at = np.arange(ids.size)
    seg = np.repeat(np.arange(first.size - 1), np.diff(first))
    starts, ends = [_NONE], [_NONE]
    while at.size:
        before = at.size
        _, which, count = np.unique(seg * words + ids[at], return_inverse=True, return_counts=True)
        rare = count[which] < repeats
        changed = np.zeros(int(seg[-1]) + 1, bool)
        changed[seg[rare]] = True
        edge = np.flatnonzero(np.diff(seg, prepend=-1))
        settled = ~changed[seg[edge]]
        starts.append(at[edge][settled])
        ends.append(at[np.append(edge[1:], at.size) - 1][settled] + 1)
        left = ~rare & changed[seg]
        at, seg = at[left], seg[left]
        edge = np.ones(at.size, bool)
        edge[1:] = (np.diff(at) > 1) | (np.diff(seg) > 0)
        seg = np.cumsum(edge) - 1
        wide = np.bincount(seg, minlength=1)[seg] >= least if at.size else np.zeros(0, bool)
        at, seg = at[wide], seg[wide]
        if at.size > SHRINK * before:
            edge = np.flatnonzero(np.diff(seg, prepend=-1))
            held = ids.tolist()
            parts = [p for a, b in zip(at[edge].tolist(), (at[np.append(edge[1:], at.size) - 1] + 1).tolist()) for p in split_one(held, a, b, repeats, least)]
            starts.append(np.array([p[0] for p in parts], np.int64))
            ends.append(np.array([p[1] for p in parts], np.int64))
            break
    a, b = np.concatenate(starts), np.concatenate(ends)
    wide = b - a >= least
    order = np.argsort(a[wide])
    return a[wide][order], b[wide][order]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] values, then those of starts[1]."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _leading(same: np.ndarray) -> np.ndarray:
    """True values at the head of each row."""
    return np.where(same.all(axis=1), same.shape[1], (~same).argmax(axis=1)) if same.size else np.zeros(same.shape[0], np.int64)


def _chains(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and lags (size to 2 size - 1) of stretches of two or more aligned blocks that come back one lag later."""
    blocks = -(-h.size // size)
    grid = np.zeros(blocks * size, np.uint64)
    grid[: h.size] = h
    grid = grid.reshape(blocks, size)
    hit = np.zeros((size, blocks), np.int8)  # lag by lag; the last column ends each row's chains
    hit[:, :-1] = (grid[1:] == grid[:-1, :1]).T
    flat = hit.ravel()
    step = np.diff(flat, prepend=np.int8(0))
    begin, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = stop - begin >= 2
    begin, stop = begin[long], stop[long]
    lag = size + begin // blocks
    return (begin % blocks) * size, (stop - 1) % blocks * size + size + lag, lag


def lag_scan(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of all runs within the given segments."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # segments one after the other, with a word of its own at the end of each
    sizes = ends - starts + 1
    place = _ragged(starts, sizes)
    seg = np.repeat(np.arange(starts.size), sizes)
    words = np.empty(place.size, np.int64)
    last = np.cumsum(sizes) - 1
    inner = np.ones(place.size, bool)
    inner[last] = False
    words[inner] = ids[place[inner]]
    words[last] = -1 - np.arange(starts.size)
    h, size = mix(words.view(np.uint64)), 1
    covered = (_NONE, _NONE)  # starts in order, and the furthest end up to each
    while words.size:
        x, y, lag = _chains(h, size)
        if x.size:
            # chains in original places; none spans two segments
            base = place[x] - x
            k = np.searchsorted(covered[0], base + x, "right") - 1
            inside = (k >= 0) & (covered[1][np.maximum(k, 0)] >= base + y) if covered[0].size else np.zeros(x.size, bool)
            x, y, lag, base = x[~inside], y[~inside], lag[~inside], base[~inside]
        if x.size:
            off, m = np.arange(size), words.size
            i = x[:, None] - 1 - off
            head = _leading((i >= 0) & (words[np.maximum(i, 0)] == words[np.minimum(np.maximum(i, 0) + lag[:, None], m - 1)]))
            i = y[:, None] + off
            tail = _leading((i < m) & (words[np.minimum(i, m - 1)] == words[np.minimum(i, m - 1) - lag[:, None]]))
            x, y = x - head, y + tail
            pairs = _ragged(x, y - lag - x)
            bad = words[pairs] != words[pairs + np.repeat(lag, y - lag - x)]
            wrong = np.bincount(np.repeat(np.arange(x.size), y - lag - x)[bad], minlength=x.size) > 0
            x, y, lag, base = x[~wrong], y[~wrong], lag[~wrong], base[~wrong]
            found.append((base + x, y - x, lag))
            a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[0] + f[1] for f in found])
            order = np.argsort(a, kind="stable")
            covered = (a[order], np.maximum.accumulate(b[order]))
        # hashes of twice as many words; those that pass the end hold its own word
        twice = h * _FACTOR
        twice[:-size] += h[size:]
        h, size = mix(twice), 2 * size
        room = np.bincount(seg, minlength=1)[seg] > max(least, repeats * size)
        if not room.all():
            words, place, seg, h = words[room], place[room], seg[room], h[room]
    if not found:
        return _NONE, _NONE, _NONE
    start, length, period = (np.concatenate(c) for c in zip(*found))
    held = length >= np.maximum(least, repeats * period)
    return start[held], length[held], period[held]


def word_runs(ids: np.ndarray, first: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs of all texts, by start, then period."""
    if repeats < 4:
        raise ValueError("a run must hold its period four times or more")
    start, length, period = lag_scan(ids, *frequent_segments(ids, first, repeats, least), repeats, least)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def planted(first: np.ndarray, seeds: list[int | None]) -> np.ndarray:
    """For each word the word that stands in its place: itself, or in texts with a seed the word of a repeated stretch."""
    take = np.arange(int(first[-1]))
    for f, n, g in zip(first[:-1].tolist(), np.diff(first).tolist(), seeds):
        if g is not None and n:
            a = g % n
            take[f + a : f + n] = f + a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return take


def _texts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of the given words with one blank between them; ``first`` as in frequent_segments, of ``words``."""
    size = (ends - starts)[words]
    last = np.zeros(words.size, bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    total = np.concatenate([[0], np.cumsum(size + ~last)])
    out = np.full(int(total[-1]), 32, np.uint8)
    for k in range(0, words.size, _STEP):
        n, at = size[k : k + _STEP], words[k : k + _STEP]
        out[_ragged(total[k : k + n.size], n)] = buf[_ragged(starts[at], n)]
    return pa.StringArray.from_buffers(first.size - 1, pa.py_buffer(total[first].astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapse(part: pa.RecordBatch, repeats: int, least: int) -> list[pa.Array]:
    buf, offsets = text_bytes(part.column("text"))
    starts, ends, first = word_spans(buf, offsets)
    take = planted(first, part.column("seed").to_pylist())
    _, ids = np.unique(span_hashes(buf, starts, ends), return_inverse=True)
    start, length, period = word_runs(ids[take], first, repeats, least)
    edge = np.zeros(take.size + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[first]
    row = np.searchsorted(first, start, "right") - 1
    bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(c) for c in (start - first[row], length, period)], ["start", "length", "period"]))
    return [runs, _texts(buf, starts, ends, take[kept], left)]


def collapse(docs: DataFrame, seed: Column | None = None, repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period in words; by start, then period), collapsed (text without a run's repeats).

    A word is left out of ``collapsed`` if some run contains it after the run's first ``period`` words; kept words have
    one blank between them. ``seed``: where not null, a stretch of the text is first repeated up to its end (see
    ``planted``), for measuring on texts whose runs are known.
    """

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_collapse(part, repeats, least)], ["doc_id", "runs", "collapsed"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.lit(None) if seed is None else seed).cast("long").alias("seed"))
    return picked.mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digest(collapsed: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: least start, then period) and digests of the runs and the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    with_longest = collapsed.withColumn("longest", longest)
    length, period = F.col("longest.length"), -F.col("longest.period")
    return with_longest.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
