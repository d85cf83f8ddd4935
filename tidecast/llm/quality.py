"""Quality rules: repetition inside a document, and line frequency across the documents of a host.

Lines are normalised (words with one blank between them, A-Z lowered) and hashed. Lines above the limit of their
host are removed; a document that keeps fewer than ``min_words`` words, or less than ``min_left`` of them, is rejected.

``frequent_lines`` finds these lines: documents are told apart by a hash of their whole normalised text, and a line is
common when it stands in more than ``line_limit`` of a host's documents, an absolute number that grows with the
logarithm of the host. Exact copies count once.

``boilerplate`` is for corpora with large groups of near copies, which would condemn their own text: a line with some
words changed counts as the line it was made from (the one in most documents that has the same least hash of its
three-word windows, under one of four functions). A document with a line that is in no other counts as itself, others by
their rarest line, so that near copies count once too, and text that many groups of them share is still found.

Counting goes over (host, line, document) triples that are first made distinct within each task, so a line
that stands in a third of all documents reaches the shuffle once per task and distinct document.

Defined results: null or empty text has no words and fails; a null host is a host of its own; repeated rows
are judged alike and all returned; extra columns pass through ``clean`` untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .textkit import SMALL_SLICE_BYTES, folded_words, mix, numbered, releasing, span_hashes, spans_of, text_bytes, text_slices, window_hashes, word_spans

WINDOW_WORDS = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
LEAST_DOCS = 10
#: Up to so many documents of a host the limit is LEAST_DOCS; it then grows with their binary logarithm.
LIMIT_DOCS = 100
MIN_LEFT = 0.2
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _seen_before(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: how often its hash stands in its text, and whether an earlier item of the text has it."""
    key = mix(h ^ mix(row.astype(np.uint64) + np.uint64(1)))
    _, first, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    earlier = np.ones(h.size, bool)
    earlier[first] = False
    return count[inverse], earlier


def repeat_words(h: np.ndarray, first: np.ndarray, size: int = WINDOW_WORDS) -> np.ndarray:
    """Per text: the words that lie in a window of ``size`` words found twice or more in the text."""
    n = first.size - 1
    windows, row = window_hashes(h, size), np.repeat(np.arange(n), np.diff(first))[: max(0, h.size - size + 1)]
    inside = np.arange(windows.size) + size <= first[row + 1] if windows.size else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    if not at.size:
        return np.zeros(n, np.int64)
    count, _ = _seen_before(windows[at], row[at])
    at = at[count > 1]
    edge = np.zeros(h.size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return _per_text(np.cumsum(edge[:-1]) > 0, first)


def line_id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


SKETCH_WORDS = 3
SKETCHES = np.random.default_rng(11).integers(1, 2**63, 4, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def line_sketches(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per line (words ``starts`` to ``ends`` of ``h``, one line after the other): least window hash under each function."""
    out = np.empty((starts.size, SKETCHES.size), np.int64)
    if not starts.size:
        return out
    windows = np.zeros(h.size, np.uint64)
    windows[: max(0, h.size - SKETCH_WORDS + 1)] = window_hashes(h, SKETCH_WORDS)
    across = np.arange(h.size) + SKETCH_WORDS > np.repeat(ends, ends - starts)
    for k, factor in enumerate(SKETCHES):
        out[:, k] = np.minimum.reduceat(np.where(across, ~np.uint64(0), mix(windows * factor)), starts).view(np.int64)
    return out


LINE = pa.struct([("line", pa.int64()), ("words", pa.int32()), ("sketch", pa.list_(pa.int64()))])
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = f"doc_id long, host long, mark long, {', '.join(f'{c} long' for c in STATS)}, copy long, lines array<struct<line:long,words:int,sketch:array<long>>>"


def _measure(part: pa.RecordBatch) -> pa.RecordBatch:
    buf, offsets = text_bytes(part.column("text"))
    starts, ends, first = word_spans(buf, offsets)
    inside = np.zeros(buf.size + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1]).astype(bool)
    n = len(offsets) - 1

    a, b = spans_of(buf != 10, offsets)
    words_at, words_to = np.searchsorted(starts, a), np.searchsorted(starts, b)
    held = words_to > words_at
    a, b, words_at, words_to = a[held], b[held], words_at[held], words_to[held]
    row = np.searchsorted(offsets, a, "right") - 1
    _, earlier = _seen_before(span_hashes(buf, a, b), row)

    text, begin, stop, _ = folded_words(buf, offsets)
    sketches = line_sketches(span_hashes(buf, starts, ends, fold=True), words_at, words_to).tolist()
    lines: list[dict[bytes, list]] = [{} for _ in range(n)]
    whole = [hashlib.md5() for _ in range(n)]
    for r, s, e, w, k in zip(row.tolist(), begin[words_at].tolist(), stop[words_to - 1].tolist(), (words_to - words_at).tolist(), sketches):
        digest = hashlib.md5(text[s:e]).digest()
        whole[r].update(digest)
        # a line of fewer words than a window has no sketch
        lines[r].setdefault(digest, [0, k if w >= SKETCH_WORDS else []])[0] += w
    cols = [
        np.diff(first),
        _per_text(inside & ((buf & 0xC0) != 0x80), offsets),
        _per_text(_SYMBOL[buf], offsets),
        np.bincount(row[earlier], minlength=n),
        repeat_words(span_hashes(buf, starts, ends), first),
    ]
    return pa.RecordBatch.from_arrays(
        [
            *(part.column(c) for c in ("doc_id", "host", "mark")),
            *(pa.array(c.astype(np.int64)) for c in cols),
            pa.array([line_id(w.digest()) if x else None for w, x in zip(whole, lines)], pa.int64()),
            pa.array([[{"line": line_id(d), "words": w, "sketch": k} for d, (w, k) in x.items()] for x in lines], pa.list_(LINE)),
        ],
        ["doc_id", "host", "mark", *STATS, "copy", "lines"],
    )


def _keys(host: str) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(host).alias("host"), F.xxhash64("text").alias("mark")]


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """Counts inside each document, its normalised text's hash (null without a line) and its distinct normalised lines."""

    def run(batches):
        for batch in releasing(batches):
            for part in text_slices(batch, "text", SMALL_SLICE_BYTES):
                yield _measure(part)

    return docs.select(*_keys(host), "text").mapInArrow(run, _SCHEMA)


def line_limit(documents: Column, least_docs: int = LEAST_DOCS) -> Column:
    """Distinct documents of a host of so many in which a line may stand."""
    return F.lit(least_docs) * F.greatest(F.lit(1.0), F.log2(documents / F.lit(LIMIT_DOCS)))


def _limits(texts: DataFrame, least_docs: int) -> DataFrame:
    documents = texts.select("host", "copy").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    return documents.select("host", line_limit(F.col("documents"), least_docs).alias("limit"))


def frequent_lines(measured: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(host, line) that stands in more distinct texts of its host than ``line_limit``."""
    texts = measured.where("copy is not null").select("host", "copy", "lines")
    lines = texts.select("host", "copy", F.explode("lines.line").alias("line")).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    wide = lines.where(F.col("n") > least_docs)
    return wide.join(_limits(texts, least_docs), "host").where("n > limit").select("host", "line")


def boilerplate(measured: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(host, line) that stands in more documents of its host than ``line_limit``, groups of near copies counted once."""
    texts = measured.where("copy is not null").select("host", "copy", "lines")
    limits = _limits(texts, least_docs)
    pairs = texts.select("host", "copy", F.explode("lines.line").alias("line")).distinct()
    counts = cut_lineage(pairs.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    common = cut_lineage(counts.where(F.col("n") > least_docs).join(limits, "host").where("n > limit").select("host", "line", "limit"))
    # from here on only documents that hold a common line
    held = pairs.join(common, ["host", "line"], "left_semi").select("host", "copy").distinct()
    lines = texts.join(held, ["host", "copy"], "left_semi").select("host", "copy", F.inline("lines")).drop("words").distinct()
    lines = cut_lineage(lines.join(counts, ["host", "line"], "left").withColumn("n", F.coalesce("n", F.lit(1))))
    sketches = lines.select("host", "line", "n", "sketch").distinct().select("host", "line", "n", F.posexplode("sketch").alias("k", "least"))
    widest = sketches.groupBy("host", "k", "least").agg(F.max(F.struct("n", "line")).alias("as"))
    origin = sketches.join(widest, ["host", "k", "least"]).groupBy("host", "line").agg(F.max("as").alias("as"))
    known = lines.drop("sketch").join(origin, ["host", "line"], "left").withColumn("as", F.coalesce("as", F.struct("n", "line")))
    keys = known.groupBy("host", "copy").agg(F.min("as").alias("as")).withColumn("own", F.col("as.n") == 1)
    keys = keys.select("host", "copy", "own", F.when(F.col("own"), F.col("copy")).otherwise(F.col("as.line")).alias("key"))
    wide = lines.select("host", "copy", "line").join(common, ["host", "line"]).join(keys, ["host", "copy"])
    return wide.select("host", "line", "limit", "own", "key").distinct().groupBy("host", "line", "limit").agg(F.count(F.lit(1)).alias("n")).where("n > limit").select("host", "line")


def judge(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, near_copies: bool = False, min_left: float = MIN_LEFT) -> DataFrame:
    """Lines are judged by ``frequent_lines``, with ``near_copies`` by ``boilerplate``.

    doc_id, host, mark, the counts, base_failed, n_removed (words in removed lines), removed (their hashes), kept.
    """
    measured = cut_lineage(measure(docs, host))
    frequent = boilerplate(measured, least_docs) if near_copies else frequent_lines(measured, least_docs)
    placed = measured.select("doc_id", "host", "mark", F.inline("lines")).drop("sketch").join(frequent, ["host", "line"])
    gone = placed.groupBy(F.col("doc_id").alias("d"), F.col("host").alias("h"), F.col("mark").alias("m")).agg(F.collect_set(F.struct("line", "words")).alias("gone"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("host") == F.col("h")) & (F.col("mark") == F.col("m"))
    joined = measured.drop("copy", "lines").join(gone, same, "left")
    removed = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda total, x: total + x["words"]), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.col("n_words") - F.col("n_removed")
    return (
        joined.withColumn("n_removed", removed)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= MIN_WORDS) & (left >= F.col("n_words") * F.lit(min_left)))
        .select("doc_id", "host", "mark", *STATS, "base_failed", "n_removed", F.coalesce(F.col("gone.line"), F.array().cast("array<long>")).alias("removed"), "kept")
    )


def strip_lines(text: str, removed: set[int]) -> str:
    """The text without the lines whose normalised form is in ``removed``."""
    out = []
    for line in text.split("\n"):
        joined = folded_words(*text_bytes(pa.array([line])))[0][:-1]
        if not joined or line_id(hashlib.md5(joined).digest()) not in removed:
            out.append(line)
    return "\n".join(out)


def clean(docs: DataFrame, host: str = "source", near_copies: bool = True, **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, without the lines above their host's limit; same columns."""
    verdict = judge(docs, host, near_copies=near_copies, **limits).where("kept").select("doc_id", "host", "mark", "removed").dropDuplicates(["doc_id", "host", "mark"])
    rows, names = numbered(docs)
    text, columns = names["text"], list(names.values())
    verdict = verdict.toDF("of_id", "of_host", "of_mark", "removed")
    keyed = rows.withColumns({"host": F.xxhash64(names[host]), "mark": F.xxhash64(text)})
    same = keyed[names["doc_id"]].cast("long").eqNullSafe(verdict["of_id"]) & (keyed["host"] == verdict["of_host"]) & (keyed["mark"] == verdict["of_mark"])
    picked = keyed.join(verdict, same).select(*columns, "removed")

    def run(batches):
        for batch in releasing(batches):
            for part in text_slices(batch, text, SMALL_SLICE_BYTES):
                gone = part.column("removed")
                texts = [strip_lines(t.as_py(), set(g.as_py())) if len(g) else t.as_py() for t, g in zip(part.column(text), gone)]
                at = part.schema.get_field_index(text)
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type)).select(columns)

    out = picked.mapInArrow(run, rows.schema).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
