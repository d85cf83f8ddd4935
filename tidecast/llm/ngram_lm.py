"""N-gram language model in Elias-Fano tries, trained on one part of the corpus and scoring all of it.

Words and contexts are known by 64-bit hashes, words after a context by 48 of those bits. Documents are dealt to blocks; a block sends each shard one
packed row per order: the distinct n-grams of its documents with their training counts (0 in held-out
documents). N-grams belong to the shard of their context, so that a shard knows a context's whole count; a
very common context is dealt by its words to up to ``FAN`` shards, and every block sends its count to each of
them. Every shard builds a trie of the trained n-grams:

* vocabulary: the words' hashes;  contexts: the contexts' hashes;  pointers: where each context's words begin,
* children: each context's words as numbers, made one monotone sequence by adding context x vocabulary,
* an 8-bit code for each child's share count / (context + mu) and each context's escape mu / (context + mu).

All four sequences are Elias-Fano coded, written to a file and memory-mapped (the file is unlinked at once, so
nothing is left behind); a lookup searches the successor of context x vocabulary + word between the context's
pointers. Shards answer each block in the order it asked, and the block adds up
P(w|h) = share + escape * P(w|shorter h), ending in add-one unigrams from exact counts.

Nothing is pruned or capped; the tries grow with the corpus. Defined results: null or empty text is one end
token; a null doc_id counts as remainder 0; repeated rows are all counted, and scored alike.
"""

from __future__ import annotations

import math
import mmap
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import eliasfano as ef
from .textkit import _BASE, mix, sorted_groups, span_hashes, text_bytes, text_slices, word_spans

_U = np.uint64
END, BOS = _U(0xE0D0E0D0E0D0E0D1), _U(0xB05B05B05B05B051)
#: Text bytes per block; also what a shard's n-grams stem from, on average.
BLOCK_BYTES = 12 << 20
MU = 40.0
#: A context with more than this share of the sampled tokens is dealt to many shards. Layout only: results don't depend on it.
HOT_SHARE = 1 / 2000
FAN = 32
SAMPLE_BYTES = 4 << 20
_STEP = 12 / 254


def quantised(log10: np.ndarray) -> np.ndarray:
    """Codes 1-255 for log10 probabilities from 0 down to -12; 0 is kept for what is missing."""
    return (1 + np.clip(np.round(-log10 / _STEP), 0, 254)).astype(np.uint8)


#: Probability of each code.
CODEBOOK = np.concatenate([[0.0], 10.0 ** (-_STEP * np.arange(255))])


@dataclass
class Grams:
    """Distinct n-grams of one order in a block: context hash, word hash, training count; ``of``: each token's n-gram."""

    context: np.ndarray
    word: np.ndarray
    count: np.ndarray
    total: np.ndarray  # training count of the context in the block
    of: np.ndarray
    shard: np.ndarray
    order: np.ndarray  # positions sorted by shard
    alone: tuple[np.ndarray, np.ndarray, np.ndarray]  # shard, context, total: spread contexts without a word there


def tokens_of(texts, wanted_bytes: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, an end after each text, and where each text's tokens begin (n + 1)."""
    parts, sizes = [], []
    for chunk in texts.chunks:
        for piece in text_slices(pa.RecordBatch.from_arrays([chunk], ["t"]), "t", wanted_bytes):
            buf, offsets = text_bytes(piece.column("t"))
            starts, ends, first = word_spans(buf, offsets)
            out = np.full(starts.size + first.size - 1, END, _U)
            row = np.repeat(np.arange(first.size - 1), np.diff(first))
            out[np.arange(starts.size) + row] = span_hashes(buf, starts, ends, fold=True)
            parts.append(out)
            sizes.append(np.diff(first) + 1)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(size)])


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and each value's number among them."""
    distinct, number = np.unique(values, return_inverse=True)
    return distinct, number.astype(np.int32 if distinct.size < 2**31 else np.int64)


def packed_words(h: np.ndarray) -> bytes:
    """The upper 48 bits of each hash in 6 bytes."""
    return np.ascontiguousarray((h >> _U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked_words(raw) -> np.ndarray:
    short = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(short), 8), np.uint8)
    out[:, :6] = short
    return out.view("<u8").reshape(-1)


def grams_of(tokens: np.ndarray, first: np.ndarray, trained: np.ndarray, orders: int, shards: int, hot: np.ndarray) -> list[Grams]:
    """Distinct n-grams of every order. ``trained``: per token, whether it counts."""
    words, word_no = _numbered(tokens)
    out, history = [], tokens
    for n in range(1, orders + 1):
        if n == 1:
            context, context_no = np.zeros(1, _U), np.zeros(1, np.int32)
        else:
            before = np.empty(tokens.size, _U)
            before[1:] = history[:-1]
            before[first[:-1]] = BOS
            context, context_no = _numbered(before)
            if n < orders:
                history = mix(before * _U(_BASE) + tokens)
            del before
        key, of = _numbered(context_no.astype(np.int64) * words.size + word_no)
        c, w = np.divmod(key, max(words.size, 1))
        del key, context_no
        count = np.bincount(of[trained], minlength=c.size)
        total = np.bincount(c, count, context.size).astype(np.int64)
        alone = (np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))
        if n == 1:
            shard = words[w] % _U(shards)
        else:
            home = mix(context)
            spread = np.isin(context, hot)
            shard = np.where(spread[c], mix(home[c] + mix(words[w]) % _U(FAN)), home[c]) % _U(shards)
            alone = _alone(np.flatnonzero(spread & (total > 0)), home, shard, c, context, total, shards)
        shard = shard.astype(np.int64)
        out.append(Grams(context[c], words[w], count.astype(np.uint32), total[c], of, shard, np.argsort(shard, kind="stable"), alone))
    return out


def _alone(spread, home, shard, c, context, total, shards) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards of spread contexts that get no word from this block, by shard and context."""
    every = (mix(home[spread][:, None] + np.arange(FAN, dtype=_U)) % _U(shards)).astype(np.int64)
    asked = np.unique(shard.astype(np.int64) * context.size + c)
    pairs = np.setdiff1d(every * context.size + spread[:, None], asked)
    at = pairs % context.size
    return pairs // context.size, context[at], total[at]


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not values.size:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [values.size]])


REQUEST = pa.schema([("block", pa.int64()), ("gram", pa.int32()), ("shard", pa.int64()), ("context", pa.binary()), ("children", pa.binary()), ("total", pa.binary()), ("word", pa.binary()), ("count", pa.binary())])
REQUEST_SQL = "block long, gram int, shard long, context binary, children binary, total binary, word binary, count binary"
ANSWER = pa.schema([("block", pa.int64()), ("gram", pa.int32()), ("shard", pa.int64()), ("words", pa.binary()), ("contexts", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
ANSWER_SQL = "block long, gram int, shard long, words binary, contexts binary, n long, v long"


def requests(block: int, grams: list[Grams], shards: int) -> Iterator[tuple]:
    """One packed row per order and shard; every shard is asked for order 1, as its answer brings its totals."""
    for n, g in enumerate(grams, 1):
        edges = np.searchsorted(g.shard[g.order], np.arange(shards + 1))
        lone = np.searchsorted(g.alone[0], np.arange(shards + 1))
        for s in range(shards):
            at, more = g.order[edges[s] : edges[s + 1]], slice(lone[s], lone[s + 1])
            if n > 1 and not at.size and lone[s] == lone[s + 1]:
                continue
            run = _runs(g.context[at]) if n > 1 else np.zeros(1, np.int64)
            context, size, total = g.context[at][run[:-1]], np.diff(run), g.total[at][run[:-1]]
            if lone[s] < lone[s + 1]:  # after the contexts with words
                context, total = np.append(context, g.alone[1][more]), np.append(total, g.alone[2][more])
                size = np.append(size, np.zeros(lone[s + 1] - lone[s], np.int64))
            yield (
                block, n, s, context.tobytes(), size.astype("<u4").tobytes(), total.astype("<u8").tobytes(),
                g.word[at].tobytes() if n == 1 else packed_words(g.word[at]), g.count[at].astype("<u4").tobytes(),
            )


class Trie:
    """The levels of one shard and order, from bytes or a memory map."""

    @staticmethod
    def pack(context: np.ndarray, total: np.ndarray, key_context: np.ndarray, word: np.ndarray, count: np.ndarray, mu: float) -> bytes:
        """``context`` sorted with its training ``total``; n-grams sorted by (key_context, word)."""
        vocabulary = np.unique(word)
        children = key_context.astype(_U) * _U(max(vocabulary.size, 1)) + np.searchsorted(vocabulary, word).astype(_U)
        pointers = np.searchsorted(key_context, np.arange(context.size + 1)).astype(_U)
        share = quantised(np.log10(count / (total[key_context] + mu))) if count.size else np.zeros(0, np.uint8)
        escape = quantised(np.log10(mu / (total + mu)))
        return b"".join([*(ef.encode(x) for x in (vocabulary, context, pointers, children)), share.tobytes(), escape.tobytes()])

    def __init__(self, buf):
        at, levels = 0, []
        for _ in range(4):
            levels.append(ef.Sequence(buf, at))
            at += levels[-1].bytes_used
        self.vocabulary, self.contexts, self.pointers, self.children = levels
        self.share = np.frombuffer(buf, np.uint8, self.children.n, at)
        self.escape = np.frombuffer(buf, np.uint8, self.contexts.n, at + self.children.n)

    def look_up(self, context: np.ndarray, size: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words after their contexts (0: not there) and of the contexts (0: never seen)."""
        place = self.contexts.find(context)
        seen = place >= 0
        escape = np.zeros(context.size, np.uint8)
        escape[seen] = self.escape[place[seen]]
        start, stop = np.zeros(context.size, np.int64), np.zeros(context.size, np.int64)
        start[seen], stop[seen] = self.pointers.get(place[seen]).astype(np.int64), self.pointers.get(place[seen] + 1).astype(np.int64)
        out = np.zeros(word.size, np.uint8)
        parent = np.repeat(np.arange(context.size), size)
        ask = np.flatnonzero(seen[parent])
        number = self.vocabulary.find(word[ask])
        ask, number = ask[number >= 0], number[number >= 0]
        p = parent[ask]
        target = place[p].astype(_U) * _U(max(self.vocabulary.n, 1)) + number.astype(_U)
        at = self.children.find(target, start[p], stop[p])
        out[ask[at >= 0]] = self.share[at[at >= 0]]
        return out, escape


def mapped(raw: bytes) -> mmap.mmap:
    """The bytes as a memory-mapped file that no longer has a name."""
    with tempfile.TemporaryFile() as f:
        f.write(raw)
        f.flush()
        return mmap.mmap(f.fileno(), os.fstat(f.fileno()).st_size, access=mmap.ACCESS_READ)


def _column(group: pa.Table, name: str, kind: str) -> tuple[np.ndarray, list[int]]:
    """All rows' arrays in one, and each row's length."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in group.column(name)]
    return np.concatenate(parts), [p.size for p in parts]


def trie_of(group: pa.Table, mu: float) -> bytes:
    """The trie of one shard and order from the blocks' packed rows."""
    context, _ = _column(group, "context", "<u8")
    children, _ = _column(group, "children", "<u4")
    total, _ = _column(group, "total", "<u8")
    word = np.concatenate([unpacked_words(x.as_buffer()) for x in group.column("word")])
    count, _ = _column(group, "count", "<u4")
    every, number = np.unique(context, return_inverse=True)
    sums = np.bincount(number, total.astype(float), every.size)
    used = np.flatnonzero(sums > 0)
    place = np.full(every.size, -1)
    place[used] = np.arange(used.size)
    parent = place[np.repeat(number, children)]
    kept = count > 0
    parent, word, count = parent[kept], word[kept], count[kept]
    words, word_no = np.unique(word, return_inverse=True)
    key, of = np.unique(parent * max(words.size, 1) + word_no, return_inverse=True)
    counts = np.bincount(of, count.astype(float), key.size)
    return Trie.pack(every[used], sums[used], key // max(words.size, 1), words[key % max(words.size, 1)] if words.size else words, counts, mu)


def _answers(mu: float):
    def unigrams(group: pa.Table) -> Iterator[tuple]:
        word, sizes = _column(group, "word", "<u8")
        count, _ = _column(group, "count", "<u4")
        every, number = np.unique(word, return_inverse=True)
        sums = np.bincount(number, count.astype(float), every.size).astype("<u8")
        n, v, at = int(sums.sum()), int((sums > 0).sum()), 0
        for block, size in zip(group.column("block").to_pylist(), sizes):
            yield block, sums[number[at : at + size]].tobytes(), b"", n, v
            at += size

    def higher(group: pa.Table) -> Iterator[tuple]:
        trie = Trie(mapped(trie_of(group, mu)))
        for i, block in enumerate(group.column("block").to_pylist()):
            context, children = (np.frombuffer(group.column(c)[i].as_buffer(), kind) for c, kind in (("context", "<u8"), ("children", "<u4")))
            codes, escape = trie.look_up(context, children, unpacked_words(group.column("word")[i].as_buffer()))
            yield block, codes.tobytes(), escape.tobytes(), 0, 0

    def run(batches):
        for group in sorted_groups(batches, ["gram", "shard"]):
            gram, shard = group.column("gram")[0].as_py(), group.column("shard")[0].as_py()
            for block, words, contexts, n, v in unigrams(group) if gram == 1 else higher(group):
                yield pa.RecordBatch.from_pylist([{"block": block, "gram": gram, "shard": shard, "words": words, "contexts": contexts, "n": n, "v": v}], schema=ANSWER)

    return run


def _spread(texts: DataFrame, size: int) -> np.ndarray:
    """Hashes of words so common in a bounded sample that their contexts are dealt to many shards (1 / HOT_SHARE at most)."""
    one_in = max(1, size // SAMPLE_BYTES)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                tokens, _ = tokens_of(pa.chunked_array([part.column("text")]))
                word, n = np.unique(tokens, return_counts=True)
                often = n > tokens.size * HOT_SHARE / 2
                yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often].astype(np.int64)), pa.array(np.full(int(often.sum()), tokens.size))], ["word", "n", "of"])

    found = texts.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0).select("text").mapInArrow(run, "word long, n long, of long")
    share = found.groupBy("word").agg((F.sum("n") / F.max("of")).alias("share")).where(F.col("share") > HOT_SHARE)
    rows = share.orderBy(F.desc("share"), "word").limit(int(1 / HOT_SHARE)).collect()
    return np.array([r.word for r in rows] + [int(BOS.view(np.int64))], np.int64).view(_U)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out, orders: int = 2, mu: float = MU, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of every text; training takes the rows where ``held_out`` (a boolean column) is false."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    hot = _spread(rows, size)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    def prepare(part: pa.Table):
        tokens, first = tokens_of(part.column("text"))
        trained = ~np.repeat(part.column("held_out").to_numpy(), np.diff(first))
        return tokens, first, grams_of(tokens, first, trained, orders, blocks, hot)

    def ask(part: pa.Table) -> pa.Table:
        grams = prepare(part)[2]
        columns = list(zip(*requests(part.column("block")[0].as_py(), grams, blocks)))
        del grams
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, REQUEST)], schema=REQUEST)

    def total(part: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, first, grams = prepare(part)
        answers = answers.sort_by([("gram", "ascending"), ("shard", "ascending")])
        kind = answers.column("gram").to_numpy()
        n, v = int(sum(answers.column("n").to_pylist())), int(sum(answers.column("v").to_pylist()))
        known = prob = None
        for k, g in enumerate(grams, 1):
            own = answers.filter(pa.array(kind == k))
            got = np.empty(g.word.size, np.float64)
            if k == 1:
                got[g.order] = _column(own, "words", "<u8")[0]
                known = got[g.of]
                prob = base = (known + 1) / (n + v + 1)
                continue
            codes, escape = np.empty(g.word.size, np.uint8), np.empty(g.word.size, np.uint8)
            codes[g.order] = _column(own, "words", np.uint8)[0]
            # contexts answer once per run of n-grams within a shard
            of_shard, of_context = g.shard[g.order], g.context[g.order]
            runs = np.flatnonzero(np.concatenate([[True], (of_shard[1:] != of_shard[:-1]) | (of_context[1:] != of_context[:-1])]))
            number = np.bincount(of_shard[runs], minlength=blocks)
            heard = [np.frombuffer(x.as_buffer(), np.uint8)[: number[s]] for x, s in zip(own.column("contexts"), own.column("shard").to_pylist())]
            escape[g.order] = np.repeat(np.concatenate(heard), np.diff(np.append(runs, g.word.size)))
            weight = np.where(escape == 0, 1.0, CODEBOOK[escape])
            prob = CODEBOOK[codes][g.of] + weight[g.of] * prob
        at = first[:-1]
        return pa.table(
            {
                "doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "n_tokens": np.diff(first),
                "n_known": np.add.reduceat((known > 0).astype(np.int64), at), "train_tokens": np.full(at.size, n),
                "base_score": np.add.reduceat(np.log10(base), at), "score": np.add.reduceat(np.log10(prob), at),
            }
        )

    asked = dealt.groupBy("block").applyInArrow(ask, REQUEST_SQL)
    keys = ["gram", "shard"]
    answers = asked.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(_answers(mu), ANSWER_SQL)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, RESULT)
