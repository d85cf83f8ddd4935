import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast.llm import eliasfano, ngram_lm
from tidecast.llm.queries import op3_ngram_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), "<end>"]


def out_of_training(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute(rows, orders, mu):
    """Scores from plain dictionaries, with the model's code book."""
    book, code = ngram_lm.CODEBOOK, lambda p: int(ngram_lm.quantised(np.array([math.log10(p)]))[0])
    grams, contexts = Counter(), Counter()

    def histories(ts):
        for i, t in enumerate(ts):
            for n in range(2, orders + 1):
                h = tuple(["<bos>"] * (1 if i < n - 1 else 0) + ts[max(0, i - n + 1) : i]) if i else ("<bos>",)
                yield i, t, n, h

    unigrams = Counter()
    for d, t in rows:
        if not out_of_training(d):
            ts = tokens(t)
            unigrams.update(ts)
            for _, w, n, h in histories(ts):
                grams[n, h, w] += 1
                contexts[n, h] += 1
    N, V = sum(unigrams.values()), len(unigrams)
    for d, t in rows:
        ts = tokens(t)
        prob = [(unigrams[w] + 1) / (N + V + 1) for w in ts]
        base = sum(map(math.log10, prob))
        for n in range(2, orders + 1):
            for i, w, m, h in histories(ts):
                if m == n and contexts[n, h]:
                    share = book[code(grams[n, h, w] / (contexts[n, h] + mu))] if grams[n, h, w] else 0.0
                    prob[i] = share + book[code(mu / (contexts[n, h] + mu))] * prob[i]
        yield str(d), out_of_training(d), len(ts), sum(unigrams[w] > 0 for w in ts), N, base, sum(map(math.log10, prob))


def documents():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdeABé") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "Word word WORD"), (None, "no id here"), (None, "no id here"), (7, "z" * 3_000_000), (8, "the " * 60_000)]
    rows += [(10 + i, " ".join(rng.choices(vocabulary, weights=range(1, 41), k=rng.choice([1, 30, 200])))) for i in range(60)]
    return rows + rows[3:4] * 2


def compare(got, want):
    got, want = sorted(got, key=str), sorted(want, key=str)
    assert len(got) == len(want)
    key = lambda r: (r[0], r[2], round(r[5], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def held(docs):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


@pytest.mark.parametrize("orders,block_bytes", [(2, 1 << 24), (2, 3000), (3, 20_000), (1, 3000)])
def test_scores_against_dictionaries(spark, orders, block_bytes):
    rows = documents()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    got = ngram_lm.score(docs, held(docs), orders, 5.0, block_bytes).collect()
    compare([(str(r[0]), *r[1:]) for r in got], list(brute(rows, orders, 5.0)))


def test_query_and_empty_table(spark, tmp_path):
    for rows in (documents(), []):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = op3_ngram_lm(spark, str(tmp_path)).collect()
        compare([(str(r[0]), *r[1:]) for r in got], list(brute(rows, 2, ngram_lm.MU)))


def test_probabilities_sum_to_one():
    text = "a b a c a b b a d".split() * 20
    pairs, first = Counter(zip(text, text[1:])), Counter(text[:-1])
    base = {w: (text.count(w) + 1) / (len(text) + len(set(text)) + 1) for w in set(text)}
    left = 1 - sum(base.values())  # what a new word gets
    for h in first:
        total = sum(pairs[h, w] / (first[h] + 40) + 40 / (first[h] + 40) * base[w] for w in base) + 40 / (first[h] + 40) * left
        assert abs(total - 1) < 1e-12


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=300), st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 300), max_size=50))
def test_elias_fano(values, asked):
    v = np.sort(np.array(values, np.uint64))
    s = eliasfano.Sequence(b"12345678" + eliasfano.encode(v), 8)
    q = np.concatenate([v, np.array(asked, np.uint64)])
    assert s.get(np.arange(v.size)).tolist() == v.tolist()
    want = np.searchsorted(v, q, "left")
    assert s.successor(q).tolist() == want.tolist()
    assert ((s.find(q) >= 0) == np.isin(q, v)).all()
    lo, hi = np.minimum(want, v.size // 3), np.full(q.size, v.size // 2)
    lo = np.minimum(lo, hi)
    assert s.successor(q, lo, hi).tolist() == np.clip(want, lo, hi).tolist()


def test_trie_look_up():
    rng = np.random.default_rng(3)
    context = np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64))
    pairs = sorted({(int(c), int(w)) for c, w in zip(rng.integers(0, 50, 400), rng.integers(0, 90, 400))})
    kc, w = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs], np.uint64)
    count = rng.integers(1, 9, len(pairs)).astype(float)
    total = np.maximum(np.bincount(kc, count, 50), 1)
    trie = ngram_lm.Trie(ngram_lm.mapped(ngram_lm.Trie.pack(context, total, kc, w, count, 2.0)))
    size = np.full(50, 95)
    codes, escape = trie.look_up(context, size, np.tile(np.arange(95, dtype=np.uint64), 50))
    want = np.zeros((50, 95), np.uint8)
    want[kc, w.astype(int)] = ngram_lm.quantised(np.log10(count / (total[kc] + 2)))
    assert (codes.reshape(50, 95) == want).all() and (escape == ngram_lm.quantised(np.log10(2 / (total + 2)))).all()
    codes, escape = trie.look_up(np.array([5], np.uint64), np.array([2]), np.array([1, 2], np.uint64))
    assert codes.tolist() == [0, 0] and escape.tolist() == [0]
