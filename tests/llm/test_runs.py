import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidecast.llm import runs
from tidecast.llm.queries import op11_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words):
    """Every maximal stretch by every lag, smallest periods only."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                stretch = words[i : i + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words, repeats=4, least=6):
    _, ids = np.unique(np.array(words, dtype=str), return_inverse=True) if words else (None, np.zeros(0, np.int64))
    cols = runs.word_runs(ids.astype(np.int64), np.array([0, len(words)]), repeats, least)
    return list(zip(*(c.tolist() for c in cols)))


@st.composite
def repetitive(draw):
    out = []
    for _ in range(draw(st.integers(1, 5))):
        unit = draw(st.lists(st.sampled_from("abcd"), min_size=1, max_size=6))
        out += unit * draw(st.integers(1, 9)) + draw(st.lists(st.sampled_from("abcdxyz"), max_size=4))
    return out * draw(st.sampled_from([1, 1, 4, 5]))


@settings(max_examples=400, deadline=None)
@given(repetitive())
def test_runs_against_all_lags(words):
    assert found(words) == brute_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=90))
def test_runs_of_two_words(words):
    assert found(words) == brute_runs(words)


def test_long_periods():
    rng = random.Random(3)
    for q in (17, 64, 129, 500):
        unit = [rng.choice("abcdefghij") for _ in range(q)]
        words = ["head"] * 3 + (unit * 6)[: 4 * q + 5] + ["tail", "tail"] + unit * 3
        assert found(words) == brute_runs(words)
        assert any(r[2] == q for r in found(words))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 4), st.integers(1, 7))
def test_splitting_is_the_fixed_point(words, repeats, least):
    """Rounds over all segments and single splits end in the same segments."""

    def recurse(a, b):
        if b - a < least:
            return []
        rare = [i for i in range(a, b) if words[a:b].count(words[i]) < repeats]
        if not rare:
            return [(a, b)]
        edges = [a - 1, *rare, b]
        return [p for x, y in zip(edges, edges[1:]) for p in recurse(x + 1, y)]

    want = recurse(0, len(words))
    ids = np.array(words, np.int64)
    a, b = runs.frequent_segments(ids, np.array([0, len(words)]), repeats, least)
    assert list(zip(a.tolist(), b.tolist())) == want
    assert sorted(runs.split_one(words, 0, len(words), repeats, least)) == want


def test_very_long_texts_take_time_in_proportion():
    began = time.time()
    n = 400_000
    rng = np.random.default_rng(1)
    one, two = np.zeros(n, np.int64), rng.integers(0, 2, n)
    ladder = np.repeat(np.arange(n // 4), 4)  # each split leaves the next word too rare
    ladder = ladder[np.argsort(np.arange(n) + 7 * (np.arange(n) % 4), kind="stable")]
    assert runs.word_runs(one, np.array([0, n]))[1].tolist() == [n]
    unit = rng.integers(0, 50, 30_000)
    s, l, p = runs.word_runs(np.tile(unit, 13), np.array([0, unit.size * 13]))
    assert (unit.size * 13, unit.size) in zip(l.tolist(), p.tolist())
    runs.word_runs(two, np.array([0, n]))
    runs.word_runs(ladder, np.array([0, n]))
    chain = np.concatenate([[k, k + 1, k, k] for k in range(n // 4)])  # each word is too rare only once the one before is gone
    assert runs.frequent_segments(chain, np.array([0, n]))[0].size == 0
    assert time.time() - began < 60


def want_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    every = brute_runs(words)
    gone = {i for s, length, q in every for i in range(s + q, s + length)}
    best = min(every, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(every), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in every)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_all_lags(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "one", "a a a a a", "a a a a a a", "a b a b a b a b", "a b a b a b a", "A a A a A a A a", "é ü é ü é ü é ü x", "x" * 70_000, "w\x0bw\tw\rw\fw\nw"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[6]), (5, texts[5]), (5, texts[5])]
    for i in range(300):
        words = [rng.choice("abcdefgh") for _ in range(rng.choice([3, 30, 120]))]
        if rng.random() < 0.5:
            words = words + words[: rng.randint(1, len(words))] * rng.randint(1, 6) + ["z"]
        rows.append((1000 + i, rng.choice([" ", "\n", "  "]).join(words)))
    for some in (rows, []):
        spark.createDataFrame([(d, t, 1, "s", [2]) for d, t in some], "doc_id long, text string, runs int, seed string, collapsed array<int>").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = op11_runs(spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted((want_row(*r) for r in some), key=str)


def test_collapsed_texts_are_returned(spark):
    docs = spark.createDataFrame([(1, "so it goes on on on on on on and on"), (2, None)], "doc_id int, text string")
    got = {r.doc_id: r for r in runs.collapse(docs).collect()}
    assert got[1].collapsed == "so it goes on and on" and [tuple(r) for r in got[1].runs] == [(3, 6, 1)]
    assert got[2].collapsed == "" and got[2].runs == []
