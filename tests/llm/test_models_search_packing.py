import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidecast.llm import bpe, langid, packing, topk
from tidecast.llm.queries import ORACLES, op7_langid, op9_topk, op10_packing

# --- language ----------------------------------------------------------------------------------------


def brute_buckets(text, buckets):
    code, out = [ord(c) for c in text.lower()], []
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            h = 0
            if 0 in code[i : i + n]:
                continue
            for k in range(n):
                h = ((h ^ (code[i + k] * int(langid._PLACE[k]) & 0xFFFFFFFF)) * 0x01000193 + k + 1) & 0xFFFFFFFF
            out.append(((h ^ (h >> 15)) * int(langid._PLACE[0]) & 0xFFFFFFFF) >> (32 - (buckets.bit_length() - 1)))
    return out


def brute_model(rows, buckets=langid.BUCKETS):
    counts, docs = {}, {}
    for d, t, lang in rows:
        if lang is not None and t is not None and not (d is not None and zlib.crc32(str(d).encode()) % 4 == 2):
            docs[lang] = docs.get(lang, 0) + 1
            for b in brute_buckets(t, buckets):
                c = counts.setdefault(lang, {})
                c[b] = c.get(b, 0) + 1
    total = sum(docs.values())

    def predict(t):
        if not t or not any(c.isalpha() for c in t) or not docs:
            return "und", 0.0
        s = {}
        for lang in sorted(docs):
            c = counts.get(lang, {})
            whole = sum(c.values()) + 0.5 * buckets
            s[lang] = math.log(docs[lang] / total) + sum(math.log((c.get(b, 0) + 0.5) / whole) for b in brute_buckets(t, buckets))
        best = max(sorted(s), key=lambda x: s[x])
        return best, 1 / sum(math.exp(v - s[best]) for v in s.values())

    return predict


LANG_ROWS = [(i, t, l) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("this is that", "en"), ("das ist ein", "de"), ("c'est la vie", "fr")] * 6)]
ODD = [(100, None, "en"), (101, "", "en"), (102, "123 !? ²", "de"), (103, "x", None), (None, "the end", "en"), (104, "İSTANBUL \0 ü", None), (105, "the " * 3000, None), (3, "this is that", "en")]


def test_language_query(spark, tmp_path):
    for rows in (LANG_ROWS + ODD, ODD[:3], []):
        spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, score double").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        predict = brute_model(rows)
        got = sorted((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in op7_langid(spark, str(tmp_path)).collect())
        want = sorted((str(d), d is not None and zlib.crc32(str(d).encode()) % 4 == 2, *predict(t)) for d, t, _ in rows)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-3, abs=1e-3)


def test_language_accuracy(spark):
    rows = op7_langid(spark, "/root/testdata/sf0.01").alias("p").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = rows.where("held_out and lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert r[0] > 0.97 and r[1] > 150


# --- search ------------------------------------------------------------------------------------------


def test_search_query_against_oracle(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/sf0.01/embeddings.parquet')")
    want = sorted(con.execute(ORACLES["op9_topk"]).fetchall())
    df = op9_topk(spark, "/root/testdata/sf0.01")
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, df.collect())) == want


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(1, 20), st.integers(1, 6), st.sampled_from([2, 50, 10**5]))
def test_max_score(seed, n, width, k, top):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-top, top + 1, (n, width)), rng.integers(-top, top + 1, width) * (rng.random(width) < 0.7)
    ids, own = rng.permutation(n), rng.choice(n, min(n, 1), replace=False)
    rows, score = topk.max_score(q, x, ids, x.min(axis=0), x.max(axis=0), own, k)
    full = x @ q
    want = [i for i in np.lexsort((ids, -full)) if i not in own][:k]
    assert rows.tolist() == want and score.tolist() == full[want].tolist()


def test_search_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, [nan, 1.0]), (150, [None, 1.0]), (200, [inf, 0.0]), (None, [1.0, 1.0]), (250, [0.0, 0.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (0, [3.0, 3.0]), (3, [5.0]), (300, []), (4, [-1.0, -2.5, 9.0])]
    for some in (rows, rows[:1], []):
        spark.createDataFrame([(*r, 7) for r in some], "vec_id long, embedding array<float>, score int").write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
        good = [(i, [math.floor(256 * c) for c in v]) for i, v in some if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
        want = []
        for i, v in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
            want += [(i, j, sum(a * b for a, b in zip(v, w))) for j, w in good if j != i]
        out = []
        for i in {x[0] for x in want}:
            best = sorted((x for x in want if x[0] == i), key=lambda x: (-x[2], x[1]))[:5]
            out += [(i, r, j, s) for r, (_, j, s) in enumerate(best, 1)]
        got = op9_topk(spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted(out)
    vectors = spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).integers(-9, 9, 6)]) for i in range(300)], "vec_id long, embedding array<double>")
    many = topk.top_k(vectors, F.col("id") % 7 == 0, shard_rows=20, query_rows=10).collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, topk.top_k(vectors, F.col("id") % 7 == 0).collect()))


# --- packing -----------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=80))
def test_best_fit(lengths):
    rows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rows)) if room[r] >= lengths[i]]
        if fits:
            r = min(fits, key=lambda r: room[r])
        else:
            rows.append([])
            room.append(32)
            r = len(rows) - 1
        rows[r].append(i)
        room[r] -= lengths[i]
    got = packing.best_fit(lengths, 32)
    assert sorted(sum(lengths[i] for i in r) for r in got) == sorted(sum(lengths[i] for i in r) for r in rows)
    assert sorted(i for r in got for i in r) == list(range(len(lengths)))


def unpacked(rows, row_tokens, end_id, pad_id, kind):
    """(doc_id, ids) of all documents of a block, from the packed rows alone."""
    docs = {}
    for r in rows:
        line = np.frombuffer(r.ids, kind)
        assert line.size == row_tokens and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert r.position_resets == r.cu_seqlens[:-1] and (line[r.n_tokens :] == pad_id).all()
        positions = packing.position_ids(r.cu_seqlens, row_tokens)
        assert all(positions[a] == 0 for a in r.position_resets)
        for d, at, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            docs.setdefault((r.block, str(d)), []).append((at, line[a:b].tolist()))
    out = []
    for (_, d), parts in docs.items():
        flat = [x for _, p in sorted(parts, key=lambda p: p[0]) for x in p]
        text = []
        for x in flat:
            if x == end_id:
                out.append((d, text))
                text = []
            else:
                text.append(x)
        assert not text
    return sorted(out)


def test_packing_round_trip(spark, tmp_path):
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, "é" * 5000), (3, "x" * 2047), (4, "x" * 2048), (5, "y" * 4095), (6, "z" * 300_000), (7, " " * 100_000), (None, "no id")]
    rows += [(10 + i, "".join(rng.choice("abc é") for _ in range(rng.choice([3, 200, 1900, 9000])))) for i in range(80)]
    for some in (rows, []):
        spark.createDataFrame([(*r, "x") for r in some], "doc_id long, text string, ids string").repartition(3).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = op10_packing(spark, str(tmp_path)).collect()
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
        assert unpacked(got, 2048, 50256, 50257, "<u4") == sorted((str(d), library.encode_ordinary(t or "")) for d, t in some)
        got = packing.pack_bytes(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
        assert unpacked(got, 2048, 256, 257, "<u2") == sorted((str(d), list((t or "").encode())) for d, t in some)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = packing.pack_bytes(docs, row_tokens=64, block_tokens=5000).collect()
    want = sorted((str(r.doc_id), list(r.text.encode())) for r in docs.collect())
    assert unpacked(packed, 64, 256, 257, "<u2") == want
    assert sum(r.n_tokens for r in packed) / (64 * len(packed)) > 0.97


def test_packing_of_encoded_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    encoded = bpe.encode(docs, bpe.Vocabulary(spark, P.path("byte_bpe_50k.tiktoken")))
    want = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in encoded.collect())
    assert unpacked(packing.pack_ids(encoded, 50256, 50257).collect(), 2048, 50256, 50257, "<u4") == want
    ids = packing.token_ids(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in ids.collect()) == want


def test_scores_that_do_not_fit_fail(spark):
    frame = lambda *v: spark.createDataFrame([(50 * i, list(x)) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    big = 2.0**26  # products of 2^68 that cancel
    got = topk.top_k(frame([big, big], [big, -big], [1.0, 2.0]), F.col("id") == 0).collect()
    assert [(r.vec_id, r.score) for r in got] == [(100, 3 * 2**42), (50, 0)]
    for huge in (1e300, 1e12):
        with pytest.raises(Exception, match="too large|64 bits"):
            topk.top_k(frame([huge], [huge], [1.0]), F.col("id") == 0).collect()


def test_languages_beyond_the_bound_fail(spark):
    rows = spark.range(langid.MOST_LANGUAGES + 1).selectExpr("concat('l', id) as lang", "'some text' as text")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(rows)
