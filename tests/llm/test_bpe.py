import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidecast.llm import bpe

ODD = "aé 1٣ \n\t '“!.sStrevemlld中🙂́　\x1c"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), bpe._classes())


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_files_pattern():
    assert bpe.SPLIT_PATTERN == P.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ODD) | st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=60))
def test_splits_and_ids(text):
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")) if not hasattr(test_splits_and_ids, "c") else None
    if ranks:
        test_splits_and_ids.c = bpe.Codec(ranks, bpe._classes())
        test_splits_and_ids.l = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c, lib = test_splits_and_ids.c, test_splits_and_ids.l
    if all(ch.isprintable() or ord(ch) < 0x300 for ch in text):
        assert c.ends(text).tolist() == [m.end() for m in regex.finditer(P.PATTERN, text)]
    ids = np.frombuffer(c.encode(text), "<u4").tolist()
    assert ids == lib.encode_ordinary(text)
    assert c.decode(np.array(ids, "<u4").tobytes()) == text.encode()


def test_long_pretokens(codec, library):
    for text in ("ab" * 400, "z" * 3000, "!?" * 500, "ation" * 300 + "é" * 77):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_documents_and_odd_rows(spark, library):
    rng = np.random.default_rng(5)
    words = ["it's", "don't", "  ", "\n \n", "été", "x" * 90, "12345", "...", "中文字", "we'll", "end"]
    texts = [None, "", " ", "\n", "it's  \n", "w" * 5000, " " * 4000 + "x", "'s" * 700]
    texts += [" ".join(rng.choice(words, 900)) for _ in range(6)] + ["a b " * 300 + "q" * 900 + " c d" * 400]
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(9, texts[9], "again"), (None, "null id " * 200, "x"), (None, texts[10], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    vocabulary = bpe.Vocabulary(spark, P.path("byte_bpe_50k.tiktoken"))

    def want(kind):
        for d, t, _ in rows:
            ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
            yield (d, len(ids) // 4, ids) if kind == "ids" else (d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())

    for kind in ("ids", "digest"):
        for chunk, overlap in ((300, 60), (64, 20), (32768, 1024)):
            got = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in bpe.encode(docs, vocabulary, kind, chunk, overlap).collect()]
            assert sorted(got, key=str) == sorted(want(kind), key=str)
    back = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.encode(docs.limit(0), vocabulary, "digest").count() == 0
