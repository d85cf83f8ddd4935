import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidecast.llm import components, simhash
from tidecast.llm.queries import op4_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=4):
    """fp -> all fps reachable, by all pairs."""
    left, label = set(fps), {}
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            group |= near
            todo += near
        for x in group:
            label[x] = frozenset(group)
    return label


def want(rows):
    fps = [(d, brute_fp(t)) for d, t in rows]
    groups = brute_components({f for _, f in fps})
    out = []
    for d, f in fps:
        ids = [e for e, g in fps if g in groups[f] and e is not None]
        out.append((d, f"{f:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


TEXTS = [None, "", " \n\t", "One", "one", "a b c", "A  b\nc", "a b c d", "x" * 70_000, "é É ñ \x0b z  ä 中文 a b", "w " * 40_000]


def documents():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[9]), (None, "null id alone here"), (None, "null id alone here")]
    for g in range(25):
        base = [word() for _ in range(rng.choice([5, 60, 300]))]
        for c in range(rng.choice([1, 1, 4, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = word()
            rows.append((1000 + g * 50 + c, " ".join(words)))
    return rows


def test_fingerprints():
    texts = [t for _, t in documents()]
    for words in (texts, texts[3:5], []):
        assert simhash.fingerprints_of(pa.array(words, pa.string())).tolist() == [brute_fp(t) for t in words]


def test_query_against_all_pairs(spark, tmp_path):
    for rows in (documents(), []):
        spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, fp int, label string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        got = [tuple(r) for r in op4_simhash(spark, str(tmp_path)).collect()]
        assert sorted(got, key=str) == want(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 63), st.integers(0, 63)), max_size=60), st.integers(0, 8))
def test_shards_lose_no_link(picks, wide):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(13)]
    fps = sorted({centres[c] ^ (1 << a) ^ (1 << b) for c, a, b in picks})
    for parts in (5, 6, 8):
        masks = [m & (2**64 - 1) for m in simhash._masks(parts, 4)]
        for x in fps:
            for y in fps:
                if (x ^ y).bit_count() <= 4:
                    assert any(x & m == y & m for m in masks)
    links = simhash.shard_links(fps, [False] * len(fps), False, 4)
    for pair in (False, True):
        right = [bool(x >> wide & 1) for x in fps]
        if pair:
            a = [i for i, r in enumerate(right) if not r]
            b = [i for i, r in enumerate(right) if r]
            links = simhash.shard_links(fps, right, True, 4)
            links += [(a[x], a[y]) for x, y in simhash.shard_links([fps[i] for i in a], [False] * len(a), False, 4)]
            links += [(b[x], b[y]) for x, y in simhash.shard_links([fps[i] for i in b], [False] * len(b), False, 4)]
        sets = simhash._Sets(len(fps))
        for x, y in links:
            assert (fps[x] ^ fps[y]).bit_count() <= 4
            sets.join(x, y)
        groups = brute_components(fps)
        for i, x in enumerate(fps):
            assert {fps[j] for j in range(len(fps)) if sets.root(j) == sets.root(i)} == set(groups[x])


def test_salted_shards_and_long_chains(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(150)})
    walk = [rng.getrandbits(64)]
    for i in range(40):
        walk.append(walk[-1] ^ sum(1 << (i * 3 + b) % 64 for b in range(3)))
    fps = sorted({*fps, *walk})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    labels = {r.u: r.v for r in components.star_labels(simhash.link_edges(frame, len(fps), shard_rows=16)).collect()}
    groups = brute_components(fps)
    for f, s in zip(fps, signed):
        assert labels.get(s, s) == min(x - (1 << 64) if x >> 63 else x for x in groups[f])


def kept_ids(rows, radius=4):
    """Least doc_id of each component, by all pairs."""
    fp = {t: brute_fp(t) for _, t in rows}
    groups, least = brute_components(set(fp.values()), radius), {}
    for d, t in rows:
        least.setdefault(groups[fp[t]], []).append((d is None, d))
    return sorted((min(ids)[1] for ids in least.values()), key=str)


def test_keep_one(spark):
    rows = documents()
    # extra columns have names that the operator uses itself
    docs = spark.createDataFrame([(d, t, i % 3, "x", i, "k.e") for i, (d, t) in enumerate(rows)], "doc_id long, text string, fp int, label string, mark int, `row.id` string")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    groups = {frozenset(g) for g in brute_components({brute_fp(t) for _, t in rows}).values()}
    assert len(kept) == len(groups)
    firsts = {next(iter(sorted(((d is None, d) for d, t in rows if brute_fp(t) in g))))[1] for g in groups}
    assert {d for d, _ in kept} == firsts
    assert kept_ids(rows) == sorted((d for d, _ in kept), key=str)
    assert simhash.keep_one(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=40))
def test_forest_of_a_task(pairs):
    pairs = [(max(p), min(p)) for p in pairs if p[0] != p[1]]
    u, v = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    nodes, roots = (x.tolist() for x in components.forest(u, v))
    least = {}
    for x in {x for p in pairs for x in p}:
        group, todo = {x}, [x]
        while todo:
            y = todo.pop()
            near = {a if b == y else b for a, b in pairs if y in (a, b)} - group
            group |= near
            todo += near
        least[x] = min(group)
    assert dict(zip(nodes, roots)) == {x: m for x, m in least.items() if x != m}
