import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidecast.llm import hardneg, urlfilter
from tidecast.llm.queries import LISTED_WORDS, URL_RULES, op12_url_filter, op13_hard_negatives


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def brute_canonical(url):
    host, path = parts(url)
    host = host.removeprefix("www.")
    if not host:
        return None
    asked = re.match(r"[^?#]*\?([^#]*)", url.split("://", 1)[1])
    kept = sorted(p for p in (asked[1].split("&") if asked else []) if p and not p.startswith("utm_") and p.split("=")[0] not in urlfilter.TRACKING)
    return host + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def brute_verdict(url, listed):
    host, path = parts(url)
    fits = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, action = max(fits, default=(0, None, None))
    return host, path, rule, action or ("block" if brute_canonical(url) in listed else "allow")


URLS = [
    None, "", "no scheme", "://", "http://", "http://?q", "http://#://x", "HTTP://WWW.Example.COM/en/1?b=2&a=1&&utm_x=1&ref=z&refs=1#f?g", "https://example.com", "https://example.com/",
    "http://notexample.com/en/", "http://www.example.com.evil.org/en/", "x://a.b.net/es/", "x://net/fr/", "x://NET/fr", "x://dotnet/fr/", "http://casino.org/a//", "http://www.casino.org/a?", "https://casino.org/a#x", "http://casino.org/b",
    "http://user:p@casino.org:80/a", "http://a.com/x://b.net/es/", "http://é.org/Ä?ü=1", "http://x.org/" + "/" * 3000 + "a" + "/" * 3000, "http://x.org/?" + "p=1&" * 3000, "http://h.org/\n/en?x\n=1",
]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS)] + [(3, URLS[17], "h", "r"), (None, URLS[16], None, "r")]
    hosts = ["www.pills.org", "m.x.org", "a.example.com", "bets.net", "b.net"]
    rows += [(100 + i, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{rng.randint(1, 9)}{rng.choice(['', '/', '?a=1&utm_s=2', '#t'])}", "h", "r") for i in range(400)]
    listed = {brute_canonical(u) for _, u, *_ in rows if any(w in parts(u)[0] for w in LISTED_WORDS)} - {None}
    for some in (rows, []):
        spark.createDataFrame(some, "page_id long, url string, html string, rule string").write.mode("overwrite").parquet(str(tmp_path / "pages.parquet"))
        got = op12_url_filter(spark, str(tmp_path))
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((d, *brute_verdict(u, listed)) for d, u, *_ in some), key=str)


def test_filter_has_no_false_negative_and_the_join_no_false_positive(spark):
    rows = spark.range(20_000).selectExpr("id as page_id", "concat('http://h', id % 50, '.org/', id) as url")
    listed = rows.where("page_id % 5 = 0").select(urlfilter.canonical(rows["url"]).alias("c")).union(spark.createDataFrame([(None,)], "c string"))
    for max_blocks in (1, 16, urlfilter.MAX_BLOCKS):
        out = urlfilter.judge(rows, listed, max_blocks=max_blocks)
        assert out.where("listed <> (page_id % 5 = 0) or (verdict = 'block') <> listed").count() == 0 and out.count() == 20_000
    blocks = urlfilter.blocks_for(4000)
    keyed = rows.select("page_id", urlfilter.canonical(rows["url"]).alias("canonical"))
    met = urlfilter.possible(keyed, urlfilter.bloom_blocks(listed.where("c is not null"), blocks, "c"), blocks)
    wrong = met.where("possible and page_id % 5 <> 0").count()
    assert met.where("not possible and page_id % 5 = 0").count() == 0 and wrong < 0.03 * 16_000
    assert urlfilter.judge(rows, listed.limit(0)).where("verdict = 'block'").count() == 0


def test_no_column_name_clashes(spark):
    rows = spark.createDataFrame([("http://bad.org/a", 1, "k")], "`the.url` string, key int, w0 string")
    out = urlfilter.judge(rows, spark.createDataFrame([("bad.org/a",)], "w0 string"), url="the.url", keep=("key", "w0", "the.url"))
    assert [tuple(r)[:3] + (r.verdict,) for r in out.collect()] == [(1, "k", "http://bad.org/a", "block")]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(0, 40), st.sampled_from([1, 300, 2**20, 2**40, 2**61]), st.integers(0, 99))
def test_packed_products_are_exact(width, rows, size, seed):
    rng = random.Random(seed)
    x = [[rng.randint(-size, size) for _ in range(width)] for _ in range(rows)]
    a = [[rng.randint(-size, size) for _ in range(width)] for _ in range(3)]
    packed = hardneg.Packed(np.array(x, np.int64).reshape(rows, width), min(map(min, a)), max(map(max, a)))
    for q in a:
        assert packed.scores(q).tolist() == [sum(u * v for u, v in zip(q, c)) for c in x]


def brute_negatives(rows):
    """rows: (vec_id, vector, label) that take part."""
    e = []
    for i, v, l in rows:
        if i is None or l is None or v is None or any(c is None or not np.isfinite(c) for c in v):
            continue
        e.append((i, (l + 1) % 10 if i % 7 == 0 else l, tuple(int(np.floor(256 * c)) for c in v)))
    out = []
    dot = lambda a, b: sum(u * v for u, v in zip(a, b))
    for i, l, x in sorted({r for r in e if r[0] % 50 == 0}):
        near = sorted((-dot(x, c), j) for j, k, c in e if k == l and j != i)[:5]
        for score, j in near:
            far = sorted((-dot(x, c), n) for n, k, c in e if k != l and 50 * -score <= 100 * dot(x, c) <= 95 * -score)[:3]
            out += [(i, j, r + 1, n, -score, -s) for r, (s, n) in enumerate(far)]
    return sorted(out)


def vectors(n, width=6, labels=4, hot=0.4):
    rng = random.Random(n)
    rows = [(i, [round(rng.uniform(-1, 1), 2) for _ in range(width)], 0 if rng.random() < hot else rng.randrange(labels)) for i in range(n)]
    rows += [(50, None, 1), (None, rows[0][1], 1), (100, [1.0, None] + [0.0] * (width - 2), 1), (150, [float("nan")] * width, 1), (200, [float("inf")] * width, 2), (250, rows[1][1], None), (300, [], 1), (350, [0.5], 2)]
    rows += [rows[100], rows[100], rows[51], rows[51], (7, rows[7][1], 3), (50, rows[3][1], 0)] + [(i, [0.0] * width, 1) for i in range(600, 640)]
    return rows


def test_negatives_against_brute_force(spark, tmp_path):
    rows = vectors(400)
    schema = "vec_id long, embedding array<double>, label int, x int, mark string, id string, anchor int"
    for some in (rows, rows[:1], []):
        frame = spark.createDataFrame([(*r, 1, "m", "i", 2) for r in some], schema)
        frame.write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
        got = op13_hard_negatives(spark, str(tmp_path))
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == brute_negatives(some)


def test_blocks_and_shards_change_nothing(spark):
    label = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label"
    rows = vectors(1500, hot=0.8)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("vec_id", "embedding", label)
    got = hardneg.mine(frame, hardneg.F.col("id") % 50 == 0, shard_cells=600, anchor_cells=48).collect()
    assert sorted(map(tuple, got)) == brute_negatives(rows)


def test_text_labels_and_scores_too_large(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.9, 0.1], "b"), (3, [0.1, 0.9], "b")]
    frame = spark.createDataFrame(rows, "n long, v array<float>, kind string")
    got = hardneg.mine(frame, hardneg.F.col("id") == 0, "n", "kind", "v").collect()
    assert [(r.anchor_id, r.positive_id, r.negative_id) for r in got] == [(0, 1, 2)]
    for huge in (1e30, 1e15):
        frame = spark.createDataFrame([(0, [huge], 1), (50, [huge], 1), (2, [huge / 2], 2)], "vec_id long, embedding array<double>, label int")
        with pytest.raises(Exception, match="too large|64 bits"):
            hardneg.mine(frame, hardneg.F.col("id") % 50 == 0).collect()
