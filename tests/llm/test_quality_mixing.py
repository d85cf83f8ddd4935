import random
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tidecast.llm import mixing, quality
from tidecast.llm.queries import ORACLES, op5_quality, op6_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lines_of(rng, n):
    return [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(4, 14))) for _ in range(n)]


def documents():
    rng = random.Random(1)
    rows = [(0, None, "s"), (1, "", "s"), (2, " \n\t ", None), (3, "few words", "s"), (4, "x" * 90_000, "s"), (5, "é É ñ ü # $ 中文 & | < >\n" * 3, None), (6, "a a a a a a a a a a a a", "s"), (None, "no id " + " ".join(lines_of(rng, 3)), "s")]
    notice = "Shared Notice of  the host"
    for i in range(60):
        body = lines_of(rng, rng.randint(1, 9))
        if i % 2:
            body.insert(rng.randrange(len(body) + 1), notice.upper() if i % 3 else notice)
        rows.append((10 + i, "\n".join(body), f"h{i % 2}"))
    group = lines_of(rng, 6)
    for i in range(40):  # near copies: not a reason to drop them all
        copy = list(group)
        copy[rng.randrange(6)] += f" edit{i}"
        rows.append((200 + i, "\n".join(copy), "h0"))
    rows += [(300 + i, "\n".join([notice, f"own words here {i} and", notice]), "h1") for i in range(3)] + rows[10:12] * 2
    rows += [(400 + i, "\n".join([notice] * 3 + [" ".join(lines_of(rng, 1))] + ["tail " * 3]), "h1") for i in range(3)]
    return rows


def duck(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    cur = con.execute(ORACLES["op5_quality"])
    return [d[0] for d in cur.description], cur.fetchall()


def brute_base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_query_against_oracle_and_brute_force(spark, tmp_path):
    for rows in (documents(), []):
        spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, host int").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        df = op5_quality(spark, str(tmp_path))
        got = sorted((tuple(r) for r in df.collect()), key=str)
        names, want = duck(rows)
        assert df.columns == names
        assert got == sorted(want, key=str)
        by_id = {(d, t): r for d, t, _ in rows for r in got if r[0] == d}
        for (d, t), r in by_id.items():
            if d is not None:
                assert r[1:6] == brute_base(t)


def test_near_copies_stay_and_notices_go(spark):
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "k") for r in documents()], "doc_id long, text string, source string, n_chars long, kept string")
    out = quality.clean(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert {200 + i for i in range(40)} <= set(rows)
    assert all("notice" not in r.text.lower() for r in rows.values())
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert 300 not in rows and 3 not in rows and 1 not in rows
    assert sum(r.doc_id == 12 for r in out.collect()) == 3 if documents()[10][0] == 12 else True


def template_pages(n, shared, own):
    rng = random.Random(8)
    template = lines_of(rng, shared)
    return template, [(i, "\n".join(template + lines_of(rng, own)), "t") for i in range(n)]


def test_templates_go_whatever_their_share_of_a_page(spark):
    for n, shared, own in ((40, 20, 5), (100, 40, 3), (40, 1, 3)):
        template, rows = template_pages(n, shared, own)
        for near_copies in (True, False):
            out = quality.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"), near_copies=near_copies, min_left=0.0).collect()
            assert len(out) >= 0.8 * n
            assert not any(line in r.text for r in out for line in template)


def test_templates_of_every_host_go(spark):
    rows = [(100 * h + i, t, f"host{h}") for h in range(10) for i, t, _ in template_pages(100, 40, 3)[1]]
    rng = random.Random(4)
    rows = [(d, t + "\n" + " ".join(lines_of(rng, 1)), s) for d, t, s in rows]
    verdict = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_left=0.0)
    assert verdict.where("n_removed > 0").selectExpr("count(distinct host)").first()[0] == 10
    assert verdict.where("size(removed) < 40").count() == 0


def test_no_column_name_clashes(spark):
    docs = spark.createDataFrame([(i, "some words that are enough for a whole document here " + str(i), "s", i, "m", [1], "x") for i in range(4)], "doc_id long, text string, source string, tc_h int, tc_m string, removed array<int>, `h.m` string")
    out = quality.clean(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_limit_does_not_rise_with_the_host(spark):
    template, rows = template_pages(40, 1, 3)
    rng = random.Random(9)
    rows += [(1000 + i, "\n".join(lines_of(rng, 2)), "t") for i in range(1500)]
    out = quality.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert not any(template[0] in r.text for r in out)


def test_text_of_many_groups_of_near_copies_goes_and_theirs_stays(spark):
    rng = random.Random(10)
    notice, rows = "one notice that stands on every page of them all", []
    for g in range(15):
        group = lines_of(rng, 8)
        for i in range(20):
            copy = list(group)
            copy[rng.randrange(8)] += f" edit{i}"
            rows.append((100 * g + i, "\n".join([notice, *copy]), "t"))
    out = quality.clean(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows) and not any(notice in r.text for r in out)
    assert all(r.text.count("\n") == 7 for r in out)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


def mixed_rows():
    rng = random.Random(5)
    rows = [(None, "a b c", "zz"), (1, None, "a"), (2, "", None), (3, "w " * 500, "\U0001f642"), (4, "w " * 300, "￮"), (5, None, "empty")]
    for s, n in (("a", 400), ("b", 30), ("c", 60), (None, 50), ("é", 5)):
        rows += [(rng.randrange(10**15), "w " * rng.choice([1, 20, 300]), s) for _ in range(n)]
    return rows + rows[10:13] * 2


def test_mix_query(spark, tmp_path):
    rows = mixed_rows()
    spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, size int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = op6_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, op6_mixing(spark, str(tmp_path)).collect()), key=str)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    goal = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    source = {(d, size(t)): s for d, t, s in rows}
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= (20 if s in ("a", "b", "c") else 500)
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op6_mixing(spark, str(tmp_path / "none")).collect() == []


def test_targets(spark):
    rng = random.Random(7)
    for _ in range(6):
        sizes = {f"s{i}" if i else None: rng.choice([0, 5, 100, 4000, 10**6]) for i in range(rng.randint(1, 9))}
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_several_flights(spark):
    rows = [(i, "w " * (1 + i % 37), "one" if i % 3 else f"s{i % 4}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.sample(docs, F.xxhash64("text"), block=16).groupBy("source_size", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 1500
    assert all(abs(r.taken - r.target) <= 37 for r in got)


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(2)
    size = np.sort(rng.integers(1, 100, 300))[::-1]
    prob = np.full(300, 0.37)
    hits = np.zeros(300)
    for seed in range(400):
        flown = mixing.fly(size, prob, np.random.default_rng(seed), False)
        assert abs(flown @ size - prob @ size) < 1e-6 and abs(flown.sum() - prob.sum()) < 1e-6
        assert ((flown > 0) & (flown < 1)).sum() <= 2
        landed = mixing.fly(size, prob, np.random.default_rng(seed), True)
        assert set(np.unique(landed)) <= {0.0, 1.0} and abs(landed @ size - prob @ size) <= 100
        hits += landed
    assert abs(hits.mean() / 400 - 0.37) < 0.005 and abs(hits / 400 - 0.37).max() < 0.12


def test_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(*r, "x") for r in mixed_rows()], "doc_id long, text string, source string, tc_extra string")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = mixing.sample(docs, F.xxhash64(*docs.columns)).agg(F.sum("copies"), F.sum(F.col("copies") * F.col("size"))).first()
    rows = mixed.collect()
    assert sum(len(WORD.findall(r.text or "")) for r in rows) == want[1]
    assert len(rows) == mixing.sample(docs, F.xxhash64(*docs.columns)).agg(F.sum("copies")).first()[0]


def test_mix_of_odd_columns(spark):
    rows = [(i, "w " * (5 + i % 3), f"s{i % 2}", {"k": i, "a": 1}, i, "m", [{"x": i}], "d") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tags map<string,int>, tc_mark int, mark string, nested array<map<string,int>>, `copies.n` string")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert got and all(r in rows for r in got)
