import numpy as np
import tiktoken
import public_tokenizers as P
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as cp
from test_quality_mixing import WORD, brute_targets
from test_simhash import kept_ids
from tidecast.llm import bpe, pii, quality


def stage_tables(spark, sf_dir, docs):
    for (name, stage) in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        yield name, docs, rows
        docs = spark.createDataFrame(rows, out.schema)


def check(spark, docs):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = None
    for name, before, rows in stage_tables(spark, "", docs):
        source = before.collect()
        if name != "encoding":
            assert not rows or rows[0].__fields__ == docs.columns
        if name == "quality":
            kept = sorted(r.doc_id for r in quality.judge(before).where("kept").collect() if r.doc_id is not None)
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == kept
        elif name == "near_duplicates":
            assert sorted((r.doc_id for r in rows), key=str) == kept_ids([(r.doc_id, r.text) for r in source])
        elif name == "personal_data":
            weights = pii.train(before)
            by_id = {r.doc_id: r for r in rows}
            assert len(rows) == len(source)
            for r in source:
                assert by_id[r.doc_id].text == pii.mask_text(r.text, pii.find_in(r.text, weights, 2.0))
                assert not pii.rule_spans(by_id[r.doc_id].text)
        elif name == "mixing":
            size = lambda r: len(WORD.findall(r.text or ""))
            sizes, taken = {}, {}
            for r in source:
                sizes[r.source] = sizes.get(r.source, 0) + size(r)
            for r in rows:
                taken[r.source] = taken.get(r.source, 0) + size(r)
            largest = max(map(size, source), default=0)
            for s, goal in brute_targets(sizes).items():
                assert abs(taken.get(s, 0) - goal) <= largest
        else:
            assert sorted((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows) == sorted((r.doc_id, library.encode_ordinary(r.text)) for r in source)
        last = rows
    return last


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert check(spark, docs)


def test_stages_on_odd_rows(spark):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(0, None, "en", "a", 0, 1), (1, "", "en", "a", 0, 1), (2, body, None, None, 5, 1), (2, body, None, None, 5, 1), (None, body + " x", "en", "a", 5, 1), (4, "z " * 2000, "en", "b", None, 1), (5, "mail bob.1@mail.example.com " + body[::-1], "en", "b", 3, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mark int"
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        tables = {name: out for name, _, out in stage_tables(spark, "", docs)}
        if some:
            assert [r.doc_id for r in tables["near_duplicates"]].count(2) <= 1
            assert all(r.text for r in tables["quality"])
        else:
            assert not any(tables.values())


def test_run_is_the_registered_query(spark):
    df = E.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "n_tokens", "ids"] and df.agg(F.sum("n_tokens")).first()[0] > 0
