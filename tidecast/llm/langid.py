"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are code points of the lower-cased text, cut at NUL; every run of 1 to ``ORDERS`` is hashed to one of
``BUCKETS`` buckets. Counting runs in the tasks: each emits its counts per language and bucket, which Spark
adds up. The log-probability matrix has languages x buckets entries at most 2^23 (buckets are halved while it
would be larger), whatever the corpus, so it is broadcast; texts are scored in numpy batches.

Defined results: null text, or text without a letter, is ``und`` with score 0, as is everything when nothing
was learned; the score is the posterior probability of the predicted language; ties go to the first language
in code-point order. Rows of null language teach nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import text_slices

ORDERS = 3
BUCKETS = 1 << 15
#: Bound of the broadcast matrix: so many rows of BUCKETS 32-bit numbers, 128 MB.
MOST_LANGUAGES = 1024
SMOOTHING = 0.5
UNKNOWN = "und"
# multipliers of the window hash, one per place
_PLACE = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def bucket_runs(texts: list[str], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, every window's bucket (``buckets``: crosses a text's border); offsets of the texts, one apart."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])])
    border, h, shift, out = code == 0, np.zeros(code.size, np.uint32), np.uint32(32 - (buckets.bit_length() - 1)), []
    crossed = np.zeros(code.size, bool)
    for n in range(ORDERS):
        m = code.size - n
        if m <= 0:
            out.append(np.zeros(0, np.int64))
            continue
        h = (h[:m] ^ (code[n:] * _PLACE[n])) * np.uint32(0x01000193) + np.uint32(n + 1)
        crossed = crossed[:m] | border[n:]
        mixed = h ^ (h >> np.uint32(15))
        out.append(np.where(crossed, buckets, (mixed * _PLACE[0]) >> shift).astype(np.int64))
    return out, offsets


def _counting(buckets: int):
    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                langs, texts = np.array(part.column("lang").to_pylist(), object), part.column("text").to_pylist()
                for lang in sorted(set(langs)):
                    mine = totals.setdefault(lang, np.zeros(buckets + 1, np.int64))
                    for windows in bucket_runs([texts[i] for i in np.flatnonzero(langs == lang)], buckets)[0]:
                        mine += np.bincount(windows, minlength=buckets + 1)
        for lang, mine in totals.items():
            some = np.flatnonzero(mine[:buckets])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * some.size, pa.string()), pa.array(some.astype(np.int32)), pa.array(mine[some])], ["lang", "bucket", "n"])

    return run


class Model:
    """Languages in code-point order, log-probabilities (languages x buckets + 1, the last 0) and log-priors."""

    def __init__(self, langs: list[str], log_prob: np.ndarray, prior: np.ndarray):
        self.langs, self.log_prob, self.prior = langs, log_prob, prior

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        at = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not at or not self.langs:
            return names, scores
        orders, offsets = bucket_runs([texts[i] for i in at], self.log_prob.shape[1] - 1)
        total = np.tile(self.prior[:, None], (1, len(at)))
        for windows in orders:
            # windows that start at a text's border score 0, so each text's sum may run up to the next text
            starts = offsets[:-1]
            held = starts < windows.size
            for k in range(len(self.langs)):
                total[k, held] += np.add.reduceat(self.log_prob[k][windows], starts[held], dtype=np.float64)
        best = total.argmax(axis=0)
        chance = 1.0 / np.exp(total - total.max(axis=0)).sum(axis=0)
        for i, b, c in zip(at, best.tolist(), chance.tolist()):
            names[i], scores[i] = self.langs[b], c
        return names, scores


def fit(labelled: DataFrame) -> Model:
    """Learn from ``text`` and ``lang`` of all rows where both are there."""
    rows = labelled.select("lang", "text").where("lang is not null and text is not null")
    per_lang = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    number = per_lang.count()
    if number > MOST_LANGUAGES:
        raise ValueError(f"{number} languages; the model holds {MOST_LANGUAGES} at most")
    documents = {r.lang: r.n for r in per_lang.collect()}
    buckets = BUCKETS
    langs = sorted(documents)
    counts = np.zeros((len(langs), buckets))
    place = {lang: i for i, lang in enumerate(langs)}
    summed = rows.mapInArrow(_counting(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    counts[[place[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    log_prob = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * buckets)) if langs else counts
    prior = np.log(np.array([documents[x] for x in langs], float) / max(1, sum(documents.values())))
    return Model(langs, np.hstack([log_prob, np.zeros((len(langs), 1))]).astype(np.float32), prior)


def predict(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """doc_id, the ``keep`` columns, lang_pred, score; the text is the only input of a prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    names = [c for c in picked.columns if c != "text"]
    schema = picked.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                lang, score = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return picked.mapInArrow(run, schema)
