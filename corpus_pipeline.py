"""Training corpus from raw documents: quality rules, near-duplicates, personal data, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of ``documents``:

* quality: rejected documents go, lines above their host's limit are removed from the others;
* near_duplicates: one document of each component of texts whose 64-bit fingerprints of four-word shingles differ in four
  bits or less stays, that of the least doc_id;
* personal_data: every span found is replaced by its kind, as in ``<EMAIL>``;
* mixing: documents stand as often as the balanced sample takes them, none up to two times;
* encoding: doc_id, n_tokens and the token ids (little-endian unsigned 32-bit integers) of each row.

Nulls, empty and repeated rows follow the operators' definitions; extra columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import bpe, mixing, pii, quality, simhash
from tidecast.llm.queries import byte_ranks
from tidecast.session import ensure_checkpoint_dir


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.Vocabulary(spark, byte_ranks()))


STAGES = [("quality", rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("encoding", encoding)]

#: Clusters, learned spans, balanced sampling and byte-pair merges are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    The tables between them go to the shared checkpoint folder; each is removed once the next one is written, but for
    the last, which the returned rows are read from.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            _remove(spark, f"{folder}/{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
