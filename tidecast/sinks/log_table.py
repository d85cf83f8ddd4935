"""The stored-sales table as a log of batches: appended, merged when read, committed by one small file.

A batch is written to a folder of its own (partitioned by tenant bucket and month, one row per key) and counts from the
moment a commit names it. A commit is the next numbered file in ``_commits``, put there whole and only if it is not there: it lists
the live batches with their ordinals, and the tenant lists that replacements have dropped. Whoever reads takes the
newest one, so that an upload, a replacement or a compaction is either not there or there altogether, whenever
a job dies; of two writers the second takes its change to the next number. Nothing that is committed is rewritten: a
small upload costs its own rows, however large the table.

Reading keeps the last version of every key by the batches' ordinals, in one aggregate that filters on tenant and date
pass through to the partitions. ``compact`` folds the batches into one, ``vacuum`` removes folders no commit needs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import tables as sk

COMMITS, DATA, DROPPED = "_commits", "data", "dropped"
#: Folders this young may belong to a job that has not committed yet.
VACUUM_AFTER_HOURS = 7 * 24
SCHEMA = "user_id bigint, store_id string, date date, sales double, year int, month int, week int, quarter int, season string, day_of_week int, day_of_year int, tenant_bucket int, sale_month string"


@dataclass(frozen=True)
class State:
    """What a commit says. ``streams``: the last batch of each stream that has been taken in."""

    version: int = 0
    batches: dict[str, int] = field(default_factory=dict)  # folder -> ordinal
    dropped: dict[str, int] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    whole: bool = True


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder, fs = _path(spark, f"{path}/{COMMITS}")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), reverse=True)


def state(spark: SparkSession, path: str) -> State:
    """The newest commit; a file that isn't one is passed over."""
    for version in _versions(spark, path):
        file, fs = _path(spark, f"{path}/{COMMITS}/{version:012d}.json")
        stream = fs.open(file)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            said = json.loads(text)
        except ValueError:
            continue
        if said.get("whole"):
            return State(**said)
    return State()


def _put_if_absent(spark: SparkSession, path: str, version: int, text: str) -> bool:
    """Write the numbered commit whole, unless it is there: a hidden file is renamed to it, which replaces nothing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hidden, fs = _path(spark, f"{path}/{COMMITS}/.{uuid.uuid4().hex}.tmp")
    out = fs.create(hidden, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), conf)
    final, _ = _path(spark, f"{path}/{COMMITS}/{version:012d}.json")
    plainly = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(files.makeQualified(hidden), files.makeQualified(final), plainly)
    except Py4JJavaError as e:
        fs.delete(hidden, False)
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def commit(spark: SparkSession, path: str, change: Callable[[State], State | None], tries: int = 20) -> int:
    """Write the next commit: ``change`` of the state it follows (None: nothing to do). Returns the version.

    Needs a file system whose rename replaces nothing, as HDFS has.
    """
    for _ in range(tries):
        numbers = _versions(spark, path)
        last = state(spark, path)
        new = change(last)
        if new is None:
            return last.version
        # commits are there as a whole or not at all: a number above the last whole one holds something else
        version = max([last.version, *numbers[:1]]) + 1
        if _put_if_absent(spark, path, version, json.dumps(asdict(replace(new, version=version)))):
            return version
        # another writer was first: take the change to its state
    raise RuntimeError(f"{path}: no commit number was free in {tries} tries")


def _new_folder() -> str:
    return f"b{uuid.uuid4().hex}"


def _write(rows: DataFrame, folder: str) -> None:
    out = rows.select(*sk.STORED_COLUMNS).withColumns(sk.partition_columns())
    # a folder of each (bucket, month) gets few files; one that is hot is split
    out.hint("rebalance", *sk.PARTITION).sortWithinPartitions(*sk.PARTITION, *sk.STORED_KEY).write.partitionBy(*sk.PARTITION).parquet(folder)


def last_rows(batch: DataFrame, order: str) -> DataFrame:
    """The rows of one upload whose key types, the last of each key by ``order`` (ties: by content)."""
    typed = sk.stored_shape(batch.withColumn("__order", F.col(order)))
    typed = typed.where(F.col(sk.TENANT).isNotNull() & F.col("store_id").isNotNull() & F.col("date").isNotNull())
    return sk.merge_last_wins(None, [typed], order="__order")


def append(spark: SparkSession, path: str, batch: DataFrame, *, order: str, stream: tuple[str, int] | None = None) -> int:
    """snk_upsert: insert or replace on (user_id, store_id, date). ``stream``: name and number of a stream's batch, which
    is taken in once however often it is delivered."""
    if stream and state(spark, path).streams.get(stream[0], -1) >= stream[1]:
        return state(spark, path).version
    folder = _new_folder()
    _write(last_rows(batch, order), f"{path}/{DATA}/batch={folder}")

    def change(s: State) -> State | None:
        if stream and s.streams.get(stream[0], -1) >= stream[1]:
            return None
        return replace(s, batches={**s.batches, folder: s.version + 1}, streams={**s.streams, **({stream[0]: stream[1]} if stream else {})})

    return commit(spark, path, change)


def replace_tenants(spark: SparkSession, path: str, rows: DataFrame, tenants: Sequence | DataFrame | None = None, *, order: str | None = None) -> int:
    """snk_replace_tenant: the tenants (default: those in ``rows``) end up with exactly ``rows``, in one commit."""
    new = last_rows(rows, order) if order else sk.stored_shape(rows)
    if tenants is None:
        new = cut_lineage(new)
        tenants = new.select(sk.TENANT).distinct()
    elif not isinstance(tenants, DataFrame):
        tenants = spark.createDataFrame([(int(t),) for t in tenants], f"{sk.TENANT} bigint")
    folder = _new_folder()
    _write(new, f"{path}/{DATA}/batch={folder}")
    tenants.select(F.col(sk.TENANT).cast("bigint").alias(sk.TENANT)).distinct().write.parquet(f"{path}/{DROPPED}/list={folder}")
    return commit(spark, path, lambda s: replace(s, batches={**s.batches, folder: s.version + 1}, dropped={**s.dropped, folder: s.version + 1}))


def delete_tenant(spark: SparkSession, path: str, tenant) -> int:
    """Remove one tenant."""
    return replace_tenants(spark, path, spark.createDataFrame([], "user_id bigint, store_id string, date date, sales double"), [tenant])


def _versioned(spark: SparkSession, path: str, kind: str, part: str, ordinals: dict[str, int], schema: str) -> DataFrame:
    """Rows of the named folders with their ordinal."""
    if not ordinals:
        return spark.createDataFrame([], f"{schema}, __ordinal int")
    names = F.create_map(*[F.lit(x) for pair in ordinals.items() for x in pair])
    read = spark.read.schema(f"{schema}, {part} string").option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/{part}={f}" for f in ordinals])
    return read.withColumn("__ordinal", F.element_at(names, F.col(part))).drop(part)


def rows_at(spark: SparkSession, path: str, s: State) -> DataFrame:
    """The stored rows of a state: the last version of each key, without what replacements have dropped."""
    rows = _versioned(spark, path, DATA, "batch", s.batches, SCHEMA)
    if s.dropped:
        gone = _versioned(spark, path, DROPPED, "list", s.dropped, f"{sk.TENANT} bigint").groupBy(sk.TENANT).agg(F.max("__ordinal").alias("__gone"))
        rows = rows.join(gone, sk.TENANT, "left").where(F.col("__gone").isNull() | (F.col("__ordinal") >= F.col("__gone"))).drop("__gone")
    if len(s.batches) > 1:  # a batch alone has one row per key
        keys = [*sk.STORED_KEY, *sk.PARTITION]
        rest = [c for c in sk.STORED_COLUMNS if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("__ordinal")).alias("__row")).select(*keys, "__row.*")
    return rows.select(*sk.STORED_COLUMNS, *sk.PARTITION)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of now, with its partition columns."""
    return rows_at(spark, path, state(spark, path))


def compact(spark: SparkSession, path: str) -> int:
    """Fold all batches into one. Uploads that are committed meanwhile stay on top of it."""
    seen = state(spark, path)
    if len(seen.batches) < 2 and not seen.dropped:
        return seen.version
    folder = _new_folder()
    _write(rows_at(spark, path, seen), f"{path}/{DATA}/batch={folder}")

    def change(s: State) -> State | None:
        if not set(seen.batches) <= set(s.batches):
            return None  # another compaction has folded them
        later = {f: n for f, n in s.batches.items() if f not in seen.batches}
        dropped = {f: n for f, n in s.dropped.items() if f not in seen.dropped}
        return replace(s, batches={folder: seen.version, **later}, dropped=dropped)

    return commit(spark, path, change)


def vacuum(spark: SparkSession, path: str, after_hours: float = VACUUM_AFTER_HOURS) -> list[str]:
    """Remove folders that the newest commit doesn't name, and older commits, once they are ``after_hours`` old."""
    import time

    s, removed = state(spark, path), []
    limit = (time.time() - after_hours * 3600) * 1000
    keep = {(DATA, f"batch={f}") for f in s.batches} | {(DROPPED, f"list={f}") for f in s.dropped} | {(COMMITS, f"{s.version:012d}.json")}
    for kind in (DATA, DROPPED, COMMITS):
        folder, fs = _path(spark, f"{path}/{kind}")
        for x in fs.listStatus(folder) if fs.exists(folder) else []:
            name = x.getPath().getName()
            newer = kind == COMMITS and name.endswith(".json") and not name.startswith(".") and int(name.removesuffix(".json")) > s.version
            if (kind, name) not in keep and not newer and x.getModificationTime() <= limit:
                fs.delete(x.getPath(), True)
                removed.append(f"{kind}/{name}")
    return removed
