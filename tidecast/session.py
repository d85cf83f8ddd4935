"""Session helpers.

Library code only *reads* the session. ``local_session`` exists for tests,
``bench.py`` and the driver contract; on a cluster the caller passes its own
session in and the settings below come from the cluster configuration.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tidecast") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", os.environ.get("TIDECAST_SESSION_TZ", "UTC"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDECAST_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset
    and everything runs on this machine (local tests) is a scratch folder created
    and registered; it goes when the process ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tidecast-ckpt-", dir="/tmp")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def target_parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)


#: Rows of a task of an iterative fit, at least: a calendar's worth of rows stays in a few tasks.
TASK_ROWS = 2_000


def fit_tasks(counted: DataFrame) -> int:
    """Tasks of an iterative fit on as many rows as ``counted`` has: one for each core, fewer if rows are few.

    Every task of a forest's pass makes and shuffles the figures of all nodes, however few its rows are, so more tasks
    than cores only add to that. Rows are counted up to what fills the cores; scans end early.
    """
    cores = counted.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, -(-counted.limit(cores * TASK_ROWS).count() // TASK_ROWS)))


#: Rows of a partition of a fit, at most: a partition is cached, evicted and read back whole, so it must not grow with the table.
PART_ROWS = 500_000


def fit_parts(spark: SparkSession, rows: int) -> int:
    """Partitions to keep a fit's rows in: as many as ``fit_tasks``, and a multiple of it where a core's share passes ``PART_ROWS``.

    A pass takes several of them in one task (``coalesce``), as every task of it makes and shuffles the figures of all nodes.
    """
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    return tasks * max(1, -(-rows // (tasks * PART_ROWS)))


def ensure_parallelism(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Spread the input of an iterative, CPU-heavy fit evenly over the cluster's cores, if it is large enough.

    One bounded count (of ``counted``, a plainer table with the same rows, if given) and one round-robin shuffle, paid once:
    the caller persists the result and every training pass reads it. (Asking a shuffled DataFrame for its partition count
    would make AQE run its stages just to answer, and the fit would then compute them again.)
    """
    return df.repartition(fit_tasks(df if counted is None else counted))
