"""Making this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import lexmill

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Short rows, of a few numbers, in a file of a checkpoint.
ROWS = 250_000


def ship(spark: SparkSession) -> None:
    """Send the package to the executors through Spark's own file server, once per context.

    The workers of a cluster need not share a folder or a PYTHONPATH with the driver then. Arrow batches of
    texts are held to 16 MB unless the session has a size of its own, which bounds a worker's memory.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH, None) == "67108864b":  # the default
        spark.conf.set(BATCH, "16m")
    if getattr(sc, "_lexmill_shipped", False):
        return
    top = Path(lexmill.__file__).parent
    path = os.path.join(tempfile.mkdtemp(), "lexmill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f"lexmill/{f.relative_to(top)}")
    sc.addPyFile(path)
    sc._lexmill_shipped = True


def local_session(cores: str = "*", **settings: str) -> SparkSession:
    """A session for tests and small runs; a cluster's own settings win where it has some."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lexmill")
    defaults = {
        "spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (defaults | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def spread(df):
    """Give every core a share when the scan has fewer splits than there are cores.

    A table of many row groups passes unchanged, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share for tables of a job: spark.checkpoint.dir; beside the warehouse where a local session has none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints")
    return sc.getCheckpointDir()


def tasks(spark: SparkSession, rows: int) -> int:
    """How many tasks, and so files, that many short rows take: one for each ROWS, and one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, rows // ROWS + 1)


def cut(df, rows: int | None = None):
    """Write the rows to the shared checkpoint folder, so that a lost executor costs no recomputation.

    rows: at most how many there are, short ones that come out of a shuffle. They go to as many files as that
    takes, not to one for each shuffle partition: a file costs a task and calls to the file system, which for
    a local folder are processes that the executor starts, however few rows it holds.
    """
    scratch(df.sparkSession)
    return (df if rows is None else df.coalesce(tasks(df.sparkSession, rows))).checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a job's scratch tables through Spark's own file systems."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
