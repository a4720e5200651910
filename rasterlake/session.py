"""Session settings and the checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster passes in its own.

    Workers of a local session import the package from here; a cluster ships it (see the README).
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("rasterlake")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEM", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a session on one machine gets a temporary folder; a cluster is refused, because each
    executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.conf.get("spark.master", spark.sparkContext.master)
    if not one_machine(master):
        raise RuntimeError(f"name a folder that all executors share in spark.checkpoint.dir (master {master})")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python in batches of at most ``rows``: a batch and its copies then stay small beside the heap.

    The setting holds for the session; one that the session was started with is left alone.
    """
    if spark.sparkContext.getConf().get(ARROW_ROWS) is None and int(spark.conf.get(ARROW_ROWS)) > rows:
        spark.conf.set(ARROW_ROWS, str(rows))


STATIC_BROADCAST, MEASURED_BROADCAST = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def measured_joins(spark: SparkSession) -> None:
    """Broadcast a table for its measured size, not for the size of its files.

    Pixel tables are a small part of their size in Parquet and an array column counts as one element, so a join planned by
    files sends hundreds of megabytes through the driver. Adaptive execution measures both sides behind their exchange and
    still broadcasts a small one. Settings that the session was started with are left alone.
    """
    given = spark.sparkContext.getConf()
    if given.get(STATIC_BROADCAST) is None and spark.conf.get("spark.sql.adaptive.enabled") == "true" and spark.conf.get(STATIC_BROADCAST) != "256KB":
        if given.get(MEASURED_BROADCAST) is None:
            spark.conf.set(MEASURED_BROADCAST, "1MB")
        spark.conf.set(STATIC_BROADCAST, "256KB")


INITIAL, ADVISORY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def small_tasks(spark: SparkSession, partitions: int = 1024, size: str = "8MB") -> None:
    """Deal exchanges into many partitions, which adaptive execution joins again up to ``size`` as measured.

    Windows hold several copies of their rows for sorting, about a hundred times what a compressed pixel takes in a shuffle,
    so a fixed number of partitions lets the memory of a task grow with the table. Settings that the session was started
    with are left alone.
    """
    given = spark.sparkContext.getConf()
    if given.get(INITIAL) is None and spark.conf.get(INITIAL, None) is None:
        spark.conf.set(INITIAL, str(max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))))
        if given.get(ADVISORY) is None:
            spark.conf.set(ADVISORY, size)


def one_machine(master: str) -> bool:
    """Whether executors run in the driver's process."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


_RECORDS: list[list[str]] = []


@contextmanager
def recorded():
    """The folders that ``cut`` writes inside the block, for a later ``release``."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS.remove(paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing will read again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        p = hadoop(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    The files outlive any executor, so a later stage never recomputes a sampled
    range partitioning or an iteration. A written table counts with the size of
    its files, a checkpointed RDD with the estimate of the plan it came from, which
    grows as the product of all joins of an iteration. Files may be a small part of
    the rows they hold, so joins go by measured sizes (``measured_joins``).
    """
    spark = df.sparkSession
    measured_joins(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rasterlake-{uuid.uuid4().hex}"
    for paths in _RECORDS:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
