"""Session settings, and the shared folder for tables that a job writes for itself."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    # timestamp arithmetic goes through the session zone
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a hot order, line or location is split over tasks, also where that costs one more shuffle further on
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # the large side of a selective join is filtered before its shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # what a task reads, and with it what it sorts and groups in memory, stays the same however large the tables are
    "spark.sql.files.maxPartitionBytes": "16MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set what the metrics rely on. Cores and memory stay as the cluster has them."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def stored_bytes(spark: SparkSession, paths: Iterable[str]) -> int:
    """The size of the files or folders that are there, in any file system that Spark knows."""
    total = 0
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        total += system.getContentSummary(path).getLength() if system.exists(path) else 0
    return total


def size_shuffles(spark: SparkSession, shuffled_bytes: int, task_bytes: int = 256 << 20) -> int:
    """Start large shuffles with enough partitions that one fits a task's memory; adaptive execution merges small ones.

    ``shuffled_bytes`` is the size of the largest shuffle, for a full build of the stored joins about the uncompressed
    size of the release-line columns in use. The setting is only ever raised.
    """
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shuffled_bytes // task_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return partitions


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each action go when it ends; else they stay until the driver collects garbage.

    For jobs of many steps whose results are stored: no later one reads those files.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def local_session(cpus: str = "8", name: str = "ordergauge") -> SparkSession:
    """A session on this machine alone, for tests and the benchmark; its shared folder is a temporary one."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        # without it each column function looks up the session and its own call site, most of the time that a plan takes
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_folder(spark: SparkSession) -> str | None:
    """A new sub-folder of ``spark.checkpoint.dir``, which every executor can read; None without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return f"{root.rstrip('/')}/ordergauge-{uuid.uuid4().hex}" if root else None


def work_folder(spark: SparkSession) -> str:
    """As ``shared_folder``; without the setting a temporary folder if the session runs on this machine alone."""
    folder = shared_folder(spark)
    if folder is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or f"{tempfile.mkdtemp(prefix='run-', dir='/tmp')}/work"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``shared_folder`` named, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
