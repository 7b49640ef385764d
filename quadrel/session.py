"""Making this package importable on the executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set = set()
#: Arrow batches to Python, at most: what a worker and its JVM side hold at once stays small.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application; workers need not share the driver's path.

    Also lowers the session's byte limit of Arrow batches, if it has its default.
    """
    if spark.conf.get(BATCH_KEY, f"{BATCH_DEFAULT}b").rstrip("bB") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quadrel-ship-")
    target = os.path.join(folder, "quadrel-package.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    # Executors fetch the file from the driver until the application ends.
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own;
    on a cluster the setting is required, because a machine-local folder
    would be lost to the other executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quadrel-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def many_tasks(spark: SparkSession) -> int:
    """Number of tasks for rows that take Python long.

    Named counts hold, where adaptive plans would put tasks together by
    their bytes, down to one a core, and cores wait for the longest.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 6 * spark.sparkContext.defaultParallelism)


def give_back() -> None:
    """Hand what this process has freed back to the machine; allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with the package at hand on the executors.

    Workers outlive their tasks, and so would the memory that a task has freed.
    """
    ship(df.sparkSession)

    def task(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)
