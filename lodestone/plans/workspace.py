"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import shutil
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder and runs in one process, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/lodestone"
#: A side of a join is broadcast up to so many rows, and bytes of them as JSON; both are measured before.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 64 << 20


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where it lies, whatever folder the session was started in."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def rest_executors(spark: SparkSession) -> None:
    """Collect garbage in the executors, which then give unused heap back to the system: a heap that one step has filled
    else stays beside the Python workers of the next. One task for every core; nothing depends on where they run."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


def give_back() -> None:
    """Return this process's freed memory to the system. Idle Python workers are kept for later steps, and would keep
    the most that a task ever took."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def giving_back(run):
    """A function over batches that gives freed memory back at the end of its task."""

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


class Workspace:
    """A folder of its own below spark.checkpoint.dir for an operator's intermediate tables.

    A written table cuts lineage and outlives the executor that wrote it. drop() removes tables that nothing reads
    any more; what the returned DataFrame reads stays until the folder is emptied by its owner (a folder of our own, at
    the end of the process).
    """

    def __init__(self, spark: SparkSession, label: str):
        reach_workers(spark)
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        self.spark, self.path = spark, f"{(given or LOCAL_CHECKPOINTS).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        if not given:
            atexit.register(shutil.rmtree, self.path, ignore_errors=True)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table of this folder and read it back."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps now: it does so when the driver collects their plans,
        which may else be after the operator's end."""
        gc.collect()
        self.spark._jvm.System.gc()

    def local_path(self, name: str) -> str | None:
        """The folder as a path that every executor can open, where the shared folder is a mounted file system."""
        at = urlparse(self.path)
        return f"{at.path}/{name}" if at.scheme in ("", "file") else None


def size_checked(small: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if it has at most limit rows and most_bytes bytes; else as it is. No more than
    limit + 1 rows are looked at."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns])))
    rows, size = small.limit(limit + 1).select(width.alias("width")).agg(F.count("*"), F.sum("width")).first()
    return F.broadcast(small) if rows <= limit and (size or 0) <= most_bytes else small
