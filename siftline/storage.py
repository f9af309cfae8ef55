"""Shared storage for intermediate tables: written once, read back, deleted when nothing needs them."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor sees; one of our own only in local mode and where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_root(spark)}/siftline-{uuid.uuid4().hex}/{tag}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts lineage: what follows reads replicated files, so a lost executor
    costs a few tasks and never the stages above.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    # the plan runs this once, so its shuffle files can go as soon as it has ended
    # instead of staying on the executors' disks until the driver collects it
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._siftline_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where.getParent(), True)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        _written.remove(df._siftline_path)
        _delete(df.sparkSession, df._siftline_path)


def settle(spark: SparkSession) -> None:
    """Let go of what finished jobs leave on the driver.

    Spark frees broadcasts, shuffle files and generated classes only once the driver's
    JVM has collected their handles, and a JVM with room to spare does not collect.
    """
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    spark._jvm.java.lang.System.gc()


def release(spark: SparkSession) -> None:
    """Delete all that materialize() wrote; call it once results have been stored."""
    while _written:
        _delete(spark, _written.pop())
