"""Sinks: snapshots that swap in whole, appends with gap-free numbers, sheets with a fixed header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .views import sequence

#: The columns of an exported sheet, in order.
SHEET = ["id", "name", "status", "source", "score", "found_at"]


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write beside the table and rename, so that readers see the old or the new table, never a part."""
    spark = df.sparkSession
    jvm = spark._jvm
    new, old, at = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.next", f"{path}.last", path))
    df.write.mode("overwrite").parquet(f"{path}.next")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def append_entries(stored: DataFrame | None, new: DataFrame, path: str, job: str = "job_id", order: tuple = ("ts", "event_id")) -> None:
    """Append new entries, numbered on from each job's last stored one."""
    numbered = sequence(new, job, order)
    if stored is not None:
        last = stored.groupBy(job).agg(F.max("sequence").alias("__last"))
        numbered = numbered.join(last, job, "left").withColumn("sequence", F.coalesce("__last", F.lit(0)) + F.col("sequence")).drop("__last")
    numbered.write.mode("append").parquet(path)


def sheet_rows(records: DataFrame) -> DataFrame:
    """Records in the sheet's columns as text; dates without times, nulls empty."""
    return records.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SHEET])


def check_header(columns: list[str]) -> None:
    """A sheet whose header differs must not be appended to."""
    if list(columns) != SHEET:
        raise ValueError(f"header is {columns}, not {SHEET}")


def pending(records: DataFrame, sheet: DataFrame) -> DataFrame:
    """Approved records that the sheet lacks: appending these again changes nothing."""
    return records.filter("status = 'APPROVED'").join(sheet.select(F.col("id").cast("long").alias("id")), "id", "left_anti")
