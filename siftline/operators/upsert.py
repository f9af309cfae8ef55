"""Idempotent upserts as joins: plans, merged rows, evidence bookkeeping, parity.

Parquet has no row-level writes, so an upsert is a plan (create, update,
unchanged) and a new snapshot, both from one full outer join on the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order.

    min over a struct would need no sort, but would tie the result to column
    order; AQE cannot split a window's key either, so keys should be selective.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def differs(columns: list[str], left: str, right: str) -> Column:
    """Whether any column differs, nulls being equal to nulls."""
    return reduce(lambda a, b: a | b, [~F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def coalesce_field(old: Column, new: Column) -> Column:
    """The stored value unless it is empty, or a vague date that the new one makes exact."""
    old_, new_ = F.nullif(F.trim(old), F.lit("")), F.nullif(F.trim(new), F.lit(""))
    iso = r"^\d{4}-\d{2}-\d{2}"
    return F.when(old_.isNull(), new_).when(new_.rlike(iso) & ~old_.rlike(iso) & old_.rlike(r"^\d"), new_).otherwise(old_)


def plan(existing: DataFrame, incoming: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """One row per key of either side: key, action (create, update, unchanged, absent)."""
    a, b = existing.alias("a"), incoming.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    action = (
        F.when(F.col(f"a.{key}").isNull(), "create").when(F.col(f"b.{key}").isNull(), "absent").when(differs(compared, "a", "b"), "update").otherwise("unchanged")
    )
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), action.alias("action"))


def snapshot(existing: DataFrame, incoming: DataFrame, key: str, taken: list[str], protected: list[str]) -> DataFrame:
    """The table after the upsert: taken columns from the new row, protected ones as stored."""
    a, b = existing.alias("a"), incoming.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    new = [F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in taken]
    old = [F.when(F.col(f"a.{key}").isNotNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in protected]
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *new, *old)


def observe(observations: DataFrame, key: list[str], value: str, at: str, ordinal: str, count: str) -> DataFrame:
    """Evidence after a batch: first and last seen, summed counts, last non-null value."""
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(at, ordinal, value)))
    return observations.groupBy(*key).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.sum(count).cast("long").alias("seen_count"), last.alias(value)
    )


def parity(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Per compared column and overall, how many keys differ between two final states."""
    a, b = left.alias("a"), right.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key])
    both = a.join(b, on, "full_outer")
    missing = F.col(f"a.{key[0]}").isNull() | F.col(f"b.{key[0]}").isNull()
    counts = [F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) & ~missing).alias(f"{c}_differs") for c in columns]
    return both.agg(F.count_if(missing).alias("missing"), *counts)


def reconcile(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """append where wanted but absent, delete where present but unwanted, else noop."""
    a, b = wanted.select(F.col(key).alias("w")), present.select(F.col(key).alias("p"))
    both = a.join(b, F.col("w") == F.col("p"), "full_outer")
    action = F.when(F.col("p").isNull(), "append").when(F.col("w").isNull(), "delete").otherwise("noop")
    return both.select(F.coalesce("w", "p").alias(key), action.alias("action"))


def latest_status(log: DataFrame, key: str, status: str, order: list[str]) -> DataFrame:
    """The last status of each key in an action log: an aggregate, so no sort is needed."""
    return log.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))
