"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition becomes one run: its texts' digests, sorted, each with the
best identifier and the number of rows.  Runs are then merged in rounds.  Nodes
are numbered in base ``fan_in``; in round r the nodes that differ only in digit
r exchange parts, each taking the digests whose r-th digit is its own, so that
after log(nodes) rounds every node holds a disjoint share of the digests, merged
from all runs (with fan_in 2 this is the binomial exchange).  At every level
equal digests collapse, so a text that fills a third of the table is at most one
row per run to begin with and at most fan_in rows per node later.

Digests are SHA-256 sorted by their first 64 bits; rows merge only when the full
digest and the byte length agree, which is the verification.

The verdicts travel back the same way: first to the runs (one row per run and
digest), then from each run to its own rows, so a hot text is dealt over as many
keys as there are runs.

Defined results: texts of any length are digested whole; other columns play no
part, so their names cannot clash; an empty table gives no rows.  A null text is an
empty text, and empty texts are copies of
each other.  A null identifier is worse than any other.  Rows that repeat both
identifier and text share one verdict; ``deduplicate`` keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _digested(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumns({"__sha": F.unhex(F.sha2(text, 256)), "__len": F.octet_length(text), "__id": F.col(id_col)})


def _digit(prefix: Column, level: int, fan_in: int) -> Column:
    """The level-th digit, base fan_in, of a digest's place in the key space."""
    return F.pmod(F.shiftrightunsigned(prefix, 8 + 4 * level) if fan_in == 16 else F.floor(F.shiftrightunsigned(prefix, 8) / float(fan_in**level)), F.lit(fan_in)).cast("int")


def _merge_sorted(keep_largest: bool):
    """A streaming merge of rows sorted by (node, prefix, digest): equal neighbours collapse."""

    def merge(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        carry = None
        for batch in batches:
            # batches may or may not be marked as free of nulls; what is carried over never is
            table = pa.Table.from_arrays(batch.columns, names=batch.schema.names)
            if carry is not None:
                table = pa.concat_tables([carry, table])
            n = table.num_rows
            if n == 0:
                continue
            table = table.combine_chunks()
            new = np.ones(n, bool)
            if n > 1:
                same = None
                for name in ("node", "prefix", "sha", "len"):
                    c = table[name]
                    eq = pc.equal(c.slice(0, n - 1), c.slice(1)).to_numpy(zero_copy_only=False)
                    same = eq if same is None else same & eq
                new[1:] = ~same.astype(bool)
            starts = np.flatnonzero(new)
            ids = table["best"].to_numpy()
            best = (np.maximum if keep_largest else np.minimum).reduceat(ids, starts)
            size = np.add.reduceat(table["size"].to_numpy(), starts)
            out = table.take(pa.array(starts))
            out = out.set_column(out.schema.get_field_index("best"), "best", pa.array(best, pa.int64()))
            out = out.set_column(out.schema.get_field_index("size"), "size", pa.array(size, pa.int64()))
            carry = out.slice(out.num_rows - 1)
            yield from out.slice(0, out.num_rows - 1).to_batches()
        if carry is not None:
            yield from carry.to_batches()

    return merge


_RUN = "node int, prefix long, sha binary, len int, best long, size long"


def tree_merge(runs: DataFrame, nodes: int, fan_in: int = 8, keep: str = "smallest") -> DataFrame:
    """Merge sorted digest runs: rows (node, prefix, sha, len, best, size), node < nodes."""
    levels, span = 0, 1
    while span < nodes:
        span, levels = span * fan_in, levels + 1
    merge = _merge_sorted(keep == "largest")
    for level in range(max(levels, 1)):
        step = fan_in**level
        digit = _digit(F.col("prefix"), level, fan_in)
        here = F.pmod(F.floor(F.col("node") / step), F.lit(fan_in)).cast("int")
        runs = (
            runs.withColumn("node", (F.col("node") + (digit - here) * step).cast("int"))
            # a node's share is dealt over several tasks: the key is the node and a slice of the digest
            .repartition(nodes, F.col("node"), F.pmod(F.col("prefix"), F.lit(7)))
            .sortWithinPartitions("node", "prefix", "sha", "len")
            .mapInArrow(merge, _RUN)
        )
    return runs


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep is "smallest" or "largest": which identifier of equal texts stays.
    """
    spark = df.sparkSession
    largest = keep == "largest"
    nodes = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    worst = -(2**63) if largest else 2**63 - 1
    rows = materialize(
        _digested(df, id_col, text_col).select(
            F.col("__id").cast("long").alias("id"), F.col("__sha").alias("sha"), F.col("__len").alias("len"),
            F.conv(F.substring(F.hex("__sha"), 1, 15), 16, 10).cast("long").alias("prefix"),
            F.pmod(F.spark_partition_id(), F.lit(nodes)).alias("run"),
        ),
        "digests",
    )
    best = (F.max if largest else F.min)(F.coalesce("id", F.lit(worst)))
    level0 = rows.groupBy("run", "prefix", "sha", "len").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    merged = tree_merge(level0.select(F.col("run").alias("node"), "prefix", "sha", "len", "best", "size"), nodes, fan_in, keep)
    # back down: to the runs that hold a digest, then to each run's rows; only texts with copies need it
    found = merged.filter("size > 1").select("prefix", "sha", "len", F.col("best").alias("keep"), F.col("size").alias("total"))
    down = level0.select("run", "prefix", "sha", "len").join(found, ["prefix", "sha", "len"])
    out = rows.join(down, ["run", "prefix", "sha", "len"], "left")
    keep_id = F.when(F.col("total").isNull(), F.col("id")).when(F.col("keep") != worst, F.col("keep"))
    return out.select(
        F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("total", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The input without copies, columns unchanged; of rows that repeat id and text one stays."""
    kept = exact_groups(df, id_col, text_col, keep).filter("kept").groupBy(id_col, "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    kept = materialize(kept.select(F.col(id_col).alias("__kid"), F.col("text_sha256").alias("__khex"), F.col("n").alias("__n")), "kept")
    keyed = df.withColumns({"__id": F.col(id_col).cast("long"), "__hex": F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)})
    same = F.col("__id").eqNullSafe(F.col("__kid")) & (F.col("__hex") == F.col("__khex"))
    names = [F.col(f"`{c}`") for c in df.columns]
    single = keyed.join(kept.filter("__n = 1"), same).select(*names)
    if kept.filter("__n > 1").isEmpty():
        return single
    first = [F.first(F.col(f"`{c}`")).alias(c) for c in df.columns]
    again = keyed.join(kept.filter("__n > 1"), same).groupBy("__kid", "__khex").agg(*first).select(*names)
    return single.unionByName(again)
