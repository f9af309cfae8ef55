"""Entity resolution: blocking keys, star edges, components, and ordered merging.

Records are linked through equal keys of several kinds.  Within a key every
record links to the key's smallest ordinal, so edges are linear in records, and
components come from hooking and contraction.  Merging inside a component takes
each field from the most trusted record that has it, ties going to the earliest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.storage import discard, materialize


def blocking_edges(keys: DataFrame) -> DataFrame:
    """keys (ordinal, kind, key) to star edges (a, b), a being a key's smallest ordinal."""
    known = keys.filter("key IS NOT NULL AND key <> ''")
    first = known.groupBy("kind", "key").agg(F.min("ordinal").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return known.join(first, ["kind", "key"]).filter("ordinal <> a").select("a", F.col("ordinal").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", node: str = "ordinal", root: str = "root") -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    In each round every node hooks to its smallest neighbour (or itself), hooks
    are followed twice more, and the edges are rewritten to the hooks and made
    distinct.  Each round at least removes every node that has a smaller
    neighbour, so long chains and stars both shrink geometrically.  What a hub
    gathers is a minimum, taken before the shuffle as far as possible.
    """
    pair = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    pair = materialize(pair.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = None
    while not pair.isEmpty():
        both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "hooks")
        hook = first
        for _ in range(2):
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, "p").select("u", F.col("q").alias("p"))
        hook = materialize(hook, "hooks")
        before = labels
        if labels is None:
            labels = materialize(hook.select(F.col("u").alias(node), F.col("p").alias(root)), "labels")
        else:
            up = hook.select(F.col("u").alias(root), F.col("p").alias("__p"))
            labels = materialize(labels.join(up, root, "left").select(node, F.coalesce("__p", root).alias(root)), "labels")
        left = hook.select("u", F.col("p").alias("pu"))
        right = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        rest = pair.join(left, "u").join(right, "v").filter("pu <> pv")
        rest = materialize(rest.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        discard(pair, first, hook, *([before] if before is not None else []))
        pair = rest
    discard(pair)
    if labels is None:
        return edges.sparkSession.createDataFrame([], f"{node} long, {root} long")
    return labels


def resolve(records: DataFrame, keys: DataFrame, fields: list[str], authority: str = "authority") -> DataFrame:
    """One row per entity: root, members, and each field from its best record.

    The best record of a field is the one with the highest authority among those
    that have the field, the earliest of equals; this is an aggregate with
    partial sums, so a large entity does not meet in one task.
    """
    roots = components(blocking_edges(keys))
    named = records.join(roots, "ordinal", "left").withColumn("root", F.coalesce("root", "ordinal"))
    best = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(authority), -F.col("ordinal")))).alias(c) for c in fields]
    return named.groupBy("root").agg(F.count(F.lit(1)).alias("members"), *best)


def growth(steps: DataFrame, step: str, identity: str) -> DataFrame:
    """Per step: new identities, the running total, and steps in a row without growth.

    The windows run over one row per step: the number of steps of a crawl, not of
    its records, bounds what meets in a task.
    """
    first = steps.groupBy(identity).agg(F.min(step).alias("first"))
    new = first.groupBy(F.col("first").alias(step)).agg(F.count(F.lit(1)).alias("new"))
    every = steps.select(step).distinct().join(new, step, "left").fillna(0, ["new"])
    w = Window.orderBy(step)
    every = every.withColumn("total", F.sum("new").over(w)).withColumn("__island", F.sum((F.col("new") > 0).cast("int")).over(w))
    dry = F.sum((F.col("new") == 0).cast("long")).over(Window.partitionBy("__island").orderBy(step))
    return every.withColumn("dry_steps", dry).drop("__island")
