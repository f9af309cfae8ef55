"""Embedding near-duplicates by spherical k-means cells and blocked cosines.

Equal vectors of a label are one class with a multiplicity.  A label's classes
are one cell to begin with.  Every cell of more than twice ``per_cell`` classes is
split by spherical k-means, fitted inside a task on a bounded sample of that very
cell, and so on until cells are small: the number of cells grows with the
vectors and with the labels, and no centroid passes through the driver.

A split gives each class a home among the new cells.  A vector within reach of
another cell's border is also shown there: y can link to x and live in cell d only
if (c - d).x <= |c - d| * sqrt(2 - 2 * least) for x's own centroid c, so showing x
in the lower-numbered such cells loses no link, and counting a pair only where one
of the two is at home counts it once.

Within a cell classes are dealt into blocks of bounded size and blocks are
compared pairwise by matrix products in double precision.  A comparison returns
how many vectors each class links with, and a spanning forest of the links; the
pairs themselves are never emitted.  Components of the forest are the groups and
their smallest identifiers stay.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and vectors with a null label, link with nothing; vectors of
different lengths do not link; vectors of any length are compared whole.  Rows
that repeat an identifier count as vectors of their own.  A null identifier has a
null component.  An empty table gives no rows; other columns are not returned, so
their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .graph import connected_components

BLOCK = 2048
#: How often a cell may be split; cells that still are large are compared block by block all the same.
LEVELS = 5


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centroids of the unit rows of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-12, total / np.maximum(size, 1e-12), c)
    return c


def unit(v) -> np.ndarray:
    x = np.asarray(v, np.float64)
    # scaling first keeps squares of very large or small components finite
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def _rows(packed) -> np.ndarray:
    """A column of equally long packed vectors as a matrix."""
    cuts = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    flat = np.frombuffer(packed.buffers()[2], np.uint8)[cuts[0] : cuts[-1]]
    return flat.view(np.float64).reshape(len(packed), -1)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges between node numbers a and b."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        r = i
        while (p := parent.get(r, r)) != r:
            r = p
        while i != r:
            parent[i], i = r, parent.get(i, i)
        return r

    kept = []
    for i, j in zip(a.tolist(), b.tolist()):
        u, v = root(i), root(j)
        if u != v:
            parent[max(u, v)] = min(u, v)
            kept.append((i, j))
    return kept


def _fitted(per_cell: int, sample: int):
    """One cell's sample to its centroids."""

    def fitted(key, cell):
        import pyarrow as pa

        x = _rows(cell["v"].combine_chunks())
        k = max(2, min(-(-cell["n"][0].as_py() // per_cell), max(2, sample // 8), len(x)))
        c = spherical_kmeans(x, k)
        return pa.table({
            "label": pa.array([key[0].as_py()], pa.string()), "w": pa.array([key[1].as_py()], pa.int32()),
            "cell": pa.array([key[2].as_py()], pa.string()), "c": pa.array([c.tobytes()], pa.binary()),
        })

    return fitted


_SHOWN = "label string, w int, cell string, id long, m long, away int, v binary"


def _split(level: int, least: float):
    """Rows of a cell, with its centroids, to rows of the new cells."""
    reach = float(np.sqrt(2 - 2 * least)) + 1e-9

    def split(rows, centroids):
        import pyarrow as pa

        if not rows.num_rows or not centroids.num_rows:
            return rows.select([f.split()[0] for f in _SHOWN.split(", ")])
        x = _rows(rows["v"].combine_chunks())
        c = np.frombuffer(centroids["c"][0].as_py(), np.float64).reshape(-1, x.shape[1])
        gap = reach * np.linalg.norm(c[:, None] - c[None], axis=2)
        number = np.arange(len(c))
        of, cell, away = [], [], []
        for i in range(0, len(x), 1024):
            s = x[i : i + 1024] @ c.T
            home = s.argmax(1)
            at = np.arange(len(s))
            shown = (s[at, home][:, None] - s <= gap[home]) & (number[None] < home[:, None])
            shown[at, home] = True
            r, d = np.nonzero(shown)
            of.append(r + i), cell.append(d), away.append(d != home[r])
        of, cell, away = map(np.concatenate, (of, cell, away))
        was = rows["away"].to_numpy()[of]
        taken = rows.take(pa.array(of))
        path = rows["cell"][0].as_py()
        names = pa.array([f"{path}.{d}" for d in range(len(c))], pa.string())
        return pa.table({
            "label": taken["label"], "w": taken["w"], "cell": names.take(pa.array(cell)), "id": taken["id"], "m": taken["m"],
            "away": pa.array(was | (away.astype(np.int32) << level), pa.int32()), "v": taken["v"],
        })

    return split


def cells(shown: DataFrame, least: float, per_cell: int, sample: int) -> DataFrame:
    """Split cells until each holds about per_cell classes, where splitting halves the comparisons.

    Vectors without clusters lie within reach of most borders: a split that leaves
    more than half of the pairs to compare is undone, and the cell stays whole.
    """
    key, columns = ["label", "w", "cell"], [f.split()[0] for f in _SHOWN.split(", ")]
    for level in range(LEVELS):
        big = shown.filter("NOT cell LIKE '%!'").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * per_cell)
        big = materialize(big, "large")
        if big.isEmpty():
            discard(big)
            break
        # what is hot in these joins AQE splits: the groups behind them are dealt by more than the cell
        rows = shown.join(big, key, "left")
        whole = rows.filter("n IS NOT NULL")
        u = F.pmod(F.xxhash64("v", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
        seen = whole.filter(u <= F.lit(float(sample)) / F.col("n")).groupBy(*key).applyInArrow(_fitted(per_cell, sample), "label string, w int, cell string, c binary")
        parts = F.ceil(F.col("n") / (8.0 * BLOCK))
        fitted = seen.join(big, key).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).select(*key, "part", "c")
        dealt = whole.withColumn("part", F.pmod(F.xxhash64("id", "v", F.lit(level)), parts))
        moved = dealt.groupBy(*key, "part").cogroup(fitted.groupBy(*key, "part")).applyInArrow(_split(level, least), _SHOWN)
        moved = materialize(moved, "split")
        parent = F.regexp_replace("cell", "[.][0-9]+$", "")
        work = moved.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("label", "w", parent.alias("cell")).agg(F.sum(F.col("k") * F.col("k")).alias("work"))
        paid = materialize(work.join(big, key).filter("work <= 0.5 * n * n").select(*key), "paid")
        kept = moved.withColumn("__cell", parent).join(paid.select("label", "w", F.col("cell").alias("__cell")), ["label", "w", "__cell"], "left_semi").select(*columns)
        undone = whole.join(paid, key, "left_anti").withColumn("cell", F.concat("cell", F.lit("!"))).select(*columns)
        shown, before = materialize(rows.filter("n IS NULL").select(*columns).unionByName(kept).unionByName(undone), "cells"), shown
        discard(before, big, moved, paid)
    return shown


def _compared(least: float):
    """Two blocks, or one against itself: links by class and a spanning forest."""

    @F.arrow_udf("links array<struct<id:long,n:long>>, tree array<struct<a:long,b:long>>")
    def compared(lists):
        import pyarrow as pa

        rows, cuts, members = lists.offsets.to_numpy(), lists.values.offsets.to_numpy(), lists.values.values
        ids, m, away = (members.field(name).to_numpy() for name in ("id", "m", "away"))
        v, links, trees = members.field("v"), [], []
        for i in range(len(lists)):
            low, high = rows[i], rows[i + 1] - 1
            a, b = slice(cuts[low], cuts[low + 1]), slice(cuts[high], cuts[high + 1])
            same = low == high
            x = _rows(v[a])
            y = x if same else _rows(v[b])
            left, right = [], []
            n_a, n_b = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            for j in range(0, len(x), 512):
                hit = x[j : j + 512] @ y.T >= least
                r, c = np.nonzero(hit)
                keep = (r + j < c) if same else np.ones(len(r), bool)
                r, c = r[keep] + j, c[keep]
                keep = away[a][r] & away[b][c] == 0
                r, c = r[keep], c[keep]
                np.add.at(n_a, r, m[b][c])
                np.add.at(n_b, c, m[a][r])
                left.append(r), right.append(c)
            if same:
                n_a, n_b = n_a + n_b, n_b[:0]
            counts = [(k, n) for side, more in ((ids[a], n_a), (ids[b], n_b)) for k, n in zip(side[: len(more)][more > 0].tolist(), more[more > 0].tolist())]
            links.append([{"id": k, "n": n} for k, n in counts])
            tree = _forest(ids[a][np.concatenate(left)], ids[b][np.concatenate(right)])
            trees.append([{"a": p, "b": q} for p, q in tree])
        longs = pa.int64()
        return pa.StructArray.from_arrays(
            [pa.array(links, pa.list_(pa.struct([("id", longs), ("n", longs)]))), pa.array(trees, pa.list_(pa.struct([("a", longs), ("b", longs)])))],
            ["links", "tree"],
        )

    return compared


def near_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = 0.98, per_cell: int = 2048, sample: int = 8192,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    About `sample` vectors of a cell are read to fit its split; every vector is
    indexed and every link within a label is found.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    good = F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce(good & F.exists("e", lambda x: x != 0), F.lit(False))
    # the class's node is its smallest identifier; classes without any are nodes below zero
    classes = rows.filter(good).groupBy("label", "e").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m"))

    @F.arrow_udf("binary")
    def packed(vectors):
        import pyarrow as pa

        return pa.array([unit(v).tobytes() for v in vectors.to_pylist()], pa.binary())

    node = F.coalesce("first", F.bitwise_not(F.shiftrightunsigned(F.xxhash64("label", "e"), 1)))
    classes = materialize(classes.select("label", "e", node.alias("id"), "m"), "classes")
    shown = classes.select("label", F.size("e").alias("w"), F.lit("").alias("cell"), "id", "m", F.lit(0).alias("away"), packed("e").alias("v"))
    shown = cells(materialize(shown, "vectors"), least, per_cell, sample)

    key = ["label", "w", "cell"]
    counts = shown.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = shown.join(counts, key).withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), F.col("blocks")))
    lists = dealt.groupBy(*key, "blocks", "block").agg(F.collect_list(F.struct("id", "m", "away", "v")).alias("list"))
    sides = lists.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sides = sides.groupBy(*key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list("list").alias("lists"))
    found = materialize(sides.filter("i = j OR size(lists) = 2").select(_compared(least)("lists").alias("x")).select("x.*"), "compared")
    discard(shown)

    links = found.select(F.explode("links").alias("l")).select("l.*").groupBy("id").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.explode("tree").alias("t")).select("t.*"))
    named = classes.select("label", "e", "id", "m").join(links, "id", "left").join(labels.withColumnRenamed("node", "id"), "id", "left")
    named = named.select(
        F.col("label").alias("__l"), F.col("e").alias("__e"),
        (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("c"),
    )
    named = named.filter("links > 0")
    out = rows.join(named, (F.col("label") == F.col("__l")) & (F.col("e") == F.col("__e")), "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("c") >= 0, F.col("c")).otherwise(F.col("id")))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )


def keep_one(df: DataFrame, id_col: str = "vec_id", **options) -> DataFrame:
    """The input with one vector of each group, columns unchanged."""
    gone = near_vectors(df, id_col, **options).filter("NOT kept").select(F.col(id_col).alias("__gone")).distinct()
    return df.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
