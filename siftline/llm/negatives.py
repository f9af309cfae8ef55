"""Hard-negative mining over k-means inverted lists with stored radii.

Components are scaled and floored to integers, so that inner products are exact.
Equal vectors of a label are one item that keeps its smallest identifiers, as many
as an answer can name: no answer needs more of them, however many copies there are.
Equal anchors are one query.

Items lie in inverted lists, the cells of a k-means fitted inside a task on a bounded
sample; a list stores its centroid c and its radius r.  By Cauchy-Schwarz no item
of a list scores above q.c + |q| r or below q.c - |q| r against a query q.  A
query visits lists by falling upper bound, in rounds of 8, 64, 512, ... lists; a
list is skipped where its bounds lie outside every window that the query still
has to fill, and a query stops once the upper bound falls strictly below its kth
score.  A search is therefore exact on any data; data without clusters only prune
less.

A round ships a query to the lists it visits and compares blocks of items with
blocks of queries by matrix products.  First every query finds its best items of
its own label; their scores open the windows in which it then looks for items of
other labels.

Defined results: rows with a null label, a null vector, or null or non-finite
components (also after scaling) take no part; vectors of different lengths do not
meet; vectors of any length are compared whole, the empty one scores 0; rows that
repeat an identifier are rows of their own; a null identifier ranks last and is
never an anchor; ties go by identifier; scores beyond 64 bits are ranked exactly
below 2**53 and saturate; an empty table gives no rows; other columns are not
returned, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

LAST = 2**63 - 1  # stands for a null identifier
BLOCK = 4096


def _matrix(packed, w: int) -> np.ndarray:
    """A column of packed vectors, of two or of eight bytes a component, as a matrix."""
    out = np.zeros((len(packed), w))
    for i, raw in enumerate(packed.to_pylist()):
        out[i] = np.frombuffer(raw, np.int16 if len(raw) == 2 * w else np.float64)
    return out


def quantized(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float, *more: Column) -> DataFrame:
    """(id, label, w, v) of the rows that take part; v holds floor(scale * x) of every component."""

    @F.arrow_udf("binary")
    def packed(vectors):
        import pyarrow as pa

        out = []
        for x in vectors.to_pylist():
            y = np.floor(np.asarray(x, np.float64) * scale) + 0.0
            small = not len(y) or np.abs(y).max() < 2**15
            out.append(y.astype(np.int16).tobytes() if small else y.tobytes())
        return pa.array(out, pa.binary())

    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("e"), *more)
    good = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) != float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("e").isNotNull()).filter(F.coalesce(good, F.lit(False)))
    return rows.withColumns({"w": F.size("e"), "v": packed("e")}).drop("e")


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1)[None] - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def _fitted(per_list: int, most: int):
    def fitted(key, rows):
        import pyarrow as pa

        w = key[0].as_py()
        x = _matrix(rows["v"], w)
        c = kmeans(x, max(1, min(most, -(-rows["n"][0].as_py() // per_list), len(x) // 8)))
        return pa.table({"w": pa.array([w], pa.int32()), "c": pa.array([c.tobytes()], pa.binary()), "k": pa.array([len(c)], pa.int32())})

    return fitted


_ITEM = "w int, cell int, label string, ids array<long>, v binary, away double"


def _assigned(items, centroids):
    """Items to their lists, with their distance to the centroid."""
    import pyarrow as pa

    w = centroids["w"][0].as_py()
    c = np.frombuffer(centroids["c"][0].as_py(), np.float64).reshape(centroids["k"][0].as_py(), w)
    x = _matrix(items["v"], w)
    cell = np.concatenate([((c * c).sum(1)[None] - 2 * (x[i : i + BLOCK] @ c.T)).argmin(1) for i in range(0, len(x), BLOCK)] or [np.zeros(0, np.int64)])
    away = np.sqrt(((x - c[cell]) ** 2).sum(1))
    return pa.table({"w": items["w"], "cell": pa.array(cell, pa.int32()), "label": items["label"], "ids": items["ids"], "v": items["v"], "away": pa.array(away)})


def _parts(n: Column) -> Column:
    return F.greatest(F.ceil(n / (4.0 * BLOCK)), F.lit(1).cast("long"))


class Lists:
    """The inverted lists of items (w, label, ids, v): items by list, and per width the centroids and radii."""

    def __init__(self, items: DataFrame, per_list: int, sample: int, most: int):
        sizes = materialize(items.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "sizes")
        dealt = items.join(sizes, "w")
        u = F.pmod(F.xxhash64("v", "label", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
        fitted = dealt.filter((u <= float(sample) / F.col("n")) | (F.col("n") <= sample)).groupBy("w").applyInArrow(_fitted(per_list, most), "w int, c binary, k int")
        # a sample can come out empty where few items are many times the sample: then the width is one list around 0
        fitted = sizes.join(fitted, "w", "left").withColumn("c", F.coalesce("c", F.unhex(F.repeat(F.lit("00"), F.col("w") * 8)))).withColumn("k", F.coalesce("k", F.lit(1)))
        fitted = materialize(fitted, "centroids")
        spread = fitted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _parts(F.col("n")) - 1)))
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("v", F.lit(4)), _parts(F.col("n"))))
        self.items = materialize(dealt.groupBy("w", "part").cogroup(spread.groupBy("w", "part")).applyInArrow(_assigned, _ITEM), "lists")
        radii = self.items.groupBy("w", "cell").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("size"))
        cells = radii.groupBy("w").agg(F.collect_list(F.struct("cell", "r", "size")).alias("cells"))
        self.index = materialize(fitted.drop("n").join(cells, "w"), "index")
        discard(sizes, fitted)


_VISIT = "q long, w int, label string, v binary, lo array<double>, hi array<double>, kth array<double>, cell int, size long, upto int"


def bounds(x: np.ndarray, c: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the items of each list can score at most and at least against each row of x, rounding allowed for."""
    middle, reach = x @ c.T, np.linalg.norm(x, axis=1)[:, None] * r[None]
    slack = 1e-9 * (np.linalg.norm(x, axis=1)[:, None] * (np.linalg.norm(c, axis=1) + r)[None]) + 1e-6
    return middle + reach + slack, middle - reach - slack


def _visited(step: int):
    """Queries to the next lists they visit."""

    def visited(queries, index):
        import pyarrow as pa

        names = [f.split()[0] for f in _VISIT.split(", ")]
        if not queries.num_rows or not index.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, _types())})
        w = index["w"][0].as_py()
        cells = index["cells"][0].as_py()
        number = np.array([x["cell"] for x in cells])
        c = np.frombuffer(index["c"][0].as_py(), np.float64).reshape(-1, w)[number] if w else np.zeros((len(cells), 0))
        r, size = np.array([x["r"] for x in cells]), np.array([x["size"] for x in cells])
        high, low = bounds(_matrix(queries["v"], w), c, r)
        order = np.lexsort((np.broadcast_to(number, high.shape), -high))
        lo, hi, kth, seen = (queries[name].to_pylist() for name in ("lo", "hi", "kth", "seen"))
        of, cell, upto = [], [], []
        for i in range(len(high)):
            at = order[i][seen[i] :]
            up, down = high[i][at][:, None], low[i][at][:, None]
            least = np.maximum(np.array(lo[i]), np.array(kth[i]))[None]
            may = np.flatnonzero(((up >= least) & (down <= np.array(hi[i])[None])).any(1))[:step]
            if len(may):
                of.append(np.full(len(may), i))
                cell.append(at[may])
                upto.append(np.full(len(may), seen[i] + may[-1] + 1))
        of, cell, upto = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (of, cell, upto))
        taken = queries.take(pa.array(of))
        return pa.table({**{n: taken[n] for n in names[:7]}, "cell": pa.array(number[cell], pa.int32()), "size": pa.array(size[cell], pa.int64()), "upto": pa.array(upto, pa.int32())})

    return visited


def _types():
    import pyarrow as pa

    d = pa.list_(pa.float64())
    return [pa.int64(), pa.int32(), pa.string(), pa.binary(), d, d, d, pa.int32(), pa.int64(), pa.int32()]


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products, exact also beyond 2**53."""
    if x.size and y.size and np.linalg.norm(x, axis=1).max() * np.linalg.norm(y, axis=1).max() >= 2**53:
        whole = [np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape) for m in (x, y)]
        s = whole[0] @ whole[1].T
        return np.clip(s, -(2**63), 2**63 - 1025).astype(np.float64)
    return x @ y.T


def _scored(same: bool, k: int):
    """A block of queries against a block of a list: the best k items of every query and window."""

    def scored(visits, items):
        import pyarrow as pa

        out = {"q": [], "t": [], "score": [], "id": [], "own": []}
        if visits.num_rows and items.num_rows:
            w = items["w"][0].as_py()
            x, queries = _matrix(items["v"], w), _matrix(visits["v"], w)
            ids = items["ids"].to_pylist()
            first = np.array([i[0] for i in ids])
            code = {label: n for n, label in enumerate(set(items["label"].to_pylist()))}
            labels = np.array([code[label] for label in items["label"].to_pylist()])
            mine = np.array([code.get(label, -1) for label in visits["label"].to_pylist()])
            q, lo, hi, kth = (visits[name].to_pylist() for name in ("q", "lo", "hi", "kth"))
            for start in range(0, len(queries), 512):
                s = _products(queries[start : start + 512], x)
                for i in range(len(s)):
                    j = start + i
                    meets = (labels == mine[j]) == same
                    for t in range(len(lo[j])):
                        at = np.flatnonzero(meets & (s[i] >= max(lo[j][t], kth[j][t])) & (s[i] <= hi[j][t]))
                        if len(at) > k:
                            at = at[s[i][at] >= np.partition(s[i][at], len(at) - k)[len(at) - k]]
                        for a in at[np.lexsort((first[at], -s[i][at]))[:k]].tolist():
                            own = same and np.array_equal(x[a], queries[j])
                            for one in ids[a][:k]:
                                for name, value in zip(out, (q[j], t, float(s[i][a]), one, own)):
                                    out[name].append(value)
        types = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.bool_())
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), types)})

    return scored


_FOUND = "q long, t int, score double, id long, own boolean"


def search(lists: Lists, queries: DataFrame, k: int, same: bool, first: int = 8, growth: int = 8) -> DataFrame:
    """The best k rows of every query (q, w, label, v, lo, hi) and window: (q, t, score, id, own, rank).

    Rows have the query's label or, if not same, another one, and scores from lo[t] to hi[t].
    """
    state = materialize(queries.withColumns({"kth": F.transform("lo", lambda x: F.lit(float("-inf"))), "seen": F.lit(0)}), "queries")
    sizes = materialize(state.groupBy("w").agg(F.count(F.lit(1)).alias("nq")), "widths")
    asking = sizes.select("w", F.col("nq").alias("asking"))
    index = lists.index.join(asking, "w").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), _parts(F.col("asking")) - 1)))
    best, step = None, first
    top = F.row_number().over(_rank("q", "t"))
    while True:
        dealt = state.join(sizes, "w").withColumn("part", F.pmod(F.xxhash64("q"), _parts(F.col("nq"))))
        visits = materialize(dealt.groupBy("w", "part").cogroup(index.groupBy("w", "part")).applyInArrow(_visited(step), _VISIT), "visits")
        if visits.isEmpty():
            discard(visits)
            break
        blocks = F.ceil(F.col("size") / float(BLOCK))
        queues = visits.groupBy("w", "cell").agg(F.ceil(F.count(F.lit(1)) / float(BLOCK)).alias("queues"))
        key = ["w", "cell", "block", "queue"]
        left = visits.join(queues, ["w", "cell"]).withColumn("queue", F.pmod(F.xxhash64("q", F.lit(6)), F.col("queues"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        blocks_of = visits.groupBy("w", "cell").agg(F.first("size").alias("size")).join(queues, ["w", "cell"])
        right = lists.items.join(blocks_of, ["w", "cell"]).withColumn("block", F.pmod(F.xxhash64("v", F.lit(8)), blocks)).withColumn("queue", F.explode(F.sequence(F.lit(0).cast("long"), F.col("queues") - 1)))
        found = left.drop("size", "queues", "upto").groupBy(*key).cogroup(right.select(*key, "label", "ids", "v").groupBy(*key)).applyInArrow(_scored(same, k), _FOUND)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        before, best = best, materialize(found.withColumn("rank", top).filter(F.col("rank") <= k), "best")
        full = best.filter(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("t", "score"))).alias("full"))
        moved = visits.groupBy("q").agg(F.max("upto").alias("upto"))
        kth = F.transform(F.sequence(F.lit(0), F.size("lo") - 1), lambda t: F.coalesce(F.try_element_at("full", t), F.lit(float("-inf"))))
        # a query without visits has no list left that could add anything
        after = state.drop("kth", "seen").join(moved, "q").join(full, "q", "left").withColumns({"kth": kth, "seen": F.col("upto")}).drop("full", "upto")
        after, was = materialize(after, "queries"), state
        discard(visits, was, *([before] if before is not None else []))
        state, step = after, step * growth
    discard(state, sizes)
    return best if best is not None else queries.sparkSession.createDataFrame([], _FOUND + ", rank int")


def _rank(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("score"), "id")


def hard_negatives(
    df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, per_list: int = 1024, sample: int = 32768, most: int = 1024,
) -> DataFrame:
    """For every anchor row and each of its best `positives` rows of the same label, the best `negatives` other rows
    whose score lies between `low` and `high` hundredths of the positive's: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    The lists' centroids, at most `most` of them and about `per_list` items each, are fitted on about `sample` items;
    every item is indexed and the answers are exact.
    """
    rows = materialize(quantized(df, id_col, vector_col, label_col, scale, F.coalesce(anchors, F.lit(False)).alias("anchor")), "rows")
    item = ["label", "w", "v"]
    keep = max(positives + 1, negatives)
    smallest = rows.withColumn("n", F.row_number().over(Window.partitionBy(*item).orderBy("id"))).filter(F.col("n") <= keep)
    items = materialize(smallest.groupBy(*item).agg(F.sort_array(F.collect_list("id")).alias("ids")), "items")
    lists = Lists(items, per_list, sample, most)
    asked = rows.filter(F.col("anchor") & (F.col("id") != LAST))
    queries = materialize(asked.select(*item).distinct().withColumn("q", F.monotonically_increasing_id()), "asked")

    always = {"lo": F.array(F.lit(float("-inf"))), "hi": F.array(F.lit(float("inf")))}
    best = search(lists, queries.withColumns(always), positives + 1, same=True)
    best = best.withColumn("ps", F.col("score").cast("long"))
    # hundredths of a score without leaving 64 bits; below zero the window is empty
    least = F.expr(f"ps div 100 * {low} + cast(ceil(ps % 100 * {low} / 100) as long)")
    most_ = F.expr(f"ps div 100 * {high} + cast(floor(ps % 100 * {high} / 100) as long)")
    windows = best.filter("ps >= 0").select("q", "ps", least.cast("double").alias("lo"), most_.cast("double").alias("hi")).distinct()
    windows = windows.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("ps", "lo", "hi"))).alias("x"))
    windows = materialize(windows.select("q", F.col("x.ps").alias("scores"), F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi")), "windows")
    others = search(lists, queries.join(windows.drop("scores"), "q"), negatives, same=False)
    others = others.join(windows.select("q", "scores"), "q").select("q", F.element_at("scores", F.col("t") + 1).alias("ps"), F.struct("rank", "id", F.col("score").cast("long").alias("score")).alias("x"))
    others = others.groupBy("q", "ps").agg(F.sort_array(F.collect_list("x")).alias("found"))

    answers = best.join(others, ["q", "ps"], "left").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "ps", "own", "found"))).alias("best"))
    answers = queries.join(answers, "q").drop("q")
    itself = F.array_position(F.transform("best", lambda x: x["own"] & (x["id"] == F.col("id"))), True)
    chosen = F.slice(F.filter("best", lambda x, i: i + 1 != F.col("itself")), 1, positives)
    named = lambda c: F.when(c != LAST, c)
    out = asked.select("id", *item).join(answers, item).withColumn("itself", itself).select("id", F.explode(chosen).alias("p"))
    out = out.select("id", F.col("p.id").alias("pid"), F.col("p.ps").alias("ps"), F.explode("p.found").alias("n"))
    return out.select(
        F.col("id").alias("anchor_id"), named(F.col("pid")).alias("positive_id"), F.col("n.rank").alias("rank"), named(F.col("n.id")).alias("negative_id"),
        F.col("ps").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
