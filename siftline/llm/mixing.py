"""Mixing sources to target weights by packed blocks and index permutations.

Each source's documents are laid end to end in a fixed order and cut into blocks
of ``block`` words.  The output is a sequence of shards of ``slots`` blocks.  For
every shard a multinomial draw says how many slots each source gets; the draw is
over what is left after the whole parts of the expected counts, so totals stay
near their targets at every size.  A source's k-th slot overall maps to block
permutation(k mod blocks) of epoch k div blocks, where each epoch is its own
pseudorandom permutation (a Feistel network walked into range).  Blocks are then
joined to the documents that fill them, by index.

No block is drawn more often than ``cap`` times, so no document is either: sources
near their cap take exact quotas, and a draw that would pass a cap is drawn anew.
All draws are seeded by shard and source alone: reruns agree.

Places in a stream and slots of a source are prefix sums over several levels, so
no task ever holds all chunks or all shards of a source.

Defined results: a null text has size 0; documents of size 0 are never taken; a
null source is a source, last in order; no rows give no rows.  Rows that repeat
are documents of their own; rows equal in identifier and size lie side by side in
a fixed but arbitrary order.  A null identifier is an identifier like any other.
Texts of any length count whole and fill as many blocks as they need.  Words are
runs of anything but ASCII white space.  Other columns play no part; outputs are
the operator's own columns, or with ``resample`` the input's.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, exclusive_sums, materialize, mix64

CHUNK = 2048


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Share sum(sizes) by weight; nothing above cap times its size, the excess reshared."""
    target, left, active = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while active:
        whole = sum(weights[i] for i in active)
        share = {i: left * weights[i] / whole for i in active}
        full = [i for i in sorted(active) if share[i] > cap * sizes[i]]
        if not full:
            for i in active:
                target[i] = share[i]
            break
        for i in full:
            target[i] = float(cap * sizes[i])
            left -= target[i]
            active.discard(i)
    return target


def _permute(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each k in [0, n) to its place under the permutation of [0, n) that key names."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, todo = k.astype(np.uint64), np.ones(len(k), bool)
    limit = n.astype(np.uint64)
    while todo.any():
        x, b, m, q = out[todo], bits[todo], mask[todo], key[todo]
        left, right = x >> b, x & m
        for r in range(4):
            left, right = right, left ^ (mix64(right ^ (q + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64))) & m)
        out[todo] = left << b | right
        todo = out >= limit
    return out.astype(np.int64)


def _shard_draws(sources: list[dict], shards: int, slots_total: int, seed: int):
    """Per shard of a batch, how many slots each source gets."""
    expected = np.array([s["slots"] for s in sources])
    pinned = np.array([s["pinned"] for s in sources])
    per = expected / shards
    base = np.where(pinned, 0, np.floor(per)).astype(np.int64)
    part = np.where(pinned, 0.0, per - base)

    def draw(batches):
        import pandas as pd

        for pdf in batches:
            found = []
            for j in pdf["shard"].to_numpy():
                exact = np.floor(expected * (j + 1) / shards).astype(np.int64) - np.floor(expected * j / shards).astype(np.int64)
                n = np.where(pinned, exact, base)
                here = slots_total * (int(j) + 1) // shards - slots_total * int(j) // shards
                rest = here - int(n.sum())
                if rest > 0 and part.sum() > 0:
                    rng = np.random.Generator(np.random.Philox(key=[seed, int(j)]))
                    n = n + rng.multinomial(rest, part / part.sum())
                some = np.flatnonzero(n)
                found.append(pd.DataFrame({"shard": j, "src": some.astype(np.int32), "n": n[some]}))
            if found:
                yield pd.concat(found)

    return draw


class Mixture:
    """The plan of a mix over a table: per-document counts and the mixed blocks."""

    def __init__(
        self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=(5, 2, 1), cap: int = 3, block: int = 128, slots: int = 4096, seed: int = 7, max_sources: int = 50_000,
    ):
        """weights repeat over the sources in code point order, null last.

        One row per source comes to the driver; more than max_sources is an
        error, since every shard's draw is over all of them.
        """
        self.spark, self.df = df.sparkSession, df
        self.id_col, self.text_col, self.source_col = id_col, text_col, source_col
        self.block, self.cap, self.seed = block, cap, seed
        self.docs = materialize(
            df.select(
                F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("h"),
            ),
            "sizes",
        )
        found = self.docs.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")).limit(max_sources + 1).collect()
        if len(found) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        sizes = [r.words for r in found]
        targets = water_fill(sizes, [float(weights[i % len(weights)]) for i in range(len(found))], cap)
        self.sources = []
        for i, (r, target) in enumerate(zip(found, targets)):
            blocks = -(-r.words // block)
            self.sources.append({
                "src": i, "source": r.source, "source_size": r.words, "target": target, "blocks": blocks,
                "chunks": -(-r.rows // CHUNK), "slots": target * blocks / r.words if r.words else 0.0,
            })
        self.slots_total = round(sum(s["slots"] for s in self.sources))
        self.shards = max(1, -(-self.slots_total // slots))
        for s in self.sources:  # too near the cap to leave to chance
            s["pinned"] = s["slots"] + 6 * math.sqrt(self.shards) + 4 >= cap * s["blocks"]

    def _of_sources(self) -> DataFrame:
        rows = [(s["src"], s["source"], s["source_size"], s["target"], s["blocks"], s["chunks"]) for s in self.sources]
        return F.broadcast(self.spark.createDataFrame(rows, "src int, source string, source_size long, target double, blocks long, chunks long"))

    def placed(self) -> DataFrame:
        """Each document with the place of its first word in its source's stream.

        A prefix sum within chunks of about CHUNK documents, then over the chunks'
        sums in levels, so a hot source never meets in one task; documents are dealt
        to chunks by identifier and text, so neither do those without an identifier.
        """
        s = self._of_sources().withColumnRenamed("source", "__s")
        # rows without words do not move the start, so only a number of their own tells them apart
        docs = self.docs.withColumn("row", F.monotonically_increasing_id()).join(s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        docs = docs.withColumn("chunk", F.pmod(F.xxhash64("id", "h", F.lit(self.seed)), F.col("chunks")))
        w = Window.partitionBy("src", "chunk").orderBy("id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
        within = docs.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
        sums = docs.groupBy("src", "chunk").agg(F.sum("size").alias("words"))
        most = max((s["chunks"] for s in self.sources), default=0)
        sums = exclusive_sums(sums, "src", "chunk", "words", "earlier", most).drop("words")
        return within.join(sums, ["src", "chunk"]).withColumn("start", F.col("earlier") + F.col("before")).drop("earlier", "before", "chunk", "chunks")

    def draws(self) -> DataFrame:
        """One row per shard and source that it draws: shard, src, n.  No source's sum passes its cap."""
        shards = self.spark.range(self.shards).withColumnRenamed("id", "shard")
        most = F.broadcast(self.spark.createDataFrame([(s["src"], self.cap * s["blocks"]) for s in self.sources], "src int, most long"))
        for again in range(20):
            draw = _shard_draws(self.sources, self.shards, self.slots_total, self.seed + 7919 * again)
            counts = materialize(shards.mapInPandas(draw, "shard long, src int, n long"), "draws")
            if counts.groupBy("src").agg(F.sum("n").alias("n")).join(most, "src").filter("n > most").isEmpty():
                return counts
            discard(counts)
        raise RuntimeError("no draw within the caps")

    def slots(self) -> DataFrame:
        """One row per output slot: shard, src, block."""
        if not self.slots_total:
            return self.spark.createDataFrame([], "shard long, src int, block long")
        counts = exclusive_sums(self.draws(), "src", "shard", "n", "first", self.shards)
        blocks, cap, seed = np.array([s["blocks"] for s in self.sources], np.int64), self.cap, self.seed

        def spread(batches):
            import pandas as pd

            for pdf in batches:
                for shard, src, n, first in pdf[["shard", "src", "n", "first"]].itertuples(index=False):
                    k = np.arange(first, first + n, dtype=np.int64)
                    m = blocks[src]
                    assert first + n <= cap * m, "a source was drawn beyond its cap"
                    epoch = k // m
                    key = mix64(np.uint64(seed + 1_000_003 * int(src)) + epoch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    place = _permute(k % m, np.full(len(k), m), key)
                    yield pd.DataFrame({"shard": shard, "src": np.int32(src), "block": place})

        return counts.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "shard", "src").mapInPandas(spread, "shard long, src int, block long")

    def taken(self, with_hash: bool = False) -> DataFrame:
        """One row per document: id, size, source_size, target, taken and, if asked for, h (a hash of the text)."""
        size = F.lit(self.block)
        parts = self.placed().withColumn(
            "block",
            F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)))),
        )
        end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
        parts = parts.withColumn("words", end - F.greatest("start", F.col("block") * size))
        # the draws grow with the corpus, which the planner cannot see behind a Python step
        drawn = self.slots().groupBy("src", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")
        return (
            parts.join(drawn, ["src", "block"], "left")
            .groupBy("row", "id", "size", "h", "source_size", "target")
            .agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).cast("long").alias("taken"))
            .select(F.col("id").alias(self.id_col), "size", "source_size", "target", "taken", *(["h"] if with_hash else []))
        )

    def blocks(self) -> DataFrame:
        """The mix itself: shard, src, block and the block's text, one row per slot."""
        size = F.lit(self.block)
        placed = self.placed().select("id", "src", "start", "size", "h")
        # only rows of one identifier and one text meet twice here, and any of them serves all
        text = self.df.select(F.col(self.id_col).alias("__id"), F.xxhash64(self.text_col).alias("__h"), F.regexp_extract_all(F.col(self.text_col), F.lit(f"({WORD})"), F.lit(1)).alias("w"))
        text = text.dropDuplicates(["__id", "__h"])
        same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
        parts = placed.filter("size > 0").join(text, same).withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)))
        )
        low = F.greatest("start", F.col("block") * size)
        high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * size)
        parts = parts.select("src", "block", low.alias("at"), F.slice("w", (low - F.col("start") + 1).cast("int"), (high - low).cast("int")).alias("w"))
        # a block holds at most `block` words, which bounds what is gathered
        filled = parts.groupBy("src", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"])).alias("w"))
        return self.slots().join(filled.select("src", "block", F.array_join("w", " ").alias("text")).hint("merge"), ["src", "block"])


def resample(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The input's documents as often as the mix takes them, columns unchanged.

    A document whose words are taken x times its size stays floor(x) times and
    once more with probability x - floor(x), by a hash of its identifier.
    Documents without words stay as they are.
    """
    mix = Mixture(df, id_col, text_col, source_col, **options)
    u = F.pmod(F.xxhash64("__id", F.lit(mix.seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    ratio = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(ratio) + (u < ratio - F.floor(ratio)).cast("int"))
    plan = mix.taken(with_hash=True).groupBy(F.col(id_col).alias("__id"), F.col("h").alias("__h"), "size").agg(F.max("taken").alias("taken"))
    plan = plan.select("__id", "__h", times.cast("int").alias("__times"))
    joined = df.join(plan, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__h")))
    return joined.filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in df.columns])
