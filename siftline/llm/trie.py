"""Conversation prefix tries: succinct level-order tries per prefix shard.

A node is a distinct sequence of first turns (role, text) with the conversations
that begin with it.  Texts never travel: a row becomes a digest of its turn, and a
prefix is named by the 128-bit exclusive or of its (place, digest) hashes, so that
a node's parent is the node's own name less its last turn.  Names are running
sums over rows sorted by range, with one correction per partition: a conversation
may fill any number of partitions.

Nodes with the same members lie one above the other; they are one chain, known by
its smallest member and its number of members.  Chains form a trie of at
most twice as many nodes as there are different conversations, however long these
are.  Subtrees of at most ``limit`` conversations are prefix shards; some shards
together make a pack.  A task builds a pack's trie with numpy, a LOUDS bitvector and
a label array in level order, finds parents by rank and select, and rolls counts
up in reverse level order.  Chains of more than ``limit`` conversations, the heavy
upper levels, are merged apart: every shard and every heavy chain gives its sums to
the heavy chains on its path.

Defined results: a null role or text is empty; rows without a conv_id belong to no
conversation; turns are ordered by number, null first, equal numbers by the turn's
digest, and rows that repeat are turns of their own; texts of any length are digested
whole; an empty table has no nodes, not even a root; other columns play no part, so
their names cannot clash.  Where many heavy chains lie on one path (copies that each
stop a turn earlier), merging them costs their number times their depth.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize


def running(rows: DataFrame, key: str, order: list[str], sums: list[str], xors: list[str]) -> DataFrame:
    """Append inclusive running sums and exclusive ors (r_<name>) over each key's rows in order.

    Rows are dealt by range, so a key can lie in many partitions; what a partition
    adds to the next is one row each, and these are summed up on the driver.
    """
    spark, names = rows.sparkSession, sums + xors
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).withColumn("part", F.spark_partition_id())

    def local(batches):
        import pyarrow as pa

        last, carry = None, dict.fromkeys(names, 0)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            out = list(batch.columns)
            for name in names:
                x = batch.column(batch.schema.get_field_index(name)).to_numpy()
                xor = name in xors
                acc = np.bitwise_xor.accumulate(x) if xor else np.cumsum(x)
                before = np.concatenate([[0], acc[starts[1:] - 1]])
                r = acc ^ before[of] if xor else acc - before[of]
                if keys[0] == last:
                    first = of == 0
                    r[first] = r[first] ^ carry[name] if xor else r[first] + carry[name]
                carry[name] = r[-1]
                out.append(pa.array(r, pa.int64()))
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, *(f"r_{name}" for name in names)])

    schema = T.StructType([*dealt.schema.fields, *(T.StructField(f"r_{name}", T.LongType()) for name in names)])
    out = materialize(dealt.mapInArrow(local, schema), "running")

    # a partition's first and last key, with the last one's sums: as many rows as partitions
    ends = out.groupBy("part").agg(F.min(key).alias("first"), F.max_by(F.struct(key, *(f"r_{n}" for n in names)), F.struct(key, *order)).alias("end"))
    carried, last, carry = [], None, None
    for part, first, end in sorted(ends.collect()):
        end, tail = end[0], list(end[1:])
        if first == last:
            carried.append((part, first, *carry))
            if end == first:
                tail = [a ^ b if n in xors else a + b for n, a, b in zip(names, tail, carry)]
        last, carry = end, tail
    if not carried:
        return out.drop("part")
    offsets = spark.createDataFrame(carried, f"part int, {key} long, " + ", ".join(f"o_{n} long" for n in names))
    joined = out.join(F.broadcast(offsets), ["part", key], "left")
    for n in names:
        r, o = F.col(f"r_{n}"), F.coalesce(F.col(f"o_{n}"), F.lit(0))
        joined = joined.withColumn(f"r_{n}", r.bitwiseXOR(o) if n in xors else r + o)
    return joined.select(*rows.columns, *(f"r_{n}" for n in names))


def ordered_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, x1, x2, points) of every turn: its place from 0, its digest, its code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    sha = F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), role, text), 256)
    part = lambda i: F.conv(F.substring(sha, i, 15), 16, 10).cast("long")
    rows = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), part(1).alias("x1"), part(16).alias("x2"),
        F.length(text).cast("long").alias("points"), F.lit(1).cast("long").alias("one"),
    )
    return running(rows, "conv", ["turn", "x1", "x2"], ["one"], []).select("conv", (F.col("r_one") - 1).alias("pos"), "x1", "x2", "points")


def spliced(df: DataFrame, stride: int = 100, heads: int = 6, **columns) -> DataFrame:
    """Turns of rebuilt conversations: the first h turns of conversation c - c % stride, then c's own after its first h.

    h is the unsigned crc32 of c in decimal, modulo `heads`.  A conversation that is
    left without turns has one row with pos -1.
    """
    own = ordered_turns(df, **columns)
    own = own.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % heads, "base": F.col("conv") - F.col("conv") % stride})
    first = F.filter(F.sort_array(F.collect_list(F.struct("pos", "x1", "x2", "points"))), lambda t: t["pos"].isNotNull())
    head = own.filter(f"conv = base AND pos < {heads - 1}").groupBy(F.col("conv").alias("base")).agg(first.alias("head"))
    kept = own.filter("pos >= h").join(head.select("base", F.size("head").cast("long").alias("b")), "base", "left")
    kept = kept.select("conv", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("b", F.lit(0).cast("long")))).alias("pos"), "x1", "x2", "points")
    # one row per conversation: its first own turn, and how many it has beyond h
    convs = own.groupBy("conv", "base", "h").agg(F.max("pos").alias("last")).join(head, "base", "left")
    taken = convs.select("conv", F.explode(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("t")).select("conv", "t.*")
    bare = convs.filter("last < h AND head IS NULL").select("conv", F.lit(-1).cast("long").alias("pos"), *(F.lit(None).cast("long").alias(c) for c in ("x1", "x2", "points")))
    return kept.unionByName(taken).unionByName(bare)


class Louds:
    """A level-order trie: bits '1' per child and '0' per node, after '10' for what stands above the roots."""

    def __init__(self, parent: np.ndarray, label: np.ndarray):
        n = len(parent)
        level = np.where(parent < 0, 0, -1)
        while (open_ := np.flatnonzero(level < 0)).size:
            level[open_] = np.where(level[parent[open_]] >= 0, level[parent[open_]] + 1, -1)
        rank, order = np.full(n + 1, -1), []
        done = 0
        for d in range(int(level.max()) + 1 if n else 0):
            at = np.flatnonzero(level == d)
            at = at[np.lexsort((label[at], rank[parent[at]]))]
            rank[at] = np.arange(done, done + len(at))
            order.append(at)
            done += len(at)
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.label, self.starts = label[self.order], np.cumsum([0, *map(len, order)])
        above = rank[parent[self.order]] + 1 if n else np.zeros(0, np.int64)
        fan = np.bincount(above, minlength=n + 1)
        self.bits = np.ones(2 * n + 1, np.uint8)
        self.bits[np.cumsum(fan) + np.arange(n + 1)] = 0

    def parents(self) -> np.ndarray:
        """Places of parents in level order, -1 for roots: zeros before the i-th one, less one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        zeros = np.flatnonzero(self.bits == 0)
        return (np.diff(zeros) - 1) if len(zeros) > 1 else np.zeros(0, np.int64)

    def rolled_up(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums over subtrees of values in level order."""
        up, out = self.parents(), [v.copy() for v in values]
        for low, high in zip(self.starts[-2:0:-1], self.starts[:1:-1]):
            for v in out:
                np.add.at(v, up[low:high], v[low:high])
        return out


_ROLLED = "conv long, n long, fan long, leaves long, saved long"


def _pack(table):
    """Chains of a pack of shards to their children, leaves and saved tokens."""
    import pyarrow as pa

    c = {name: table[name].to_numpy() for name in ("conv", "n", "pconv", "pn", "label", "own")}
    at = {key: i for i, key in enumerate(zip(c["conv"].tolist(), c["n"].tolist()))}
    parent = np.fromiter((at.get(key, -1) for key in zip(c["pconv"].tolist(), c["pn"].tolist())), np.int64, len(at))
    trie = Louds(parent, c["label"])
    fan = trie.degrees()
    leaves, saved = trie.rolled_up((fan == 0).astype(np.int64), c["own"][trie.order])
    out = (c["conv"][trie.order], c["n"][trie.order], fan, leaves, saved)
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], [f.split()[0] for f in _ROLLED.split(", ")])


def _lists(batches):
    """Rows sorted by (k1, k2, conv) to stretches of at most 4096 members of a key as text."""
    import pyarrow as pa

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        k1, k2, conv = (batch.column(i).to_numpy() for i in range(3))
        new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        new[::4096] = True
        starts = np.flatnonzero(new)
        cuts = [*starts.tolist(), n]
        ids = conv.tolist()
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(k1[starts]), pa.array(k2[starts]), pa.array(conv[starts]), pa.array(np.diff(cuts)), pa.array(texts, pa.string())], ["k1", "k2", "first", "size", "ids"])


def _hashed(batches):
    """Stretches sorted by (k1, k2, first) to one digest per key."""
    import pyarrow as pa

    names, key, sha, size, done = ["k1", "k2", "n_ends", "ends_sha256"], None, None, 0, []

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)
        done.clear()
        return batch

    for batch in batches:
        for k1, k2, _, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (k1, k2) == key:
                sha.update(b"," + ids.encode())
            else:
                if key is not None:
                    done.append((*key, size, sha.hexdigest()))
                key, sha, size = (k1, k2), hashlib.sha256(ids.encode()), 0
            size += n
        if len(done) > 4096:
            yield flush()
    if key is not None:
        done.append((*key, size, sha.hexdigest()))
    if done:
        yield flush()


def end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, n_ends, ends_sha256) of rows (k1, k2, conv): a key's members in order travel as text, 4096 a row."""
    parts = max(2, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists = ends.select("k1", "k2", "conv").repartitionByRange(parts, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    lists = lists.mapInArrow(_lists, "k1 long, k2 long, first long, size long, ids string")
    return lists.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_hashed, "k1 long, k2 long, n_ends long, ends_sha256 string")


def prefix_trie(turns: DataFrame, limit: int = 1024, pack: int = 8192) -> DataFrame:
    """One row per node of turns (conv, pos, x1, x2, points): the contract's columns, and the node's and its parent's name.

    `limit` is the most conversations of a shard, `pack` about how many chains one
    task builds at a time.
    """
    mix = lambda seed: F.xxhash64(F.lit(seed), "x1", "x2", "pos")
    rows = turns.filter("pos >= 0").withColumns({"e1": mix(1), "e2": mix(2)}).select("conv", "pos", "points", "e1", "e2")
    run = running(rows, "conv", ["pos"], ["points"], ["e1", "e2"])
    run = run.select("conv", (F.col("pos") + 1).alias("depth"), "points", F.col("r_points").alias("total"), F.col("r_e1").alias("k1"), F.col("r_e2").alias("k2"), "e1", "e2")

    zero = F.lit(0).cast("long")
    up = {f"p{i}": F.min(F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}"))).alias(f"p{i}") for i in (1, 2)}
    below = run.groupBy("k1", "k2").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.min("depth").alias("depth"), *up.values(), F.min("points").alias("points"), F.min("total").alias("total"))
    root = turns.filter("pos <= 0").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).filter("n > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "conv", "n", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("points"), zero.alias("total"))
    nodes = materialize(below.unionByName(root), "nodes")

    chains = nodes.groupBy("conv", "n").agg(
        F.min("depth").alias("lo"), F.max("depth").alias("hi"), F.max("total").alias("total"), F.min(F.col("total") - F.col("points")).alias("before"),
        F.min_by(F.struct("p1", "p2", F.col("k1").bitwiseXOR(F.col("p1")).alias("label"), F.col("k1").alias("t1"), F.col("k2").alias("t2")), "depth").alias("top"), F.max_by(F.struct("k1", "k2"), "depth").alias("bottom"),
    )
    chains = chains.select("conv", "n", "lo", "hi", "total", F.expr("(n - 1) * (total - before)").alias("own"), "top.*", F.col("bottom.k1").alias("b1"), F.col("bottom.k2").alias("b2"))
    chains = materialize(chains, "chains")
    parents = chains.select(F.col("b1").alias("p1"), F.col("b2").alias("p2"), F.col("conv").alias("pconv"), F.col("n").alias("pn"))
    linked = chains.filter("lo > 0").join(parents, ["p1", "p2"]).unionByName(chains.filter("lo = 0"), allowMissingColumns=True)
    linked = materialize(linked, "linked")

    light, heavy = linked.filter(f"n <= {limit}"), linked.filter(f"n > {limit}")
    tops = light.filter(f"pn IS NULL OR pn > {limit}")
    columns = ["conv", "n", F.coalesce("pconv", zero).alias("pconv"), F.coalesce("pn", zero).alias("pn"), "label", "own"]
    some_heavy = not heavy.isEmpty()
    if some_heavy:
        # every conversation passes at most one shard's top
        shard = run.join(tops.select(F.col("t1").alias("k1"), F.col("t2").alias("k2")), ["k1", "k2"]).select("conv", F.xxhash64("k1", "k2").alias("shard"))
        light = light.join(shard, "conv")
    else:
        light = light.withColumn("shard", zero)
    packs = max(1, -(-linked.count() // pack))
    rolled = light.withColumn("pack", F.pmod("shard", F.lit(packs))).select("pack", *columns).groupBy("pack").applyInArrow(_pack, _ROLLED)
    if some_heavy:
        rolled = materialize(rolled, "rolled")
        fan = linked.filter(f"pn > {limit}").groupBy(F.col("pconv").alias("conv"), F.col("pn").alias("n")).agg(F.count(F.lit(1)).alias("fan"))
        own = heavy.select("conv", "n", "lo", "hi", "own", "b1", "b2").join(fan, ["conv", "n"], "left").withColumn("fan", F.coalesce("fan", zero))
        own = materialize(own, "heavy")
        given = tops.select("conv", "n", "lo").join(rolled, ["conv", "n"]).select("conv", "lo", "leaves", "saved")
        given = given.unionByName(own.select("conv", "lo", F.when(F.col("fan") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.col("own").alias("saved")))
        given = materialize(given, "given")
        over = run.filter("depth > 0").select("conv", "depth", "k1", "k2").join(given, "conv").filter("depth < lo")
        reached = over.join(own.filter("hi > 0").select(F.col("b1").alias("k1"), F.col("b2").alias("k2"), F.col("conv").alias("hconv"), F.col("n").alias("hn")), ["k1", "k2"])
        sums = reached.groupBy(F.col("hconv").alias("conv"), F.col("hn").alias("n")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        # the chain that ends at the root has everything below it
        at_root = own.filter("hi = 0").head()
        if at_root:
            everything = given.filter("lo > 0").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            sums = sums.unionByName(everything.withColumns({"conv": F.lit(at_root["conv"]), "n": F.lit(at_root["n"])}))
        sums = own.join(sums, ["conv", "n"], "left")
        sums = sums.select("conv", "n", "fan", (F.coalesce("leaves", zero) + F.when(F.col("fan") == 0, 1).otherwise(0)).alias("leaves"), (F.coalesce("saved", zero) + F.col("own")).alias("saved"))
        rolled = rolled.unionByName(sums)
    per_chain = linked.join(rolled, ["conv", "n"]).select("conv", "n", "lo", "hi", F.col("total").alias("top_total"), "own", "pconv", "fan", "leaves", "saved")

    last = run.groupBy("conv").agg(F.max_by(F.struct("k1", "k2"), "depth").alias("k")).select("k.k1", "k.k2", "conv")
    bare = turns.filter("pos = -1").select(zero.alias("k1"), zero.alias("k2"), "conv")
    digests = end_digests(last.unionByName(bare))
    out = nodes.join(per_chain, ["conv", "n"]).join(digests, ["k1", "k2"], "left")
    saved = F.col("saved") - F.col("own") + (F.col("n") - 1) * (F.col("top_total") - F.col("total") + F.col("points"))
    name = lambda a, b: F.format_string("%016x%016x", a, b)
    return out.select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") > F.col("lo"), F.col("conv")).otherwise(F.col("pconv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("depth") < F.col("hi"), F.lit(1).cast("long")).otherwise(F.col("fan")).alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.coalesce("n_ends", zero).alias("n_ends"), "points", name("k1", "k2").alias("node"), F.when(F.col("depth") > 0, name("p1", "p2")).alias("parent"),
    )
