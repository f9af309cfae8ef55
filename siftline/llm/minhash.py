"""Near-duplicate documents by b-bit MinHash.

One pass over the texts makes each document's shingle set, the minima of
``bands * rows`` hash functions over it, a key per band from the full minima,
and a packed signature of the lowest four bits of every minimum.  Documents with
the same set are one class, represented by its smallest identifier.

Members of a band bucket are compared by their packed signatures: similarity is
estimated from bit counts and corrected for chance agreement, and pairs within
five standard deviations of the threshold are candidates.

0. A few bands come first, steps 1 and its confirmation for them alone: near copies share most bands, and a bucket
   of the other bands whose members those few have joined is left before it is gone through.
1. A bucket's members are dealt into blocks.  A spanning forest of each block's
   candidates, best estimates first, is confirmed on the full sets; that is linear
   in the bucket and finds the hubs of large groups.
2. Buckets that hold one component are settled and left.  While one of several blocks holds several components, a few members
   of each stand for it and are dealt and joined the same way, so the blocks'
   groups grow together in few rounds.
3. In buckets that then hold several components, the members outside the largest
   one are compared with all others of the bucket, first by signatures, then on
   full sets, inside the tasks; only links that join components come out.

So no link between components is lost, members of a large group are not compared
with each other, and no bucket is expanded into pairs.

With 32 bands of 4 rows a pair at similarity 0.8 shares no band with probability
5e-8.  Defined results: null, empty and white-space texts have no shingles and
link with nothing; texts of any length give their whole sets; a null identifier
links with nothing and is its own, null, component; rows that repeat an identifier
are documents of their own.  An empty table gives no rows; other columns are not
returned, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.storage import settle

from .common import discard, gram_hashes, materialize, mix64, word_hashes
from .graph import connected_components

BITS = 4
BLOCK = 512
#: Members that stand for a component when the blocks of a bucket are joined.
STAND_INS = 8
#: Bands that are gone through before all others.
EARLY = 6


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; A-Z are lower-cased.

    With fewer than k words the whole sequence is the one shingle.
    """
    words = [w for w in text.encode("utf-8", "surrogatepass").lower().split()] if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(word_hashes(words), min(k, len(words))))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = bands * rows
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)
        self.band_seed = mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def minima(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(h), 2048):
            out = np.minimum(out, (self.a[:, None] * h[None, i : i + 2048] + self.b[:, None]).min(1))
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        m = mix64(minima).reshape(self.bands, self.rows)
        key = self.band_seed.copy()
        for i in range(self.rows):
            key = mix64(key ^ m[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        return key.view(np.int64)

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """Sixteen four-bit fields to the long."""
        low = (mix64(minima) & np.uint64(15)).reshape(-1, 16)
        return (low << (np.arange(16, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """id, h (a hash of the text), n (set size), f1 and f2 (the set's fingerprint), keys, sig."""
    if bands * rows % 16:
        raise ValueError("bands * rows must be a multiple of 16")

    @F.arrow_udf("n long, f1 long, f2 long, keys array<long>, sig array<long>")
    def signed(texts):
        import pyarrow as pa

        signer, n, f1, f2, keys, sigs = Signer(bands, rows), [], [], [], [], []
        for text in texts.to_pylist():
            h = shingle_set(text, k)
            n.append(len(h))
            if not len(h):
                f1.append(0), f2.append(0), keys.append([]), sigs.append([])
                continue
            m = mix64(h)
            f1.append(int(m.sum(dtype=np.uint64).view(np.int64)))
            f2.append(int(np.bitwise_xor.reduce(mix64(m + np.uint64(0x1234567))).view(np.int64)))
            minima = signer.minima(h)
            keys.append(signer.keys(minima))
            sigs.append(signer.packed(minima))
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, longs), pa.array(sigs, longs)],
            ["n", "f1", "f2", "keys", "sig"],
        )

    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), signed(text).alias("x")).select("id", "h", "x.*")


def estimated(sig_a: Column, sig_b: Column, width: int) -> Column:
    """Similarity from two packed signatures, corrected for chance agreement."""
    differing = None
    for i in range(width):
        x = sig_a[i].bitwiseXOR(sig_b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        bits = F.bit_count(x)
        differing = bits if differing is None else differing + bits
    fields, chance = width * 16, 1.0 / (1 << BITS)
    return (1 - differing / F.lit(float(fields)) - chance) / (1 - chance)


class _Blocks:
    """A column of block lists as flat numpy arrays: no Python object per member.

    Row i holds one or two blocks; sides(i) are the members' ranges in the arrays.
    """

    def __init__(self, lists, width: int):
        self.rows, self.cuts = lists.offsets.to_numpy(), lists.values.offsets.to_numpy()
        members = lists.values.values
        names = [f.name for f in members.type]
        self.id, self.c, self.n = (members.field(x).to_numpy() if x in names else None for x in ("id", "c", "n"))
        self.sig = members.field("sig").values.to_numpy().view(np.uint64).reshape(-1, width)
        self.keys = members.field("keys").values.to_numpy().reshape(len(self.id), -1) if "keys" in names else None
        if "set" in names:
            self.set_cuts, self.set_values = members.field("set").offsets.to_numpy(), members.field("set").values.to_numpy()

    def sides(self, i: int) -> list[tuple[int, int]]:
        return [(int(self.cuts[j]), int(self.cuts[j + 1])) for j in range(self.rows[i], self.rows[i + 1])]

    def set(self, k: int) -> np.ndarray:
        return self.set_values[self.set_cuts[k] : self.set_cuts[k + 1]]

    def apart(self, k: int, low: int, high: int) -> np.ndarray:
        """In how many fields member k's signature differs from those of a range."""
        x = self.sig[low:high] ^ self.sig[k]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1)

    def sized(self, k: int, low: int, high: int, percent: int) -> np.ndarray:
        """Whether set sizes alone allow the threshold."""
        return (self.n[low:high] * 100 >= self.n[k] * percent) & (self.n[k] * 100 >= self.n[low:high] * percent)

    def hits(self, i: int, band: int, most: int, percent: int):
        """Candidates across components in row i: (member, members).

        Of the bands that a pair shares only the first yields it.
        """
        sides = self.sides(i)
        low, high = sides[-1]
        for k in range(*sides[0]):
            start = k + 1 if len(sides) == 1 else low
            if start >= high:
                continue
            hit = (self.apart(k, start, high) <= most) & (self.c[start:high] != self.c[k]) & self.sized(k, start, high, percent)
            j = np.flatnonzero(hit) + start
            if band and len(j):
                j = j[~(self.keys[j, :band] == self.keys[k, :band]).any(1)]
            if len(j):
                yield k, j

    def forest(self, i: int, most: int, percent: int) -> list[tuple[int, int]]:
        """A spanning forest of row i's candidates, closest first (Prim's order); members of one component count as linked."""
        low, high = self.sides(i)[0]
        near, via = np.full(high - low, most + 1), np.zeros(high - low, np.int64)
        done, out = np.zeros(high - low, bool), []
        for _ in range(high - low):
            k = int(np.where(done, most + 2, near).argmin())
            if 0 <= near[k] <= most:
                a, b = int(self.id[low + via[k]]), int(self.id[low + k])
                out.append((min(a, b), max(a, b)))
            done[k] = True
            apart = self.apart(low + k, low, high).astype(np.int64)
            apart[~self.sized(low + k, low, high, percent)] = most + 1
            apart[self.c[low:high] == self.c[low + k]] = -1
            closer = apart < near
            near[closer], via[closer] = apart[closer], k
        return out


def _root(parent: dict[int, int], u: int) -> int:
    while parent.get(u, u) != u:
        parent[u] = u = parent.get(parent[u], parent[u])
    return u


def _in_blocks(what: str, most: int, percent: int, width: int):
    """forest: pairs to confirm; open: identifiers with a candidate; links: pairs confirmed on sets."""
    import pyarrow as pa

    pair = pa.struct([("a", pa.int64()), ("b", pa.int64())])

    @F.arrow_udf("array<struct<a:long,b:long>>" if what != "open" else "array<long>")
    def found(lists, bands):
        blocks, out = _Blocks(lists, width), []
        for i, band in enumerate(bands.to_pylist()):
            if what == "forest":
                out.append([{"a": a, "b": b} for a, b in blocks.forest(i, most, percent)])
                continue
            hits = blocks.hits(i, band, most, percent)
            if what == "open":
                seen = [np.append(j, k) for k, j in hits]
                out.append(blocks.id[np.unique(np.concatenate(seen))] if seen else [])
                continue
            parent, links = {}, []
            for k, found in hits:
                for j in found.tolist():
                    u, v = _root(parent, int(blocks.c[k])), _root(parent, int(blocks.c[j]))
                    if u == v:
                        continue
                    x, y = blocks.set(k), blocks.set(j)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if common * 100 >= (len(x) + len(y) - common) * percent:
                        parent[max(u, v)] = min(u, v)
                        links.append({"a": int(blocks.id[k]), "b": int(blocks.id[j])})
            out.append(links)
        return pa.array(out, pa.list_(pair if what != "open" else pa.int64()))

    return found


def _dealt(rows: DataFrame, fields: list[str], salt: int) -> DataFrame:
    """key, band and lists: each bucket's members in blocks, one block to the list; `members` says how many a bucket has."""
    # bands deal the same members differently, so that blocks of one bucket meet in another's
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "band", F.lit(salt)), F.ceil(F.col("members") / BLOCK)))
    # without this the blocks of a hot bucket would all be grouped, and compared, in one task
    rows = rows.repartition("key", "block")
    return rows.groupBy("key", "band", "block").agg(F.array(F.collect_list(F.struct(*fields))).alias("lists"))


def _counted(rows: DataFrame) -> DataFrame:
    """Append, for each row's key, its largest component (main), its rows (all) and those of that component (most)."""
    parts = rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(parts.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most")), "key")


def _unsettled(each: DataFrame) -> DataFrame:
    """Of rows (id, c, key, band, members) those whose bucket holds several components c, larger buckets counted.

    A bucket of one block is one row for a moment and says so itself; only what is larger is joined to its bucket.
    """
    small = each.filter(F.col("members") <= BLOCK).groupBy("key", "band", "members").agg(F.collect_list(F.struct("id", "c")).alias("m"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    small = small.filter("c0 <> c1").select("key", "band", "members", F.explode("m").alias("m")).select("m.*", "key", "band", "members")
    return small.unionByName(_counted(each.filter(F.col("members") > BLOCK)).filter("all > most"), allowMissingColumns=True)


def _small_sides(rows: DataFrame, fields: list[str], block: int) -> DataFrame:
    """key, band and lists: each block of members outside a bucket's largest component with each block of all its members.

    Rows hold `members`, at least the number of a key's rows: where that is one block, the lists are cut in place.
    Where it is more, rows hold the counts of _counted(); without these columns no bucket has more.
    """
    one = rows.filter(F.col("members") <= block).groupBy("key", "band").agg(F.collect_list(F.struct(*fields)).alias("all"), F.mode("c").alias("main"))
    one = one.select("key", "band", F.array(F.filter("all", lambda x: x["c"] != F.col("main")), F.col("all")).alias("lists"))
    if "main" not in rows.columns:
        return one.filter("size(lists[0]) > 0")
    rows = rows.filter(F.col("members") > block)
    rows = rows.withColumns({"i_blocks": F.ceil(F.col("all") / block), "j_blocks": F.ceil((F.col("all") - F.col("most")) / block)})
    place = F.xxhash64("id", F.lit(3))

    def side(members, own, other, blocks, number):
        members = members.withColumn(own, F.pmod(place, F.col(blocks))).repartition("key", own)
        lists = members.groupBy("key", "band", "i_blocks", "j_blocks", own).agg(F.collect_list(F.struct(*fields)).alias("list"))
        count = "j_blocks" if other == "j" else "i_blocks"
        return lists.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))).select("key", "band", "i", "j", F.lit(number).alias("side"), "list")

    both = side(rows.filter("c <> main"), "j", "i", "j_blocks", 0).unionByName(side(rows, "i", "j", "i_blocks", 1))
    lists = both.groupBy("key", "band", "i", "j").agg(F.sort_array(F.collect_list(F.struct("side", "list"))).alias("lists"))
    lists = lists.filter("size(lists) = 2").select("key", "band", F.transform("lists", lambda x: x["list"]).alias("lists"))
    return one.filter("size(lists[0]) > 0").unionByName(lists)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.filter(F.col("common") * 100 >= union * percent).select("a", "b")


def _sets(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id and full shingle set of nodes (id, rep, h): the text is that of identifier rep with hash h."""

    @F.arrow_udf("array<long>")
    def shingled(texts):
        import pyarrow as pa

        return pa.array([shingle_set(t, k).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    texts = df.select(F.col(id_col).cast("long").alias("rep"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    named = texts.join(nodes.hint("merge"), ["rep", "h"])
    return named.select("id", shingled(F.coalesce("text", F.lit(""))).alias("set")).dropDuplicates(["id"])


def _grown(labels: DataFrame | None, more: DataFrame) -> DataFrame:
    """Labels (node, component) after further edges (a, b): only the components that these join are gone through and renamed."""
    if labels is None or labels.isEmpty():
        return connected_components(more)
    for end in ("a", "b"):
        named = labels.select(F.col("node").alias(end), F.col("component").alias("__c"))
        more = more.join(named, end, "left").withColumn(end, F.coalesce("__c", end)).drop("__c")
    up = connected_components(more)
    if up.isEmpty():
        return labels
    top = up.select(F.col("node").alias("component"), F.col("component").alias("__top"))
    old = labels.join(top, "component", "left").select("node", F.coalesce("__top", "component").alias("component"))
    out = materialize(old.unionByName(up.join(labels.select("node"), "node", "left_anti")), "labels")
    discard(labels, up)
    return out


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, with_hash: bool = False,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept and, if asked for, h (a hash of the text)."""
    width = bands * rows // 16
    table = materialize(signatures(df, id_col, text_col, k, bands, rows), "signatures")
    live = table.filter("n > 0 AND id IS NOT NULL")
    classes = live.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # identifiers may repeat: only one class can have its smallest as its node, others get one below zero
    first = F.row_number().over(Window.partitionBy("rep").orderBy("f1", "f2", "n")) == 1
    node = F.when(first, F.col("rep")).otherwise(F.bitwise_not(F.shiftrightunsigned(F.xxhash64("f1", "f2", "n"), 1)))
    classes = materialize(classes.withColumn("node", node), "classes")
    of_class = classes.select("f1", "f2", "n", F.col("rep").alias("id"), "node")
    reps = live.join(of_class, ["f1", "f2", "n", "id"]).dropDuplicates(["node"])
    reps = materialize(reps.select(F.col("node").alias("id"), F.col("id").alias("rep"), "h", "n", "keys", "sig"), "representatives")

    least = percent / 100 - 5.0 * float(np.sqrt(0.16 / (bands * rows)))
    in_bands = reps.select("id", F.posexplode("keys").alias("band", "key"))
    left = reps.select(F.col("id").alias("a"), F.col("sig").alias("ga"), F.col("n").alias("na"))
    right = reps.select(F.col("id").alias("b"), F.col("sig").alias("gb"), F.col("n").alias("nb"))
    likely = (estimated(F.col("ga"), F.col("gb"), width) >= least) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    most = int(np.floor(16 * width * (1 - 1 / 16) * (1 - least)))
    signed = reps.select("id", "n", "sig")

    def forest(lists):
        return lists.select(F.explode(_in_blocks("forest", most, percent, width)("lists", "band")).alias("p")).select("p.*")

    def labelled(rows):
        """Rows that hold id with the member's component c, as far as it is known."""
        if labels is None:
            return rows.withColumn("c", F.col("id"))
        out = rows.join(labels.withColumnRenamed("node", "id"), "id", "left")
        return out.withColumn("c", F.coalesce("component", "id")).drop("component")

    # a few bands first: what they join has its other buckets settled before a row of those is joined to anything
    labels = sets = members = None
    done = []
    for low, high in ((0, EARLY), (EARLY, bands)):
        some = labelled(reps.select("id", "keys")).select("id", "c", F.posexplode("keys").alias("band", "key")).filter(F.col("band").between(low, high - 1))
        buckets = some.groupBy("key").agg(*[F.expr(x) for x in ("count(1) AS members", "min(id) AS low", "max(id) AS high", "min(c) AS c0", "max(c) AS c1")])
        buckets = materialize(buckets.filter("members > 1 AND c0 <> c1").drop("c0", "c1"), "buckets")
        pairs = buckets.filter("members = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).distinct()
        pairs = pairs.join(left, "a").join(right, "b").filter(likely).select("a", "b")
        # one row per member with all its larger buckets: what is joined to members is joined once, not once per band
        placed = in_bands.filter(F.col("band").between(low, high - 1)).join(buckets.filter("members > 2").select("key", "members"), "key")
        places = placed.groupBy("id").agg(F.collect_list(F.struct("key", "band", "members")).alias("places"))
        found = materialize(places.join(signed, "id"), "members")
        spread = labelled(found).select("id", "c", "n", "sig", F.explode("places").alias("p")).select("id", "c", "n", "sig", "p.*")
        tree = materialize(forest(_dealt(spread, ["id", "c", "n", "sig"], 0)).unionByName(pairs).distinct(), "forest")
        ids = found.select("id").union(tree.select("a")).union(tree.select("b")).distinct()
        ids = ids if sets is None else ids.join(sets.select("id"), "id", "left_anti")
        more = materialize(_sets(df, reps.select("id", "rep", "h").join(ids, "id"), id_col, text_col, k), "sets")
        done += [buckets, found, tree, more]
        sets = more if sets is None else sets.unionByName(more)
        more = materialize(_confirmed(tree, sets, percent), "links")
        members = found if members is None else members.unionByName(found)
        labels = _grown(labels, more)
        discard(more)
        settle(df.sparkSession)  # each of these steps runs many small tasks, and the driver keeps count of them
    each = labelled(members).select("id", "c", F.explode("places").alias("p")).select("id", "c", "p.*")
    still = materialize(_unsettled(each), "unsettled")
    done.append(still)
    # of what follows only the buckets of several blocks change
    wide, still = still.filter(F.col("members") > BLOCK), still.filter(F.col("members") <= BLOCK)
    for salt in range(1, 9):
        if wide.isEmpty():
            break
        part = F.xxhash64("id", F.lit(100 + salt))
        some = wide.groupBy("key", "band", "c", F.pmod(part, F.lit(STAND_INS)).alias("__s")).agg(F.min_by("id", part).alias("id")).drop("__s")
        some = some.join(some.groupBy("key").agg(F.count(F.lit(1)).alias("members")), "key")
        tree = materialize(forest(_dealt(some.join(signed, "id"), ["id", "c", "n", "sig"], salt)).distinct(), "forest")
        more = materialize(_confirmed(tree, sets, percent), "links")
        done += [tree, more]
        if more.isEmpty():
            break
        labels = _grown(labels, more)
        settle(df.sparkSession)
        wide = materialize(_unsettled(labelled(wide.select("id", "key", "band", "members"))), "unsettled")
        done.append(wide)
    still = still.unionByName(wide)

    still = still.join(reps.select("id", "n", "keys", "sig"), "id")
    lists = _small_sides(still, ["id", "c", "n", "sig", "keys"], BLOCK)
    open_ = lists.select("key", F.explode(_in_blocks("open", most, percent, width)("lists", "band")).alias("id")).distinct()
    open_ = materialize(still.drop("main", "all", "most").join(open_, ["key", "id"]), "open")
    done.append(open_)
    settle(df.sparkSession)
    # small buckets and large ones one after the other: all their stages at once are the most that the driver has to hold
    block, more = BLOCK // 4, None
    for large in (False, True):
        part = open_.filter((F.col("members") > block) == large)
        if part.isEmpty():
            continue
        if large:
            part = materialize(_counted(part), "counted")
            done.append(part)
        lists = _small_sides(part.join(sets, "id"), ["id", "c", "n", "sig", "keys", "set"], block)
        links = lists.select(F.explode(_in_blocks("links", most, percent, width)("lists", "band")).alias("p")).select("p.*")
        links = materialize(links, "links")
        done.append(links)
        more = links if more is None else more.unionByName(links)
    labels = labels if more is None else _grown(labels, more)
    discard(reps, *done)
    settle(df.sparkSession)

    named = classes.join(labels, "node", "left").filter("copies > 1 OR component IS NOT NULL")
    if not classes.filter("node <> rep").isEmpty():  # a component is named by an identifier, not by a node
        low = named.filter("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("low"))
        named = named.join(low, "component", "left").withColumn("component", F.col("low"))
    named = named.select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    out = table.select("id", "h", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *(["h"] if with_hash else []),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input with one document of each group, columns unchanged; rows that repeat identifier and text stay or go together."""
    gone = near_duplicates(df, id_col, text_col, with_hash=True, **options).filter("NOT kept").select(F.col(id_col).alias("__gone"), F.col("h").alias("__h")).distinct()
    same = (F.col(id_col).cast("long") == F.col("__gone")) & (F.xxhash64(text_col) == F.col("__h"))
    return df.join(gone.hint("merge"), same, "left_anti")
