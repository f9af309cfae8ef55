"""Exact, near and substring dedup, and vectors, against brute force on small fixtures."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from siftline.llm import embedding, exact_dedup, minhash, mixing, substring
from siftline.llm.graph import connected_components

SCHEMA = "doc_id long, text string, kept string, Keep_Id string"


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 10, 40, 90])) for _ in range(25)]
    out = [None, "", " \n\t ", "a", "one two three", "one two three", "ONE two three"]
    out += base + base[:6]
    for text in base[:12]:  # near copies: a few words changed
        w = text.split()
        for i in range(0, len(w), 23):
            w[i] = "changed"
        out.append(" ".join(w))
    passage = words(rng, 30)
    out += [words(rng, 12) + " " + passage + " " + words(rng, 9) for _ in range(4)]
    out += ["again " * 70, " ".join(["x y z"] * 30), "é ü " * 30, words(rng, 5000)]
    ids = rng.sample(range(1000), len(out))
    return list(zip(ids, out))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", "old") for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_groups(spark, rows, keep, fan_in):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(frame(spark, rows), keep=keep, fan_in=fan_in).collect()}
    groups: dict[str, list[int]] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: (min if keep == "smallest" else max)(ids) for t, ids in groups.items()}
    assert got == {i: (best[t or ""], len(groups[t or ""]), best[t or ""] == i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_exact_edges(spark, rows):
    df = frame(spark, [*rows, rows[8], rows[8], (None, "one two three"), (None, "alone")])
    out = exact_dedup.exact_groups(df, keep="largest")
    assert out.count() == len(rows) + 4
    alone = [r for r in out.collect() if r.doc_id is None]
    assert sorted((r.group_size, r.kept) for r in alone) == [(1, True), (3, False)]
    kept = exact_dedup.deduplicate(df, keep="largest")
    assert kept.columns == df.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t in rows} | {"alone"})
    assert exact_dedup.exact_groups(df.filter("false")).count() == 0


def brute_components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, rows, k):
    rows = sorted(rows)
    sets = [shingles(t, k) for _, t in rows]

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both and 100 * both >= 80 * len(sets[a] | sets[b])

    roots = brute_components(len(rows), linked)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), k=k).collect()}
    assert got == {i: (len(s), rows[r][0], rows[r][0] == i) for (i, _), s, r in zip(rows, sets, roots)}


def test_near_duplicates_in_a_drifting_group(spark):
    """A large group whose ends are far apart, held together by links within a wide bucket."""
    rng = random.Random(9)
    start = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(150):
        w = list(start)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(80)] = f"z{rng.randrange(10000)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets = [shingles(t, 4) for t in texts]
    roots = brute_components(len(rows), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), k=4).collect()}
    assert got == dict(enumerate(roots))


@pytest.mark.parametrize("block", [16, 512])
def test_near_duplicates_in_buckets_of_many_blocks(spark, monkeypatch, block):
    """Large groups side by side, joined by few links, with buckets cut into many small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(11)
    texts = []
    for g in range(3):
        start = [f"w{i}" if i < 55 else f"g{g}x{i}" for i in range(80)]  # groups that share most words
        for _ in range(90):
            w = list(start)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(80)] = f"z{rng.randrange(10000)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    sets = [shingles(t, 4) for t in texts]
    roots = brute_components(len(rows), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), k=4).collect()}
    assert got == dict(enumerate(roots))


def test_near_duplicates_of_repeated_identifiers(spark):
    """Rows that share an identifier are documents of their own, named by the smallest identifier they reach."""
    rng = random.Random(12)
    a, b, c = (words(rng, 60, 10_000).split() for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(c)), (3, near(b)), (5, " ".join(c[:50]) + " other end"), (5, "on its own"), (4, near(c))]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), k=4).collect())
    # the second row of 5 has another text than the first, and nothing near it
    assert got == [(1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False), (4, 2, False), (5, 5, True), (5, 5, True)] or got == [
        (1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False), (4, 2, False), (5, 2, False), (5, 5, True),
    ]
    kept = sorted((r.doc_id, r.text[:6]) for r in minhash.keep_one(frame(spark, rows), k=4).collect())
    assert (5, "on its") in kept and (3, near(b)[:6]) not in kept and (4, near(c)[:6]) not in kept and len([x for x in kept if x[0] == 1]) == 2


def test_near_duplicate_edges(spark, rows):
    df = frame(spark, [*rows, rows[9], (None, rows[9][1])])
    out = minhash.near_duplicates(df).collect()
    assert len(out) == len(rows) + 2
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(df.filter("false")).count() == 0
    long = frame(spark, [(1, "a b c d e f g " * 60_000), (2, "a b c d e f g " * 60_000 + "h"), (3, None)])
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(long).collect()) == [(1, 1), (2, 1), (3, 3)]
    kept = minhash.keep_one(frame(spark, rows), k=5)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def brute_removed(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        left = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("shard_words", [300, 150_000])
def test_repeated_passages(spark, rows, shard_words):
    out = substring.repeated_passages(frame(spark, rows), shard_words=shard_words).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_removed(rows)
    assert all(sum(g.end - g.start for g in r.gone) == r.n_removed for r in out)


def test_repeated_passage_edges(spark, rows):
    text = next(t for _, t in rows if t and 30 < len(t.split()) < 100)
    df = frame(spark, [(1, text), (1, text), (None, text), (2, None), (3, "")])
    got = sorted((r.doc_id is None, r.n_removed) for r in substring.repeated_passages(df).collect())
    n = len(text.split())
    assert got == [(False, 0), (False, 0), (False, 0), (False, n), (True, n)]
    assert substring.repeated_passages(df.filter("false")).count() == 0


def test_repeated_passages_of_rows_that_share_an_identifier(spark):
    """Null and repeated identifiers with different texts, of which only some are copies."""
    rng = random.Random(8)
    a, b, c, d = (words(rng, 40, size=10_000) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, "few words"), (5, a), (5, c), (None, d), (None, d)]
    out = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_passages(frame(spark, rows)).collect()]
    none = hashlib.sha256(b"").hexdigest()

    def whole(i, t):
        return i, len(t.split()), 0, hashlib.sha256(t.encode()).hexdigest()

    want = [whole(1, a), (None, 40, 40, none), whole(None, b), whole(None, "few words"), (5, 40, 40, none), whole(5, c), whole(None, d), (None, 40, 40, none)]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_null_identifiers_spread_over_shards(spark):
    """A third of all rows has no identifier; of two that share a passage one loses it, whichever shard they are in."""
    rng = random.Random(12)
    rows = [(i, words(rng, 60, size=50_000)) for i in range(120)]
    shared = [words(rng, 30, size=50_000) for _ in range(30)]
    for p in shared:
        rows += [(None, f"{words(rng, 25, size=50_000)} {p} {words(rng, 25, size=50_000)}") for _ in range(2)]
    df = frame(spark, rows)
    out = substring.repeated_passages(df, shard_words=500).collect()  # about thirty shards
    assert sorted(r.n_removed for r in out if r.doc_id is None) == [0] * 30 + [30] * 30
    assert all(r.n_removed == 0 for r in out if r.doc_id is not None) and len(out) == 180
    key = F.pmod(F.xxhash64(F.unhex(F.sha2("text", 256))), F.lit(1024))
    dealt = df.select(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(2**63 - 1)), key), F.lit(8)).alias("s")).groupBy("s").count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]


def test_mixing_places_null_identifiers_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 10)
    rows = [(None if i % 3 else i, f"w{i} " * (i % 7 + 1), "a") for i in range(300)]
    mix = mixing.Mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=4)
    placed = mix.placed().collect()
    spans = sorted((r.start, r.start + r["size"]) for r in placed if r["size"])
    assert len(placed) == 300 and spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    held = mix.docs.filter("id IS NULL").select(F.pmod(F.xxhash64("id", "h", F.lit(mix.seed)), F.lit(mix.sources[0]["chunks"])).alias("c")).groupBy("c").count().collect()
    assert len(held) > 20 and max(r["count"] for r in held) < 30


def test_automata_find_every_occurrence(monkeypatch):
    for most in (substring.WORDS, 5):  # with few words the patterns need several automata
        monkeypatch.setattr(substring, "WORDS", most)
        found = substring.Automata([(b"a", b"b", b"c"), (b"b", b"c", b"\xff"), (b"q", b"r", b"s")], 3)
        text = [b"x", b"a", b"b", b"c", b"\xff", b"a", b"b", b"c", b"q", b"r", b"s"]
        assert np.flatnonzero(found.located(text)).tolist() == [1, 2, 5, 8]
    assert not substring.Automata([], 3).located([b"a", b"b", b"c"]).any()
    many = [b"w%d" % i for i in range(3000)]  # more words than there are letters
    found = substring.Automata([tuple(many[i : i + 3]) for i in range(0, 2998, 7)], 3)
    assert np.flatnonzero(found.located(many)).tolist() == list(range(0, 2998, 7))


def test_only_the_automata_locate(monkeypatch):
    """One shard, run here: without a phrase, or with blind automata, nothing is found."""
    import pyarrow as pa
    import zstandard

    rng = random.Random(3)
    passage = words(rng, 60).split()
    texts = [passage, ["new"] + passage]
    zip_ = zstandard.ZstdCompressor()
    docs = pa.table({"id": [1, 2], "key": [0, 0], "packed": [zip_.compress(" ".join(w).encode()) for w in texts]})

    def removed(places):
        marks = pa.table({
            "kind": pa.array([0] * len(places), pa.int32()), "id": pa.array([1] * len(places), pa.int64()), "key": pa.array([0] * len(places), pa.int64()),
            "place": pa.array(places, pa.int32()), "digest": pa.array([None] * len(places), pa.binary()),
        })
        out = substring._located(20, 9)(docs, marks).to_pylist()
        return [sum(b - a for a, b in np.frombuffer(r["marked"] or b"", np.int32).reshape(-1, 2).tolist()) for r in out]

    every = list(range(52))
    assert removed(every) == [0, 41]
    assert removed([]) == [0, 0]
    some = removed(every[:20])[1]
    assert 0 < some < 41
    monkeypatch.setattr(substring.Automata, "located", lambda self, w: np.zeros(len(w), bool))
    assert removed(every) == [0, 0]


def test_governors_are_the_rightmost_smallest(monkeypatch):
    rng = np.random.default_rng(1)
    for stretch, width, n in ((1 << 20, 12, 500), (16, 5, 300), (16, 1, 40), (16, 7, 3)):
        monkeypatch.setattr(substring, "_STRETCH", stretch)
        g = (rng.integers(0, 9, n).astype(np.uint64) << np.uint64(40)) + np.uint64(5)
        want = [i + width - 1 - int(g[i : i + width][::-1].argmin()) for i in range(max(0, n - width + 1))]
        assert substring.governors(g, width).tolist() == want


def test_gram_hashes_tell_order_and_length():
    from siftline.llm.common import gram_hashes

    h = np.random.default_rng(2).integers(0, 2**63, 60).astype(np.uint64)
    h[30:50] = h[5:25]
    for n in (1, 2, 3, 4, 5, 9, 20):
        g = gram_hashes(h, n)
        assert len(g) == 61 - n and g[5] == g[30] and len(set(g.tolist())) == 61 - n - (21 - n)
        assert gram_hashes(h[::-1].copy(), n)[-1 - 5] != g[5] or n == 1
        assert not np.array_equal(gram_hashes(h, n, seed=1), g) and gram_hashes(h, n, seed=1)[5] == gram_hashes(h, n, seed=1)[30]
    assert len(gram_hashes(h[:3], 4)) == 0


def test_windows_are_compared_word_for_word():
    others = [[b"a"] * 30, [b"a"] * 25 + [b"b"] * 5]
    p, d1, p1 = np.arange(8), np.full(8, 1), np.arange(8)
    assert substring.verified(p, d1, p1, others[0], others, 20).tolist() == [True] * 6 + [False] * 2


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows, n = [], 0
    for label in (0, 1, None):
        for b in base:
            for _ in range(6):
                rows.append((n, (b + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.4])).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 0), (n + 2, rows[0][1], 1), (n + 3, [0.0] * 16, 0), (n + 4, None, 0), (n + 5, [float("nan")] * 16, 0)]
    rows += [(n + 6, [None] * 16, 0), (n + 7, [float("inf")] + [0.0] * 15, 0), (n + 8, [], 0), (n + 9, [1e-300] * 16, 0), (n + 10, [1e300] * 16, 0)]
    x = [np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() if v and None not in v and np.isfinite(v).all() and any(v) else None for _, v, _ in rows]
    ok = [u is not None and label is not None for u, (_, _, label) in zip(x, rows)]

    def linked(a, b):
        return ok[a] and ok[b] and rows[a][2] == rows[b][2] and float(x[a] @ x[b]) >= 0.98

    roots = brute_components(len(rows), linked)
    links = [sum(linked(a, b) for b in range(len(rows)) if a != b) for a in range(len(rows))]
    df = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, kept string")
    for per_cell in (2048, 4):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_vectors(df, per_cell=per_cell).collect()}
        assert got == {i: (links[i], roots[i], roots[i] == i) for i in range(len(rows))}
    assert embedding.near_vectors(df.filter("false")).count() == 0
    assert embedding.keep_one(df).count() == sum(r == i for i, r in enumerate(roots))


def test_vectors_of_many_labels_and_deep_cells(spark, monkeypatch):
    """More labels than any model could list, one of them hot, split several times over."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 8))
    rows = [(i, (base[i % 30] + rng.normal(size=8) * 0.08).tolist(), 0) for i in range(600)]
    rows += [(598 + 2 * k + j, (base[k % 30] + rng.normal(size=8) * 0.05).tolist(), k) for k in range(1, 1501) for j in range(2)]
    x = np.array([np.array(v) / np.linalg.norm(v) for _, v, _ in rows])
    label = np.array([k for *_, k in rows])
    hit = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(hit, False)
    links = hit.sum(1)
    root = np.arange(len(rows))
    while True:
        low = np.minimum(root, np.where(hit, root[None], len(rows)).min(1))
        if (low == root).all():
            break
        root = low
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_vectors(df, per_cell=8, sample=64).collect()}
    assert got == {i: (int(links[i]), int(root[i])) for i in range(len(rows))}


def test_very_long_vectors(spark):
    v = np.random.default_rng(1).normal(size=50_000)
    df = spark.createDataFrame([(1, v.tolist(), 0), (2, (v + 1e-3).tolist(), 0), (3, (-v).tolist(), 0)], "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: r.n_links for r in embedding.near_vectors(df).collect()} == {1: 1, 2: 1, 3: 0}


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (11, 12), (12, 10), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 10: 10, 11: 10, 12: 10}


def test_a_group_of_near_copies_is_held_once_and_settled_at_once(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(words)))
    seen = {}
    real = minhash.materialize

    def spied(df, tag):
        out = real(df, tag)
        seen.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(minhash, "materialize", spied)
    monkeypatch.setattr(minhash, "BLOCK", 64)
    assert {r.component_id for r in minhash.near_duplicates(frame(spark, rows), k=4).collect()} == {0}
    # what is joined to members is joined once for each, not once per band, and no bucket is gone through again
    assert seen["members"][0] <= 300 and seen["unsettled"] == [0]


def test_the_first_bands_settle_a_group_of_near_copies_for_the_others(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(words)))
    placed = []
    real = minhash.materialize

    def spied(df, tag):
        out = real(df, tag)
        if tag == "members":
            placed.append(out.selectExpr("coalesce(sum(size(places)), 0) AS n").first().n)
        return out

    monkeypatch.setattr(minhash, "materialize", spied)
    assert {r.component_id for r in minhash.near_duplicates(frame(spark, rows), k=4).collect()} == {0}
    # not up to 32 rows joined for each member: those of the first bands, and none of settled buckets
    assert 0 < sum(placed) <= 300 * minhash.EARLY


def _rows_joined_by_key(spark, after):
    """Rows that joins by the bucket's key made in executions after one."""
    store, made = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        if run <= after:
            continue
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and node.desc().split("[", 1)[1].startswith("key#"):
                metrics = node.metrics()
                for m in (metrics.apply(i) for i in range(metrics.size())):
                    if m.name() == "number of output rows" and (v := values.get(m.accumulatorId())).isDefined():
                        made += int(v.get().replace(",", ""))
    return made


def test_small_buckets_are_joined_to_nothing_when_their_groups_are_compared(spark, monkeypatch):
    rng = random.Random(17)
    base = words(rng, 120, 10**6).split()
    rows = []
    for i in range(60):  # alike enough to share buckets, too little to be linked
        w = list(base)
        for at in rng.sample(range(120), 5):
            w[at] = f"x{i}"
        rows.append((i, " ".join(w)))
    placed, real = [], minhash.materialize

    def spied(df, tag):
        out = real(df, tag)
        if tag == "members":
            placed.append(out.selectExpr("coalesce(sum(size(places)), 0) AS n").first().n)
        return out

    monkeypatch.setattr(minhash, "materialize", spied)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    last = max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows), k=4).collect()}
    assert len(set(got.values())) > 30 and sum(placed) > 500
    assert _rows_joined_by_key(spark, last) <= 1.5 * sum(placed)


def test_further_links_go_through_what_they_join_only(spark, monkeypatch):
    edges = lambda *pairs: spark.createDataFrame(list(pairs), "a long, b long")
    first, more = [(1, 2), (2, 3), (5, 6), (8, 9)], [(3, 1), (6, 3), (9, 20), (30, 31), (20, 40)]
    labels = minhash._grown(None, edges(*first))
    want = {tuple(r) for r in connected_components(edges(*first, *more)).collect()}
    seen = []
    monkeypatch.setattr(minhash, "connected_components", lambda e: (seen.append({tuple(r) for r in e.filter("a <> b").select("a", "b").collect()}), connected_components(e))[1])
    grown = minhash._grown(labels, edges(*more))
    assert {tuple(r) for r in grown.collect()} == want
    assert seen == [{(5, 1), (8, 20), (30, 31), (20, 40)}]
    assert {tuple(r) for r in minhash._grown(grown, edges((40, 8), (6, 2))).collect()} == want
    assert minhash._grown(minhash._grown(None, edges()), edges((7, 4))).count() == 2
