"""Secrets, hard negatives and prefix tries against brute force, and their edges."""

import hashlib
import random
import re
import string
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from siftline.llm import negatives, queries, secret_scan, trie

DATA = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_prefix_trie"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, DATA)
    assert set(df.columns) == set(want.columns)
    assert sorted(map(tuple, df.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# ---- secrets


def base_by_hand(text):
    """The base patterns, run by run, as they are worded."""
    found = []
    low = "".join(c.lower() if c in string.ascii_uppercase else c for c in text)
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""", low):
        found += [(m.start(), 0, "assign", m.end())] if len(m[2]) > 5 else []
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) > 19]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) > 23]
    return [f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found)]


def test_base_spans_equal_the_wording():
    rng = random.Random(4)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "apiKEy", " ", "  ", ":", "=", '"', "'", "AKIA", "AKI", "abc", "ABC123", "0a9f" * 5, "deadbeef", "é", "🙂", "ſecret", "toKen", ".", "-", "x" * 6, "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))
        got = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e, _ in secret_scan.base_spans(text)]
        assert got == base_by_hand(text), text


def test_markov_models_find_planted_keys_and_leave_names_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = secret_scan.fit(docs)
    rng = random.Random(9)
    alphabets = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, "0123456789abcdef")
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (20, 23, 32, 64) for _ in range(50)]
    # a hexadecimal run of 24 and more is a base finding, whatever it scores
    found = sum(bool(model.spans(f"see {k} there", 20.0)) for k in keys)
    assert found >= 0.99 * len(keys)
    names = [n for n in secret_scan.generated_identifiers(200, seed=77) if len(n) >= 16]
    marked = sum(bool(model.spans(n, 20.0)) for n in names)
    assert marked <= 0.01 * len(names)
    clean = [r for r in secret_scan.scan(docs, model).collect() if any(f.kind == "random" for f in r.findings)]
    assert not clean  # the tables' secrets are all of known form


def test_secret_query_derives_the_contract_columns(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op11_secrets(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = base_by_hand(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k + ":") for b in base) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == base


def test_secret_edges(spark):
    key = "".join(random.Random(1).choice(string.ascii_letters + string.digits) for _ in range(40))
    texts = [None, "", "é" * 100000 + key, key, key, f"token={key}", f"a {key} b AKIA{'A' * 16}"]
    df = spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(texts)], "doc_id long, text string, findings string, label int")
    model = secret_scan.fit(df)
    assert secret_scan.fit(df.filter("false")).spans(key, 20.0)
    out = {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in secret_scan.scan(df, model).collect()}
    assert out[0] == out[1] == []
    assert out[2] == [("random", 100000, 100040)]
    assert out[3] == out[4] == [("random", 0, 40)]
    assert out[5] == [("assign", 0, 46)]
    assert out[6] == [("random", 2, 42), ("access", 45, 65)]
    shown = {r.doc_id: r.text for r in secret_scan.redact(secret_scan.scan(df, model)).collect()}
    assert shown[0] is None and shown[6] == "a [secret] b [secret]" and shown[5] == "[secret]"
    assert secret_scan.scan(df.filter("false"), model).count() == 0


# ---- hard negatives


def mined(rows, scale=256.0, positives=5, negatives_=3, step=50):
    """Every anchor against every row, by integers."""
    rows = [
        (i, label, [int(np.floor(scale * float(x))) for x in v]) for i, v, label in rows
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    last, out = 2**63, []
    for n, (a, label, v) in enumerate(rows):
        if a is None or a % step:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), last if i is None else i, m == label) for k, (i, m, w) in enumerate(rows) if k != n and len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2]][:positives]:
            hits = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives_]
            out += [(a, None if i == last else i, r + 1, None if j == last else j, -s, -t) for r, (t, j, _) in enumerate(hits)]
    return sorted(out, key=repr)


def answers(spark, rows, **options):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, score string")
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect()), key=repr)


def test_hard_negatives_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8)) * 0.5
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.05).round(2).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    hot = rows[0][1]
    rows += [(400 + i, hot, i % 2) for i in range(200)]  # a third of all rows is one vector
    rows += [(50, rows[7][1], 1), (50, rows[50][1], rows[50][2]), (None, rows[3][1], 0), (None, hot, 1)]
    rows += [(1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * 8, 1), (1150, [float("inf")] * 8, 1), (1200, hot, None)]
    rows += [(1250, [0.0] * 8, 1), (1300, [0.5, 0.5], 1), (1301, [0.4, 0.4], 2), (1302, [0.9, 0.1], 1), (1350, [], 1), (1351, [], 1), (1352, [], 2)]
    want = mined(rows)
    assert len(want) > 100
    assert answers(spark, rows) == want
    assert answers(spark, rows, per_list=16, most=64) == want  # many lists: several rounds and stops


def test_hard_negatives_visit_few_lists(spark):
    """Queries stop before they have seen all lists where vectors have clusters."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    x = np.floor((centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 16)) * 0.02) * 256)
    c = negatives.kmeans(x, 40)
    near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    r = np.array([np.sqrt(((x[near == i] - c[i]) ** 2).sum(1)).max(initial=0) for i in range(len(c))])
    high, low = negatives.bounds(x[:50], c, r)
    s = x[:50] @ x.T
    assert (s <= high[:, near]).all() and (s >= low[:, near]).all()
    kth = np.sort(s, 1)[:, -6]
    assert (high >= kth[:, None]).mean() < 0.3


def test_hard_negative_edges(spark):
    assert answers(spark, []) == []
    assert answers(spark, [(50, [1.0], 1)]) == []
    big = [(0, [1e7, 1.0], 1), (1, [1e7, 0.0], 1), (2, [0.9e7, 1.0], 2), (3, [1e30, 0.0], 3)]
    assert [r[:4] for r in answers(spark, big)] == [(0, 1, 1, 2)]  # beyond 2**53; what saturates lies in no window


# ---- prefix tries


def trie_by_hand(rows):
    """The node table by dictionaries."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turn_key = (turn is not None, turn or 0)
            turns[c].append((turn_key, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in turns.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[q] for q in children[p]]
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        sums[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + own_saved)
        ends = ",".join(str(c) for c in members[p] if len(rebuilt[c]) == len(p))
        parent = members[p[:-1]][0] if p else None
        out.append((members[p][0], len(p), parent, len(members[p]), len(children[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], CONV + ", node string, depth int")
    out = trie.prefix_trie(trie.spliced(df), **options)
    return sorted(map(tuple, out.drop("n_ends", "points", "node", "parent").collect()), key=repr)


@pytest.mark.parametrize("limit", [1024, 3])
def test_tries_equal_brute_force(spark, limit):
    rng = random.Random(8)
    words = ["", "a", "b", "漢字", "🙂 x"]
    rows = []
    for c in range(300):
        for t in range(rng.randrange(1, 9)):
            rows.append((c * 3 - 90, None if t == 0 and c % 4 == 0 else t, rng.choice(["user", None]), rng.choice(words)))
    rows += [(2000 + i, t, "user", "hot " * t) for i in range(150) for t in range(6)]  # copies
    rows += [(1500 + i, t, "user", "hot " * t) for i in range(30) for t in range(i % 6 + 1)]  # that stop earlier
    rows += [(99999, t, "user", f"turn {t}") for t in range(700)]  # one long conversation over many partitions
    rows += [(99998, t, "user", f"turn {t}") for t in range(650)]
    rows += [(None, 0, "user", "nobody"), (7777, 1, None, None)]
    rng.shuffle(rows)
    assert trie_rows(spark, rows, limit=limit, pack=16) == trie_by_hand(rows)


def test_trie_edges(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []
    rows = [(101, 0, "user", "x"), (101, 0, "user", "x")]  # repeated rows are turns of their own
    assert trie_rows(spark, rows) == trie_by_hand(rows)
    bare = [(c, 0, "user", "x") for c in range(101, 140)]  # no base: some are left without turns
    assert trie_rows(spark, bare) == trie_by_hand(bare)
    text = "y" * 300000
    assert trie_rows(spark, [(100, 0, "u", text), (101, 0, "u", text)]) == trie_by_hand([(100, 0, "u", text), (101, 0, "u", text)])


def test_louds_bits_name_parents_and_children():
    parent = np.array([-1, 0, 0, 1, 1, 1, 2, 6])
    t = trie.Louds(parent, np.array([0, 2, 1, 5, 4, 3, 9, 9]))
    assert t.order.tolist() == [0, 2, 1, 6, 5, 4, 3, 7]
    assert "".join(map(str, t.bits)) == "10" + "110" + "10" + "1110" + "10" + "0000"
    assert t.parents().tolist() == [-1, 0, 0, 1, 2, 2, 2, 3] and t.degrees().tolist() == [2, 1, 3, 1, 0, 0, 0, 0]
    assert t.rolled_up(np.ones(8, np.int64))[0].tolist() == [8, 3, 4, 2, 1, 1, 1, 1]


def test_ends_of_a_hot_node_are_hashed_in_order(spark):
    ends = spark.range(20000).selectExpr("0L AS k1", "if(id % 3 = 0, 1L, 0L) AS k2", "id * 7 AS conv").repartition(5)
    got = {r.k2: (r.n_ends, r.ends_sha256) for r in trie.end_digests(ends).collect()}
    for k2 in (0, 1):
        ids = [i * 7 for i in range(20000) if (i % 3 == 0) == bool(k2)]
        assert got[k2] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
