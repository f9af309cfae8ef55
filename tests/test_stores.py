"""Nested JSON, crawls over links, committed batches, names in texts."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F
from siftline.functions import nested
from siftline.operators import frontier, ledger, mentions


def clean(value):
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items() if not re.search(nested.SECRET_KEYS, k)}
    if isinstance(value, list):
        return [clean(v) for v in value]
    return "[redacted]" if isinstance(value, str) and re.search(nested.BEARER, value) else value


def test_redaction_at_every_depth(spark):
    rng = random.Random(3)

    def grown(depth):
        if depth == 0:
            return rng.choice([1, -2.5, True, None, "x", "é\"\\\n", "Bearer abc.d", "see bearer x1 there", "plain Bearer"])
        if rng.random() < 0.4:
            return [grown(depth - 1) for _ in range(rng.randrange(3))]
        return {k: grown(depth - 1) for k in rng.sample(["a", "b", "apiKey", "x_secret", "Password", "key", "quo\"te", "access-token"], rng.randrange(4))}

    values = [grown(d) for d in range(11) for _ in range(8)] + [{"a": {}}, {"password": 1}, [[]], {"a": [{"secret": 1, "k": [{"credentials": 2}]}]}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(1000, None), (1001, ""), (1002, "{oops"), (1003, '{"a":1,"a":2}')]
    df = spark.createDataFrame(rows, "i long, j string")
    got = {r.i: r.x for r in df.select("i", nested.redacted(F.col("j")).alias("x")).collect()}
    want = lambda v: json.dumps(clean(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert [got[i] for i in range(len(values))] == [want(v) for v in values]
    assert got[1000] is got[1001] is got[1002] is None
    same = df.filter("i < 1000").select("i", nested.canonical(F.col("j")).alias("x")).collect()
    assert all(r.x == json.dumps(values[r.i], sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in same)
    keys = spark.createDataFrame([("f", '{"b":1,"a":2}'), ("f", '{ "a": 2, "b": 1 }'), ("g", None)], "n string, a string").select(nested.call_key(F.col("n"), F.col("a")).alias("k")).collect()
    assert [r.k for r in keys] == ['f:{"a":2,"b":1}', 'f:{"a":2,"b":1}', "g:null"]


def test_frontier(spark):
    links = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("d", "a"), ("c", "d"), ("d", "e"), ("z", "z"), (None, "q"), ("a", None), ("a", "b")], "from_url string, to_url string")
    seeds = spark.createDataFrame([("s", "a"), ("s", "a"), ("t", "z"), ("u", "d"), ("v", None)], "source string, url string")
    pages, stops = frontier.reached(seeds, links)
    assert sorted((r.source, r.url, r.depth) for r in pages.collect()) == [("s", "a", 0), ("s", "b", 1), ("s", "c", 1), ("s", "d", 2), ("s", "e", 3), ("t", "z", 0), ("u", "a", 1), ("u", "b", 2), ("u", "c", 2), ("u", "d", 0), ("u", "e", 1)]
    assert {r.source: (r.pages, r.stop) for r in stops.collect()} == {"s": (5, "exhausted"), "t": (1, "exhausted"), "u": (5, "exhausted")}
    pages, stops = frontier.reached(seeds, links, most_depth=1)
    assert {r.source: (r.pages, r.stop) for r in stops.collect()} == {"s": (3, "depth"), "t": (1, "exhausted"), "u": (3, "depth")}
    pages, stops = frontier.reached(seeds, links, budget=2)
    assert {r.source: (r.pages, r.stop) for r in stops.collect()} == {"s": (2, "budget"), "t": (1, "exhausted"), "u": (2, "budget")}
    assert sorted(r.url for r in pages.filter("source = 's'").collect()) == ["a", "b"]
    assert frontier.reached(seeds.limit(0), links)[0].count() == 0


def test_batches_commit_once_and_whole(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/book")
    assert book.rows() is None and book.state() is None
    rows = spark.range(10).withColumn("v", F.when(F.col("id") == 4, None).otherwise(F.col("id") * 2))
    checks = {"v": F.col("v") < 16, "even": F.col("id") % 2 == 0}
    dry = book.append(rows, "x", checks, dry=True)
    assert (dry["written"], dry["rejected"], dry["status"]) == (3, 7, "PARTIAL") and book.manifests() == []
    first = book.append(rows, "one", checks)
    assert (first["written"], first["rejected"], first["reasons"]) == (3, 7, {"v": 3, "even": 5})
    assert book.append(rows.limit(1), "one", checks) == first  # known: the tally it had
    assert sorted(r.id for r in book.rows().collect()) == [0, 2, 6]
    assert {r.id: list(r["__failed"]) for r in book.rows(rejected=True).collect()}[9] == ["v", "even"]
    with pytest.raises(Exception, match="boom"):  # a task that fails leaves the table as it was
        book.append(rows.withColumn("v", F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("v"))), "two")
    assert [m["batch"] for m in book.manifests()] == ["one"] and book.rows().count() == 3
    assert book.append(rows, "two")["status"] == "COMPLETED" and book.rows().count() == 13
    assert book.append(rows.filter("false"), "none")["status"] == "COMPLETED"


def test_upserts_keep_protected_columns(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/book")
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, v string, seen string")
    assert book.upsert(make((1, "a", "d1"), (2, None, "d1")), "one", ["k"], ["seen"])["created"] == 2
    second = book.upsert(make((2, None, "d2"), (1, "b", "d2"), (3, "c", "d2")), "two", ["k"], ["seen"])
    assert (second["created"], second["updated"], second["unchanged"], second["absent"]) == (1, 1, 1, 0)
    assert book.upsert(make((9, "z", "d9")), "two", ["k"]) == second
    assert sorted(map(tuple, book.state().collect())) == [(1, "b", "d1"), (2, None, "d1"), (3, "c", "d2")]
    sync = ledger.synced(make((1, "a", ""), (2, None, ""), (3, "c", "")), make((3, "", "")), "k", F.col("v").isNotNull())
    assert {r.k: r.sync for r in sync.collect()} == {1: "appended", 2: "failed", 3: "skipped"}


def test_names_equal_brute_force(spark):
    rng = random.Random(6)
    parts = ["hack", "Hack", "club", "c++", "a.b", "é", "o'neil", "(x)", "42", "_u", "the", "The", "-", "straße", "[z]"]
    names = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 4)))) for i in range(60)] + [(90, "ab"), (91, " hack "), (92, None), (93, "---"), (94, "club")]
    texts = [(i, "".join(rng.choice(parts + [" ", " ", ",", "x"]) for _ in range(60))) for i in range(80)] + [(900, None), (901, ""), (902, "hackclub Hack-club")]
    got = mentions.mentioned(spark.createDataFrame(texts, "t long, body string"), spark.createDataFrame(names, "n long, name string"), "t", "body", "n", "name")
    want = set()
    for t, body in texts:
        for n, name in names:
            name = (name or "").strip(" ")
            if body and len(name) >= 3 and re.search(r"[A-Za-z0-9_]", name) and re.search(rf"\b{re.escape(name)}\b", body, re.IGNORECASE | re.ASCII):
                want.add((t, n))
    assert {(r.t, r.n) for r in got.collect()} == want and want
    order = mentions.longest(spark.createDataFrame([(1, "bb"), (1, "aaa"), (1, "aa")], "t long, name string"), "t").first()
    assert order.names == ["aaa", "aa", "bb"]


def test_names_in_either_case_of_accented_letters(spark):
    texts = [(1, "la. éai Éonleeau"), (2, "LA. ÉAI ÉONLEEAU"), (3, "la. eai eonleeau"), (4, "ma\u017ft"), (5, "\u017fmast"), (6, "m\u0131st"), (7, "\u212aelvin")]
    names = [(1, "La. Éai éonleeau"), (2, "mast"), (3, "MIST"), (4, "kelvin")]
    got = mentions.mentioned(spark.createDataFrame(texts, "t long, body string"), spark.createDataFrame(names, "n long, name string"), "t", "body", "n", "name")
    # long s and Kelvin are s and k but no word characters; a dotless i is no i
    assert {(r.t, r.n) for r in got.collect()} == {(1, 1), (2, 1), (4, 2), (5, 2)}
