"""Upserts, resolution, views and streams on small scenarios."""

from pyspark.sql import functions as F
from siftline.operators import resolve, rules, upsert, views
from siftline.streaming import log


def test_plan_and_snapshot(spark):
    old = spark.createDataFrame([(1, "a", "S"), (2, "b", "S"), (3, None, "S")], "id long, v string, status string")
    new = spark.createDataFrame([(2, "B", "N"), (3, None, "N"), (4, "d", "N")], "id long, v string, status string")
    assert dict(upsert.plan(old, new, "id", ["v"]).collect()) == {1: "absent", 2: "update", 3: "unchanged", 4: "create"}
    rows = {r.id: (r.v, r.status) for r in upsert.snapshot(old, new, "id", ["v"], ["status"]).collect()}
    assert rows == {1: ("a", "S"), 2: ("B", "S"), 3: (None, "S"), 4: ("d", "N")}
    again = upsert.plan(upsert.snapshot(old, new, "id", ["v"], ["status"]), new, "id", ["v"]).filter("action IN ('create', 'update')")
    assert again.count() == 0
    assert upsert.parity(old, old, ["id"], ["v"]).first().asDict() == {"missing": 0, "v_differs": 0}


def test_coalesce_field(spark):
    row = spark.range(1).select(
        upsert.coalesce_field(F.lit(""), F.lit("x")).alias("a"), upsert.coalesce_field(F.lit("7/16"), F.lit("2026-07-16")).alias("b"), upsert.coalesce_field(F.lit("k"), F.lit("x")).alias("c")
    ).first()
    assert tuple(row) == ("x", "2026-07-16", "k")


def test_resolution_follows_chains_and_prefers_authority(spark):
    keys = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (2, "t", "b"), (3, "t", "b"), (4, "u", "z"), (5, "t", None), (6, "t", "")], "ordinal long, kind string, key string")
    records = spark.createDataFrame([(i, a, n) for i, a, n in [(1, 10, "low"), (2, 80, None), (3, 80, "best"), (4, 5, "own"), (5, 5, "x"), (6, 5, "y")]], "ordinal long, authority int, name string")
    out = {r.root: (r.members, r.name) for r in resolve.resolve(records, keys, ["name"]).collect()}
    assert out == {1: (3, "best"), 4: (1, "own"), 5: (1, "x"), 6: (1, "y")}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in resolve.components(edges).collect()} == {0}
    assert resolve.components(edges.limit(0)).count() == 0


def test_keyset_pages_cover_everything_once(spark):
    rows = [(i, "S", i % 3, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, status string, score int, found_at int")
    seen, cursor = [], None
    while True:
        page = views.page(df, "score", 7, cursor).collect()
        if not page:
            break
        seen += [r.id for r in page]
        cursor = (page[-1].score, page[-1].found_at, page[-1].id)
    assert len(seen) == 60 and len(set(seen)) == 60


def test_rules(spark):
    kinds = [("", None), ("HTTP 429", "rate_limit"), ("403 Forbidden", "anti_bot"), ("connect ETIMEDOUT", "network"), ("weird", None)]
    df = spark.createDataFrame(kinds, "m string, k string")
    assert all(r.got == r.k for r in df.withColumn("got", rules.failure_category(F.col("m"))).collect())


def test_pages_with_unknown_scores_cover_everything_once(spark):
    rows = [(i, "S", None if i % 4 == 0 else i % 3, i % 2, f"n{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, status string, score int, found_at int, name string")
    for sort in views.ORDERS:
        seen, cursor = [], None
        while True:
            got = views.fetch(df, sort, 7, cursor)
            seen += [r.id for r in got["rows"]]
            assert got["total"] == 60
            cursor = got["next"]
            if cursor is None:
                break
        assert len(seen) == 60 and len(set(seen)) == 60
        if sort == "score":
            assert all(i % 4 == 0 for i in seen[:15])
    assert views.decode_cursor(views.encode_cursor((None, "x", 3))) == (None, "x", 3)


def test_stream_equals_batch(spark):
    stream = log.read_log(spark, "/root/testdata/sf0.001")
    got = sorted(map(tuple, log.drain(log.job_states(stream), "complete").collect()))
    static = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy("user_id").agg(F.count(F.lit(1)), F.count_if(F.col("event_type") == "error"))
    assert got == sorted(map(tuple, static.collect()))
