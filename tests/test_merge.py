"""Folding records of several sources: preferences, and the index against a plain scan."""

import random

import pytest
from siftline.operators import merge


@pytest.mark.parametrize(
    ("old", "new", "a", "b", "kept"),
    [
        (None, "x", 1, 1, "x"), ("x", " ", 1, 9, "x"), ("soon", "2026-01-02T10:00", 80, 20, "2026-01-02"), ("July 4, 2026", "soon", 20, 80, "2026-07-04"), ("2026-01-01", "2026-02-02", 20, 80, "2026-02-02"),
        ("2026-01-01", "2026-02-02", 80, 20, "2026-01-01"), ("short", "long enough to win", 40, 40, "long enough to win"), ("short", "shorter", 40, 40, "short"), ("short", "x", 20, 40, "x"),
    ],
)
def test_stronger_text(old, new, a, b, kept):
    assert merge.stronger(old, new, a, b) == kept


def _row(i, rng):
    row = {"ordinal": i, "source": "web", "authority": rng.choice([20, 40, 80]), "mode": rng.choice([None, "online", "unknown"]), "themes": [], "ids_key": rng.choice([None, None, f"k{rng.randrange(9)}"])}
    for u in merge.ADDRESSES:
        url = rng.choice([None, None, f"https://h{rng.randrange(12)}.example"])
        row |= {u: url, f"{u}_id": url, f"{u}_host": 90 if url else 0}
    row |= {t: None for t in merge.TEXTS}
    row |= {"name": rng.choice(["Great Fest 2025", "Great Fest", "Hackathon", "Other Gathering"]), "city": rng.choice([None, "Oslo", "Rome"]), "start_date": rng.choice([None, "2025-05-01", "2026-05-01", "soon"])}
    return row


def test_the_index_finds_what_a_scan_finds():
    rng = random.Random(1)
    for _ in range(60):
        rows = [_row(i, rng) for i in range(40)]
        indexed, plain = merge._Merged(), []
        for r in rows:
            indexed.add(merge._Record(dict(r)))
            new = merge._Record(dict(r))
            at = next((i for i, m in enumerate(plain) if m.like(new)), None)
            plain.append(new) if at is None else plain[at].take(new)
        assert [m.members for m in indexed.records] == [m.members for m in plain]
        assert [m.row for m in indexed.records] == [m.row for m in plain]


def test_general_names_do_not_meet_in_one_task(spark):
    """Records that share only a general name are components of their own; place and date, or an address, link them."""
    fields = "ordinal long, source string, official_url string, apply_url string, social_url string, " + ", ".join(f"{t} string" for t in merge.TEXTS) + ", mode string, themes array<string>, source_ids map<string,array<string>>"

    def record(i, name, city=None, start=None, url=None):
        texts = {t: None for t in merge.TEXTS} | {"name": name, "city": city, "start_date": start}
        return (i, "web", url, None, None, *[texts[t] for t in merge.TEXTS], None, [], {})

    rows = [record(i, "Hackathon", f"City {i}", "2026-05-01") for i in range(400)]
    rows += [record(1000, "Hackathon", "City 7", "2026-05-01"), record(1001, "HACKATHON 2026", "City 8", "2026-09-09"), record(1002, "Hackathon", None, "soon"), record(1003, "Hackathon", None, "soon")]
    rows += [record(1004, "Great Fest", "Oslo"), record(1005, "Great Fest"), record(1006, "Hackathon", "Rome", None, "https://a.example/x"), record(1007, "Other", None, None, "https://a.example/x")]
    out = merge.merge_sources(spark.createDataFrame(rows, fields)).collect()
    assert sorted(r.members for r in out if len(r.members) > 1) == [[7, 1000], [8, 1001], [1002, 1003], [1004, 1005], [1006, 1007]]
    assert len({r.root for r in out}) == 403


def test_progress_does_not_depend_on_frames_and_files(spark, tmp_path):
    from pyspark.sql import functions as F
    from siftline.streaming import log

    rng = random.Random(2)
    kinds = ["scan", "scan", "page", "fetch error", "", None]
    rows = [(i % 3, i, i * rng.choice([100, 400]), rng.choice(kinds), rng.random() < 0.05) for i in range(600)]
    df = spark.createDataFrame(rows, "job_id long, event_id long, ms long, message string, ends boolean").withColumn("ts", F.timestamp_millis(F.col("event_id") * 200))
    df.repartition(1).sortWithinPartitions(F.desc("event_id")).write.parquet(f"{tmp_path}/one/f")  # one file, out of order
    for n in range(5):
        df.filter(F.floor(F.col("event_id") / 120) == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/five/f")
    got = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for files, size in (("one", 10_000), ("one", 10), ("five", 10)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/{files}/f")
            got.append(sorted(map(tuple, log.drain(log.coalesced(stream)).collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] == got[2] and {"first", "forced", "held", "count", "time", "end"} >= {r[3] for r in got[0]} >= {"first", "forced", "end"}


def test_customers_numbered_like_years_stay_apart(spark, tmp_path):
    from siftline.plans import merge_queries

    spark.range(1995, 2105).selectExpr("id AS c_custkey", "cast(id % 25 AS int) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted((r["first"], r.members) for r in merge_queries.m6_merge_sources(spark, f"file://{tmp_path}").collect())
    assert got == [(k * 3, k % 3 + 1) for k in range(1995, 2105)]


def test_progress_of_a_log_cut_anywhere(spark, tmp_path):
    from siftline.plans import stream_queries

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for n in (2, 0, 1):
        events.filter(f"event_id % 3 = {n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    for query in (stream_queries.t5_coalesce, stream_queries.t5_flushed):
        assert sorted(map(tuple, query(spark, f"file://{tmp_path}").collect())) == sorted(map(tuple, query(spark, "/root/testdata/sf0.001").collect()))


def test_progress_does_not_depend_on_the_session_time_zone(spark, tmp_path):
    """Hours that a zone's clocks skip or repeat are hours like others; a time that is missing comes last."""
    import duckdb
    from siftline.plans import stream_queries

    duckdb.sql(f"""
        COPY (SELECT i AS event_id, CASE WHEN i % 97 < 95 THEN start + INTERVAL (i * 17 % 900 * 12000 + i % 7 * 90) MILLISECOND END AS ts, i % 3 AS user_id, ['view', 'click', 'signup', 'error', 'click'][1 + i % 5] AS event_type, 1.0 AS value, '' AS props
              FROM range(900) r(i), (VALUES (TIMESTAMP '2024-03-10 01:30:00'), (TIMESTAMP '2024-11-03 00:30:00')) v(start)) TO '{tmp_path}/events.parquet'""")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for name in ("t5_coalesce", "t5_flushed"):
            got = sorted((r.job_id, r.event_id, r.seen, r.why) for r in stream_queries.QUERIES[name](spark, f"file://{tmp_path}").collect())
            assert got == sorted(con.sql(f"SELECT job_id, event_id, seen, why FROM ({stream_queries.ORACLES[name]})").fetchall())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
