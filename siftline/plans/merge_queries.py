"""Merging records across sources, write plans and their replay, status changes, queue pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.operators import merge, views
from siftline.sources import tables

from .record_queries import _CAND, _EVID, _LOG
from .scenario import expected, over_orders, tallied

#: (old, its source, new, its source), then the address and the mode that stay
URLS = [
    (("https://own.example/", "web", "https://jam.devpost.com/", "devpost"), "https://jam.devpost.com/"), (("https://own.example/", "luma", "https://x.com/a", "mlh"), "https://own.example/"),
    ((None, "web", "https://x.com/a", "x"), "https://x.com/a"), (("https://a.example/", "web", "https://b.example/", "web"), "https://a.example/"), (("https://a.example/", "web", None, "mlh"), "https://a.example/"),
    (("https://www.google.com/a", "web", "https://b.example/", "web"), "https://b.example/"),
]
MODES = [(("online", "web", "in-person", "mlh"), "in-person"), (("online", "mlh", "in-person", "web"), "online"), (("unknown", "mlh", "hybrid", "x"), "hybrid"), (("online", "web", "unknown", "mlh"), "online"), ((None, "web", None, "mlh"), None), (("online", "web", "hybrid", "web"), "online")]
_PAIR = "a string, a_source string, b string, b_source string"


def m3_prefer_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [u for u, _ in URLS], _PAIR)
    return tallied(df, kept=merge.prefer_url(F.col("a"), F.col("b"), F.col("a_source"), F.col("b_source")))


def m5_prefer_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [m for m, _ in MODES], _PAIR)
    return tallied(df, kept=merge.prefer_mode(F.col("a"), F.col("b"), F.col("a_source"), F.col("b_source")))


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer as listings of up to three sources: the first names the address, the second name and day, the third a vague day.

    The letter before the number keeps 2000 to 2099 from being years, which names are told without.
    """
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int"))).alias("k"))
    k = F.col("k")
    url = F.concat(F.lit("https://e"), "c_custkey", F.lit(".example/"))
    text = lambda c: c.cast("string")
    return c.select(
        (F.col("c_custkey") * 3 + k).alias("ordinal"), F.element_at(F.array(F.lit("web"), F.lit("mlh"), F.lit("x")), k + 1).alias("source"),
        F.when(k != 1, url).alias("official_url"), F.when(k == 1, url).alias("apply_url"), F.lit(None).cast("string").alias("social_url"),
        F.concat(F.lit("Gathering number n"), "c_custkey").alias("name"), F.when(k == 1, "2026-09-05").when(k == 2, "in autumn").alias("start_date"), text(F.lit(None)).alias("end_date"), text(F.lit(None)).alias("deadline"),
        text(F.lit(None)).alias("location"), F.when(k < 2, F.concat(F.lit("City "), "c_nationkey")).alias("city"), text(F.lit(None)).alias("region"), text(F.lit(None)).alias("country"), text(F.lit(None)).alias("prize"),
        text(F.lit(None)).alias("eligibility"), F.when(k == 2, F.lit("a text much longer than the other one")).otherwise("short text").alias("description"), F.when(k == 0, "unknown").when(k == 1, "in-person").otherwise("online").alias("mode"),
        F.array(F.when(k == 2, "b").otherwise("a")).alias("themes"), F.lit(None).cast("map<string,array<string>>").alias("source_ids"),
    )


def m6_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of several sources as one record each, folded in order of arrival."""
    out = merge.merge_sources(_listings(spark, sf_dir))
    return out.select("first", F.size("members").cast("long").alias("members"), "source", "official_url", "apply_url", "start_date", "city", "mode", "description", F.array_join("themes", ",").alias("themes"))


#: (listings of one event each: name, city, mode, start, address), and how many records they are
_TABLE = [
    ("Great Coding Fest 2026", "Oslo", None, "2026-05-01", "https://a.example"), ("Great Coding Fest", "Oslo", None, "2026-05-02", None), ("Great Coding Fest", "Bergen", None, "2026-05-01", None),
    ("Great Coding Fest 2025", "Oslo", None, "2025-05-01", None), ("Great Coding Fest", None, None, None, None), ("Hackathon", None, "online", None, None), ("Hackathon", None, "online", None, None),
    ("Hackathon", "Rome", None, "2026-01-01", None), ("Other Name Altogether", None, None, None, "https://a.example"),
]


def m7_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which listings of a fixed table are one event, once for each nation."""
    rows = [(i, *r) for i, r in enumerate(_TABLE)]
    listed = spark.createDataFrame(rows, "k int, name string, city string, mode string, start_date string, official_url string")
    n = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"))
    df = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1)))).join(F.broadcast(listed), "k")
    tag = F.concat(F.lit(" n"), F.col("nation"))
    none = F.lit(None).cast("string")
    df = df.select(
        (F.col("nation") * 100 + F.col("k")).alias("ordinal"), F.lit("web").alias("source"), F.concat("official_url", F.lit("/"), "nation").alias("official_url"), none.alias("apply_url"), none.alias("social_url"),
        F.concat("name", F.when(F.col("name") != "Hackathon", tag).otherwise(F.lit(""))).alias("name"), "start_date", none.alias("end_date"), none.alias("deadline"), none.alias("location"),
        F.concat("city", tag).alias("city"), none.alias("region"), none.alias("country"), none.alias("prize"), none.alias("eligibility"), none.alias("description"), "mode", F.array().cast("array<string>").alias("themes"),
        F.lit(None).cast("map<string,array<string>>").alias("source_ids"),
    )
    return merge.merge_sources(df).select("first", F.array_join(F.transform("members", lambda m: (m % 100).cast("string")), ",").alias("members"))


def u3_map_unions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of ids per order, accumulated, and one laid over the other."""
    o = tables.table(spark, sf_dir, "orders")
    left = F.create_map(F.lit("a"), F.array(F.lit("1"), F.lit("2")), F.lit("b"), F.array(F.lit("3")))
    right = F.create_map(F.lit("a"), F.array(F.lit("2"), (F.col("o_orderkey") % 3).cast("string")), F.lit("c"), F.array(F.lit("4")))
    said = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":"), F.array_join(e["value"], "+")))), ";")
    return o.groupBy(said(merge.union_maps(left, right)).alias("united"), said(merge.overlay_maps(left, right)).alias("overlaid")).agg(F.count(F.lit(1)).alias("n"))


def u4_united_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of one type and address once per record: the first line that has it."""
    ev = tables.evidence(spark, sf_dir).select("candidate_id", "type", F.col("url_key").alias("url"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("snippet"), "ordinal")
    return merge.united_evidence(ev, "candidate_id", "ordinal").groupBy("candidate_id").agg(F.count(F.lit(1)).alias("kept"), F.max("ordinal").alias("last"))


def u5_united_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated finds of a key: the first one's place, the last one's value."""
    ev = tables.evidence(spark, sf_dir)
    return merge.united_dates(ev, "candidate_id", "ordinal", ["type"], "seen_count").select("candidate_id", "type", "ordinal", "seen_count")


_TEXTS, _LISTS = ["name", "source", "official_url", "city"], ["themes"]


def _line_order():
    """A number for each line of an order, in order of line number, part and supplier."""
    return F.col("l_linenumber").cast("long") * 10_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as a batch of records, several to a fingerprint."""
    li = tables.table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        F.concat(F.lit("fp"), F.col("l_orderkey")).alias("fingerprint"), _line_order().alias("ordinal"), F.when(n > 1, F.concat(F.lit("name "), n.cast("string"))).otherwise("").alias("name"),
        F.when(n % 2 == 0, "mlh").otherwise("web").alias("source"), F.when(n == 3, "https://e.example").alias("official_url"), F.when(n > 2, F.concat(F.lit("c"), n.cast("string"))).alias("city"),
        F.when(n < 4, F.col("l_quantity").cast("int")).alias("score"), F.when(n == 2, "NEEDS_REVIEW").alias("status"), F.array(F.col("l_returnflag"), F.col("l_linestatus")).alias("themes"),
    )


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three orders are stored already, one of them with what the batch will bring."""
    o = tables.table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0")
    return o.select(
        F.concat(F.lit("fp"), F.col("o_orderkey")).alias("fingerprint"), F.lit("kept name").alias("name"), F.lit("x").alias("source"), F.when(F.col("o_orderkey") % 2 == 0, "https://old.example").alias("official_url"),
        F.lit("old city").alias("city"), F.lit(1).alias("score"), F.lit("APPROVED").alias("status"), F.array(F.lit("z")).alias("themes"),
    )


def a8_group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's records of one fingerprint as one: first non-empty texts, last score, united lists."""
    out = merge.incoming_groups(_incoming(spark, sf_dir), _TEXTS, _LISTS)
    return out.select("fingerprint", "members", "name", "source", "official_url", "city", "score", "status", F.array_join("themes", "").alias("themes"))


def m10_write_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a batch does to the stored records, and the action each update leaves."""
    plan = merge.write_plan(merge.incoming_groups(_incoming(spark, sf_dir), _TEXTS, _LISTS), _stored(spark, sf_dir), _TEXTS, _LISTS)
    return plan.groupBy("action", "audit", "status").agg(F.count(F.lit(1)).alias("n"))


def m9_row_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows after a batch: empty fields filled, trusted sources preferred, lists united, status kept."""
    plan = merge.write_plan(merge.incoming_groups(_incoming(spark, sf_dir), _TEXTS, _LISTS), _stored(spark, sf_dir), _TEXTS, _LISTS)
    return plan.filter("action = 'update'").select("fingerprint", "name", "source", "official_url", "city", "score", "status", F.array_join("themes", "").alias("themes"))


def m15_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch on the state it left: nothing is created and nothing changes."""
    groups, columns = merge.incoming_groups(_incoming(spark, sf_dir), _TEXTS, _LISTS), [*_TEXTS, "score", *_LISTS]
    first = merge.final_state(merge.write_plan(groups, _stored(spark, sf_dir), _TEXTS, _LISTS), _stored(spark, sf_dir), columns)
    return merge.write_plan(groups, first, _TEXTS, _LISTS).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def m14_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence after a batch of observations on stored rows, as a plan computes it; the SQL replays them one by one."""
    li = tables.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("candidate_id"), F.col("l_returnflag").alias("type"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("title"),
        F.col("l_shipdate").cast("date").alias("at"), _line_order().alias("ordinal"),
    )
    old = tables.table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("candidate_id"), F.lit("N").alias("type"), F.lit("old").alias("title"), F.lit("1990-01-01").cast("date").alias("first_seen"), F.lit("1990-02-01").cast("date").alias("last_seen"), F.lit(3).alias("seen_count"),
    )
    return merge.evidence_plan(li, old, ["candidate_id", "type"], ["title"])


def m13_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on records: decision times are set, a restore clears them, the same status again changes nothing."""
    o = tables.table(spark, sf_dir, "orders")
    states = F.array(*[F.lit(s) for s in ("NEW", "APPROVED", "REJECTED", "SAVED_FOR_LATER")])
    stamp = lambda s: F.when(F.col("status") == s, "then")
    c = o.select(F.col("o_orderkey").alias("id"), F.element_at(states, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("status"))
    c = c.withColumns({"approved_at": stamp("APPROVED"), "rejected_at": stamp("REJECTED"), "saved_at": stamp("SAVED_FOR_LATER")})
    wanted = F.element_at(states, (F.col("id") % 16 / 4 + 1).cast("int"))
    out = merge.transition(c, wanted, F.lit("now"))
    return out.groupBy("previous_status", "status", "approved_at", "rejected_at", "saved_at", "action").agg(F.count(F.lit(1)).alias("n"))


def m12_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many observations of evidence repeat one of the same batch."""
    ev = tables.evidence(spark, sf_dir)
    per = ev.groupBy("candidate_id", "type", "url_key").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("observations"), F.count(F.lit(1)).alias("identities"), F.sum(F.col("n") - 1).alias("repeats"))


# ---- serving

def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with some scores unknown, and ids of other sources."""
    c = tables.candidates(spark, sf_dir)
    ids = F.when(F.col("id") % 5 == 0, F.create_map(F.lit("luma"), F.array(F.lit("1"))))
    status = F.when(F.col("status") == "READY_FOR_REVIEW", "NEW").otherwise(F.col("status"))
    return c.withColumns({"score": F.when(F.col("id") % 100 == 0, F.lit(None)).otherwise(F.col("score")), "source_ids": ids, "status": status})


def o1_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's first page by score: unknown scores come first, as in the stored order."""
    return views.page(_queue(spark, sf_dir), "score", 15).select("id", "score")


def o3_after_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a record whose score is unknown."""
    return views.page(_queue(spark, sf_dir), "score", 10, (None, "1995-01-01", 10**9)).select("id", "score")


def o2_has_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the largest size and the one row beyond it that tells there is more; 500 is held to 50."""
    return views.page(_queue(spark, sf_dir), "found_at", 500, more=1).agg(F.count(F.lit(1)).alias("n"))


def o4_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset paging: an offset wins over a cursor."""
    return views.page(_queue(spark, sf_dir), "name", 20, ("zzz", 0), offset=30).select("id", "name")


def f36_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a source, or that carry its identifiers, by their own source."""
    return views.filtered(_queue(spark, sf_dir), source="luma").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def a15_pending_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pending_sources(_queue(spark, sf_dir))


def a13_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total that goes with a page: all rows that pass its filters, whatever the page."""
    return views.filtered(_queue(spark, sf_dir), ["NEW", "NEEDS_REVIEW"], q="RECORD 1").agg(F.count(F.lit(1)).alias("total"))


def o5_pending_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approved records that a sheet still lacks, newest first, at most 200."""
    c = _queue(spark, sf_dir).filter("status = 'APPROVED' AND id % 3 > 0")
    return c.orderBy(F.desc_nulls_first("found_at"), F.desc("id")).limit(200).select("id", "found_at")


def o6_jobs_and_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty jobs with the newest entries."""
    jobs = tables.event_log(spark, sf_dir).groupBy("job_id").agg(F.max("ts").alias("last"))
    return jobs.orderBy(F.desc("last"), "job_id").limit(20).select("job_id")


def o7_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five oldest queued jobs that are free to claim."""
    o = tables.table(spark, sf_dir, "orders")
    jobs = o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"), (F.col("o_orderkey") % 4 == 0).alias("cancel_requested"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("claim_expires_at"), F.col("o_orderdate").alias("created_at"),
    )
    return views.claimable(jobs, F.lit("1996-06-01").cast("timestamp_ntz")).select("id")


def w8_queue_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each queued order in its priority's queue."""
    o = tables.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return views.queue_positions(o, "o_orderpriority", ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("position").cast("long").alias("position"))


def w9_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job the newest twenty telling actions and one count of technical ones."""
    names = F.element_at(F.array(*[F.lit(a) for a in ("APPROVE", "UPDATE_FROM_DUPLICATE", "REJECT")]), (F.col("event_id") % 3 + 1).cast("int"))
    log = tables.event_log(spark, sf_dir).select("job_id", "ts", "event_id", names.alias("action"))
    return views.action_history(log, "job_id", ["ts", "event_id"], 3).select("job_id", F.col("position").cast("long").alias("position"), "action", "n")


def j4_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with three lists of children, newest first: here the size of each and the newest of one."""
    c = tables.candidates(spark, sf_dir).select("id", "status")
    ev = tables.evidence(spark, sf_dir).select("candidate_id", F.col("seen_at").alias("at"), "ordinal", "part")
    answers = tables.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("for_id"), F.col("turn").alias("at"), "role")
    actions = tables.event_log(spark, sf_dir).select(F.col("job_id").alias("for_id"), F.col("ts").alias("at"), "event_id")
    out = views.detail(c, {"evidence": (ev, "candidate_id", "at"), "answers": (answers, "for_id", "at"), "actions": (actions, "for_id", "at")})
    size = lambda x: F.when(F.col(x).isNull(), 0).otherwise(F.size(x)).cast("long")
    return out.select("id", "status", size("evidence").alias("evidence"), size("answers").alias("answers"), size("actions").alias("actions"), F.try_element_at("evidence", F.lit(1))["at"].alias("newest"))


def w4_carried_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day of a row's job that was stated before it, as a heading holds for the cards below it."""
    log = tables.event_log(spark, sf_dir)
    stated = F.when(F.col("kind") == "signup", F.date_format("ts", "yyyy-MM-dd"))
    out = log.withColumn("heading", F.last(stated, ignorenulls=True).over(Window.partitionBy("job_id").orderBy("ts", "event_id")))
    return out.groupBy("heading").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    m3_prefer_url, m5_prefer_mode, m6_merge_sources, m7_match_rules, u3_map_unions, u4_united_evidence, u5_united_dates, a8_group_merge, m10_write_plan, m9_row_merge, m15_rerun, m14_replay, m13_transition, m12_observations,
    o1_nulls_first, o3_after_null, o2_has_more, o4_offset, f36_source_filter, a15_pending_sources, a13_page_total, o5_pending_sync, o6_jobs_and_events, o7_claimable, w8_queue_position, w9_history, j4_detail, w4_carried_heading,
)}

_IN = """
    inc AS (
        SELECT 'fp' || l_orderkey AS fingerprint, CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey AS n, CASE WHEN l_linenumber > 1 THEN 'name ' || l_linenumber ELSE '' END AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'mlh' ELSE 'web' END AS source,
               CASE WHEN l_linenumber = 3 THEN 'https://e.example' END AS official_url, CASE WHEN l_linenumber > 2 THEN 'c' || l_linenumber END AS city, CASE WHEN l_linenumber < 4 THEN CAST(l_quantity AS INT) END AS score,
               CASE WHEN l_linenumber = 2 THEN 'NEEDS_REVIEW' END AS status, l_returnflag AS f1, l_linestatus AS f2, l_partkey, l_suppkey
        FROM lineitem
    ),
    items AS (SELECT fingerprint, f1 AS item, n * 2 AS pos FROM inc UNION ALL SELECT fingerprint, f2, n * 2 + 1 FROM inc),
    lists AS (SELECT fingerprint, string_agg(item, '' ORDER BY pos) AS themes FROM (SELECT fingerprint, item, min(pos) AS pos FROM items GROUP BY 1, 2) GROUP BY 1),
    grp AS (
        SELECT fingerprint, count(*) AS members, arg_min(name, n) FILTER (name <> '') AS name, arg_min(source, n) AS source, arg_min(official_url, n) FILTER (official_url IS NOT NULL) AS official_url,
               arg_min(city, n) FILTER (city IS NOT NULL) AS city, arg_max(score, n) FILTER (score IS NOT NULL) AS score, arg_min(status, n) FILTER (status IS NOT NULL) AS status
        FROM inc GROUP BY 1
    ),
    old AS (SELECT 'fp' || o_orderkey AS fingerprint, CASE WHEN o_orderkey % 2 = 0 THEN 'https://old.example' END AS url FROM orders WHERE o_orderkey % 3 > 0)
"""
_QUEUE = f"""
    {_CAND}, q AS (SELECT id, CASE status WHEN 'READY_FOR_REVIEW' THEN 'NEW' ELSE status END AS status, source, CASE WHEN id % 100 > 0 THEN score END AS score, found_at, name, id % 5 = 0 AS luma FROM cand)
"""
ORACLES = {
    "m3_prefer_url": expected(["kept"], [(u[1],) for u in URLS]),
    "m5_prefer_mode": expected(["kept"], [(m[1],) for m in MODES]),
    "m6_merge_sources": """
        SELECT c_custkey * 3 AS first, CAST(c_custkey % 3 + 1 AS BIGINT) AS members, CASE WHEN c_custkey % 3 > 0 THEN 'mlh' ELSE 'web' END AS source, 'https://e' || c_custkey || '.example/' AS official_url,
               CASE WHEN c_custkey % 3 > 0 THEN 'https://e' || c_custkey || '.example/' END AS apply_url, CASE WHEN c_custkey % 3 > 0 THEN '2026-09-05' END AS start_date, 'City ' || c_nationkey AS city,
               CASE WHEN c_custkey % 3 > 0 THEN 'in-person' ELSE 'unknown' END AS mode, 'short text' AS description, CASE WHEN c_custkey % 3 = 2 THEN 'a,b' ELSE 'a' END AS themes
        FROM customer
    """,
    "m7_match_rules": """
        SELECT n_nationkey * 100 + f AS first, m AS members FROM nation, (VALUES (0, '0,1,4,8'), (2, '2'), (3, '3')) v(f, m)
        UNION ALL SELECT 5, (SELECT string_agg(k, ',' ORDER BY n_nationkey, k) FROM nation, (VALUES ('5'), ('6')) w(k))
        UNION ALL SELECT n_nationkey * 100 + 7, '7' FROM nation
    """,
    "u3_map_unions": "SELECT 'a:' || CASE o_orderkey % 3 WHEN 0 THEN '1+2+0' ELSE '1+2' END || ';b:3;c:4' AS united, 'a:2+' || (o_orderkey % 3) || ';b:3;c:4' AS overlaid, count(*) AS n FROM orders GROUP BY 1, 2",
    "u4_united_evidence": f"WITH {_EVID}, u AS (SELECT candidate_id, type, url_key, min(ordinal) AS o FROM evid GROUP BY 1, 2, 3) SELECT candidate_id, count(*) AS kept, max(o) AS last FROM u GROUP BY 1",
    "u5_united_dates": f"WITH {_EVID} SELECT candidate_id, type, min(ordinal) AS ordinal, arg_max(seen_count, {{'o': ordinal, 's': seen_count}}) AS seen_count FROM evid GROUP BY 1, 2",
    "a8_group_merge": f"WITH {_IN} SELECT grp.*, themes FROM grp JOIN lists USING (fingerprint)",
    "m10_write_plan": f"""
        WITH {_IN} SELECT CASE WHEN old.fingerprint IS NULL THEN 'create' ELSE 'update' END AS action, CASE WHEN old.fingerprint IS NOT NULL THEN 'UPDATE_FROM_DUPLICATE' END AS audit,
               CASE WHEN old.fingerprint IS NULL THEN coalesce(status, 'NEW') ELSE 'APPROVED' END AS status, count(*) AS n FROM grp LEFT JOIN old USING (fingerprint) GROUP BY ALL
    """,
    "m9_row_merge": f"""
        WITH {_IN} SELECT fingerprint, coalesce(name, 'kept name') AS name, source, coalesce(url, official_url) AS official_url, 'old city' AS city, score, 'APPROVED' AS status, 'z' || themes AS themes
        FROM grp JOIN lists USING (fingerprint) JOIN old USING (fingerprint)
    """,
    "m15_rerun": "SELECT 'unchanged' AS action, count(DISTINCT l_orderkey) AS n FROM lineitem",
    "m14_replay": """
        WITH RECURSIVE obs AS (SELECT l_orderkey AS c, l_returnflag AS t, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS title, CAST(l_shipdate AS DATE) AS day,
                                      row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY CAST(l_linenumber AS BIGINT) * 10000000000 + l_partkey * 10000 + l_suppkey) AS k FROM lineitem),
        r AS (
            SELECT c, t, k, CASE WHEN c % 2 = 0 AND t = 'N' THEN 'update' ELSE 'create' END AS action, coalesce(title, CASE WHEN c % 2 = 0 AND t = 'N' THEN 'old' END) AS title,
                   CASE WHEN c % 2 = 0 AND t = 'N' THEN DATE '1990-01-01' ELSE day END AS first_seen, day AS last_seen, CASE WHEN c % 2 = 0 AND t = 'N' THEN 4 ELSE 1 END AS seen FROM obs WHERE k = 1
            UNION ALL
            SELECT r.c, r.t, r.k + 1, action, coalesce(obs.title, r.title), first_seen, obs.day, seen + 1 FROM r JOIN obs ON obs.c = r.c AND obs.t = r.t AND obs.k = r.k + 1
        )
        SELECT c AS candidate_id, t AS type, arg_max(action, k) AS action, max_by(coalesce(title, '~'), k) AS title0, max(first_seen) AS first_seen, arg_max(last_seen, k) AS last_seen, CAST(max(seen) AS BIGINT) AS seen_count FROM r GROUP BY 1, 2
    """,
    "m13_transition": """
        WITH o AS (SELECT ['NEW', 'APPROVED', 'REJECTED', 'SAVED_FOR_LATER'][o_orderkey % 4 + 1] AS s, ['NEW', 'APPROVED', 'REJECTED', 'SAVED_FOR_LATER'][(o_orderkey % 16) // 4 + 1] AS w FROM orders)
        SELECT s AS previous_status, w AS status,
               CASE WHEN s <> w AND w = 'APPROVED' THEN 'now' WHEN s <> w AND w = 'NEW' THEN NULL WHEN s = 'APPROVED' THEN 'then' END AS approved_at,
               CASE WHEN s <> w AND w = 'REJECTED' THEN 'now' WHEN s <> w AND w = 'NEW' THEN NULL WHEN s = 'REJECTED' THEN 'then' END AS rejected_at,
               CASE WHEN s <> w AND w = 'SAVED_FOR_LATER' THEN 'now' WHEN s <> w AND w = 'NEW' THEN NULL WHEN s = 'SAVED_FOR_LATER' THEN 'then' END AS saved_at,
               CASE WHEN s <> w THEN CASE w WHEN 'APPROVED' THEN 'APPROVE' WHEN 'REJECTED' THEN 'REJECT' WHEN 'SAVED_FOR_LATER' THEN 'SAVE_FOR_LATER' ELSE 'RESTORE' END END AS action, count(*) AS n
        FROM o GROUP BY ALL
    """,
    "m12_observations": f"WITH {_EVID}, g AS (SELECT count(*) AS n FROM evid GROUP BY candidate_id, type, url_key) SELECT CAST(sum(n) AS BIGINT) AS observations, count(*) AS identities, CAST(sum(n - 1) AS BIGINT) AS repeats FROM g",
    "o1_nulls_first": f"WITH {_QUEUE} SELECT id, score FROM q ORDER BY score DESC NULLS FIRST, found_at DESC, id DESC LIMIT 15",
    "o3_after_null": f"WITH {_QUEUE} SELECT id, score FROM q WHERE score IS NOT NULL OR found_at <= DATE '1995-01-01' ORDER BY score DESC NULLS FIRST, found_at DESC, id DESC LIMIT 10",
    "o2_has_more": "SELECT CAST(51 AS BIGINT) AS n",
    "o4_offset": f"WITH {_QUEUE} SELECT id, name FROM q ORDER BY name, id LIMIT 20 OFFSET 30",
    "f36_source_filter": f"WITH {_QUEUE} SELECT source, count(*) AS n FROM q WHERE luma GROUP BY 1",
    "a15_pending_sources": f"WITH {_QUEUE} SELECT DISTINCT source FROM q WHERE status <> 'APPROVED' UNION SELECT 'luma'",
    "a13_page_total": f"WITH {_QUEUE} SELECT count(*) AS total FROM q WHERE status <> 'APPROVED' AND name LIKE '%record 1%'",
    "o5_pending_sync": f"WITH {_QUEUE} SELECT id, found_at FROM q WHERE status = 'APPROVED' AND id % 3 > 0 ORDER BY found_at DESC, id DESC LIMIT 200",
    "o6_jobs_and_events": f"WITH {_LOG} SELECT job_id FROM log GROUP BY 1 ORDER BY max(ts) DESC, job_id LIMIT 20",
    "o7_claimable": "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 > 0 AND (o_orderkey % 3 > 0 OR o_orderdate <= DATE '1996-06-01') ORDER BY o_orderdate, o_orderkey LIMIT 5",
    "w8_queue_position": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O'",
    "w9_history": f"""
        WITH {_LOG}, t AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS position FROM log WHERE event_id % 3 <> 1)
        SELECT job_id, position, CASE event_id % 3 WHEN 0 THEN 'APPROVE' ELSE 'REJECT' END AS action, CAST(1 AS BIGINT) AS n FROM t WHERE position <= 3
        UNION ALL SELECT job_id, 0, 'TECHNICAL', count(*) FROM log WHERE event_id % 3 = 1 GROUP BY 1
    """,
    "j4_detail": f"""
        WITH {_CAND}, {_EVID}, {_LOG} SELECT id, status, coalesce(e.n, 0) AS evidence, coalesce(a.n, 0) AS answers, coalesce(l.n, 0) AS actions, e.newest
        FROM cand LEFT JOIN (SELECT candidate_id, count(*) AS n, max(seen_at) AS newest FROM evid GROUP BY 1) e ON candidate_id = id
             LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) a ON conv_id = id LEFT JOIN (SELECT job_id, count(*) AS n FROM log GROUP BY 1) l ON job_id = id
    """,
    "w4_carried_heading": f"""
        WITH {_LOG}, h AS (SELECT last_value(CASE WHEN kind = 'signup' THEN strftime(ts, '%Y-%m-%d') END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS heading FROM log)
        SELECT heading, count(*) AS n FROM h GROUP BY 1
    """,
}
ORACLES["m14_replay"] = ORACLES["m14_replay"].replace("max_by(coalesce(title, '~'), k) AS title0", "nullif(max_by(coalesce(title, '~'), k), '~') AS title")
