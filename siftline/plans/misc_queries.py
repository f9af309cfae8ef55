"""Smaller operators: cache keys, retention, unions, back-filled ids, seen sets, suggestions, letters of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import dates, text, urls
from siftline.operators import views
from siftline.sources import tables

from .record_queries import _CAND, _LOG
from .scenario import expected, over_orders, tallied


def _fnv36(s: str) -> str:
    """FNV-1a in 32 bits, in base 36: what the expression must give for ASCII."""
    h, digits = 2166136261, ""
    for c in s.encode():
        h = (h ^ c) * 16777619 % 2**32
    while h:
        h, r = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + digits
    return digits


KEYS = [(s, _fnv36(s)) for s in ("hello", "a", "candidate-summary", '{"a":1,"b":[2]}', "x" * 60)]


def c17_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(over_orders(spark, sf_dir, [(k,) for k, _ in KEYS], "given string"), key=text.fnv1a_base36(F.col("given")))


#: raw class list, folded
SHAPES = [("card-12 item_3 Deadbeef99", "card-n item_n #"), ("plain", "plain"), ("a1b2c3d4e5 x9", "# xn")]


def c22_folded_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(over_orders(spark, sf_dir, [(k,) for k, _ in SHAPES], "given string"), shape=text.folded(F.col("given")))


#: message, redacted
MESSAGES = [
    ("sent Bearer abc.def-1 off", "sent Bearer [redacted] off"), ("api_key=123 failed", "api_key=[redacted] failed"), ("mail a.b@c.org  now", "mail [email] now"), ("at /home/ann/x", "at /home/[user]/x"), ("plain", "plain"),
]


def x41_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(over_orders(spark, sf_dir, [(m,) for m, _ in MESSAGES], "given string"), safe=text.redacted(F.col("given")))


def f10_deadline_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose day has passed; the day itself is still open, and none never closes."""
    o = tables.table(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderkey") % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.groupBy(dates.deadline_closed(day, F.lit("1996-06-15")).alias("closed")).agg(F.count(F.lit(1)).alias("n"))


def f9_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of log entries in three places at once."""
    log = tables.event_log(spark, sf_dir)
    day = lambda z: dates.today_in(F.col("ts"), F.lit(z))
    return log.select("event_id", day("UTC").alias("utc"), day("Asia/Kolkata").alias("kolkata"))


def t16_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the last fourteen days of the log."""
    log = tables.event_log(spark, sf_dir)
    last = log.agg(F.max("ts")).first()[0]  # one value; the filter on it reaches the scan
    return log.filter(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 14 DAYS")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def t4_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's entries up to its first error, which ends its stream."""
    log = views.sequence(tables.event_log(spark, sf_dir))
    end = log.filter("kind = 'error'").groupBy("job_id").agg(F.min("sequence").alias("end"))
    return log.join(end, "job_id", "left").filter("end IS NULL OR sequence <= end").groupBy("job_id").agg(F.max("sequence").alias("entries"))


def t1_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly growing numbers per job: how many jobs have so many entries."""
    log = views.sequence(tables.event_log(spark, sf_dir))
    per = log.groupBy("job_id").agg(F.max("sequence").alias("entries"), F.count(F.lit(1)).alias("n")).filter("entries = n")
    return per.groupBy("entries").agg(F.count(F.lit(1)).alias("jobs"))


def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of two sources in one frame; a column that one lacks is null there."""
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"))
    s = tables.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"))
    return tables.union_sources({"customers": c, "suppliers": s}).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))


def u8_without_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    flags = F.array(F.lit("soft"), F.col("o_orderstatus"), F.lit("soft"))
    return o.groupBy(F.array_join(F.array_remove(flags, "soft"), ",").alias("flags")).agg(F.count(F.lit(1)).alias("n"))


def j3_backfilled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a batch gets the ids that its records were given, by fingerprint."""
    made = tables.table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.concat(F.lit("fp"), "o_orderkey").alias("fingerprint"), (F.col("o_orderkey") + 1_000_000).alias("id"))
    ev = tables.evidence(spark, sf_dir).withColumn("fingerprint", F.concat(F.lit("fp"), "candidate_id"))
    return ev.join(made, "fingerprint", "left").groupBy((F.col("id").isNotNull()).alias("filled")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))


def j9_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's health beside its number of records; a source without health keeps null."""
    health = spark.createDataFrame([("urgent", "healthy"), ("low", "failed")], "source string, health string")
    c = tables.candidates(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return c.join(F.broadcast(health), "source", "left")


def x38_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that nobody has looked at: those without a log entry of their number."""
    c, seen = tables.candidates(spark, sf_dir), tables.event_log(spark, sf_dir).select(F.col("job_id").alias("id")).distinct()
    return c.join(seen, "id", "left_anti").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def o15_autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that a typed beginning may mean, in order."""
    n = tables.table(spark, sf_dir, "nation")
    return n.filter(F.lower("n_name").startswith("i")).orderBy("n_name").limit(8).select("n_name")


def column_letter(c: Column) -> Column:
    """The letters of a sheet's column, from 0: A to Z, then AA."""
    letter = lambda n: F.char(n + 65)
    return F.when(c < 26, letter(c)).otherwise(F.concat(letter(F.floor(c / 26) - 1), letter(c % 26)))


COLUMNS = [(0, "A"), (23, "X"), (25, "Z"), (26, "AA"), (51, "AZ"), (52, "BA"), (701, "ZZ")]


def x33_column_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(over_orders(spark, sf_dir, [(n,) for n, _ in COLUMNS], "at int"), letter=column_letter(F.col("at")))


def x10_evidence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of evidence as stored: known ones stand, all others are source cards."""
    known = ["official_page", "apply_page", "x_post", "manual_lead", "search_result", "source_card"]
    o = tables.table(spark, sf_dir, "orders")
    given = F.element_at(F.array(*[F.lit(k) for k in [*known, "odd", "luma_page"]]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    stored = F.when(given.isin(known), given).otherwise("source_card")
    return o.groupBy(stored.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def a14_active_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose last entry is no error: those still running."""
    last = tables.event_log(spark, sf_dir).groupBy("job_id").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("kind"))
    return last.filter("kind <> 'error'").agg(F.count(F.lit(1)).alias("active"))


def x8_best_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For customers without an address the first search result that is worth at least three."""
    c = tables.table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select("c_custkey")
    found = [(0, "https://x.com/a"), (1, "https://blog.example/post"), (2, "https://jam.devpost.com/"), (3, "https://a.edu/apply")]
    results = spark.createDataFrame(found, "place int, url string").withColumn("k", F.lit(0))
    hits = c.withColumn("place", F.explode(F.sequence((F.col("c_custkey") % 4).cast("int"), F.lit(3)))).join(F.broadcast(results), "place")
    good = hits.filter(~urls.is_social(F.col("url")) & (urls.official_worth(F.col("url")) >= 3))
    return good.groupBy("c_custkey").agg(F.min_by("url", "place").alias("url"))


def s13_season_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing addresses of the seasons that a day may belong to: its year's and the next one's."""
    o = tables.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    return o.select("y", F.explode(F.sequence(F.col("y") + 1, F.col("y"), F.lit(-1))).alias("season")).select("y", F.concat(F.lit("https://list.example/seasons/"), "season", F.lit("/events")).alias("url"))


def x13_payload_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each source's compact statistics as JSON."""
    c = tables.candidates(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return c.select("source", F.octet_length(F.to_json(F.struct("source", "n"))).alias("bytes"))


QUERIES = {f.__name__: f for f in (
    c17_cache_key, c22_folded_shape, x41_redacted, f10_deadline_closed, f9_local_day, t16_retention, t4_terminal, t1_sequence, u1_union, u8_without_flag, j3_backfilled_ids, j9_stats_by_source, x38_unseen,
    o15_autocomplete, x33_column_letter, x10_evidence_types, a14_active_jobs, x8_best_result, s13_season_urls, x13_payload_bytes,
)}

ORACLES = {
    "c17_cache_key": expected(["key"], [(k[1],) for k in KEYS]),
    "c22_folded_shape": expected(["shape"], [(s[1],) for s in SHAPES]),
    "x41_redacted": expected(["safe"], [(m[1],) for m in MESSAGES]),
    "f10_deadline_closed": "SELECT o_orderkey % 7 > 0 AND o_orderdate < DATE '1996-06-15' AS closed, count(*) AS n FROM orders GROUP BY 1",
    "f9_local_day": f"WITH {_LOG} SELECT event_id, strftime(ts, '%Y-%m-%d') AS utc, strftime(ts + INTERVAL '5 hours 30 minutes', '%Y-%m-%d') AS kolkata FROM log",
    "t16_retention": f"WITH {_LOG} SELECT kind, count(*) AS n FROM log WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 14 DAY GROUP BY 1",
    "t4_terminal": f"""
        WITH {_LOG}, s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k FROM log)
        SELECT job_id, coalesce(min(k) FILTER (kind = 'error'), max(k)) AS entries FROM s GROUP BY 1
    """,
    "t1_sequence": f"WITH {_LOG}, c AS (SELECT count(*) AS entries FROM log GROUP BY job_id) SELECT entries, count(*) AS jobs FROM c GROUP BY 1",
    "u1_union": "SELECT 'customers' AS source, c_mktsegment AS kind, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'suppliers', NULL, count(*) FROM supplier",
    "u8_without_flag": "SELECT o_orderstatus AS flags, count(*) AS n FROM orders GROUP BY 1",
    "j3_backfilled_ids": """
        SELECT o_orderkey IS NOT NULL AS filled, count(*) AS n, max(o_orderkey + 1000000) AS last FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0) ON l_orderkey = o_orderkey GROUP BY 1
    """,
    "j9_stats_by_source": f"WITH {_CAND} SELECT source, count(*) AS n, CASE source WHEN 'urgent' THEN 'healthy' WHEN 'low' THEN 'failed' END AS health FROM cand GROUP BY 1",
    "x38_unseen": f"WITH {_CAND} SELECT status, count(*) AS n FROM cand WHERE id NOT IN (SELECT user_id FROM events) GROUP BY 1",
    "o15_autocomplete": "SELECT n_name FROM nation WHERE lower(n_name) LIKE 'i%' ORDER BY 1 LIMIT 8",
    "x33_column_letter": expected(["letter"], [(c[1],) for c in COLUMNS]),
    "x10_evidence_types": """
        SELECT CASE o_orderkey % 8 WHEN 0 THEN 'official_page' WHEN 1 THEN 'apply_page' WHEN 2 THEN 'x_post' WHEN 3 THEN 'manual_lead' WHEN 4 THEN 'search_result' ELSE 'source_card' END AS type, count(*) AS n FROM orders GROUP BY 1
    """,
    "a14_active_jobs": f"WITH {_LOG}, l AS (SELECT arg_max(kind, {{'t': ts, 'e': event_id}}) AS kind FROM log GROUP BY job_id) SELECT count(*) AS active FROM l WHERE kind <> 'error'",
    "x8_best_result": "SELECT c_custkey, CASE WHEN c_custkey % 4 <= 2 THEN 'https://jam.devpost.com/' ELSE 'https://a.edu/apply' END AS url FROM customer WHERE c_custkey % 3 = 0",
    "s13_season_urls": "SELECT y, 'https://list.example/seasons/' || (y + d) || '/events' AS url FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders), (VALUES (0), (1)) v(d)",
    "x13_payload_bytes": f"WITH {_CAND}, c AS (SELECT source, count(*) AS n FROM cand GROUP BY 1) SELECT source, CAST(strlen('{{\"source\":\"' || source || '\",\"n\":' || n || '}}') AS INT) AS bytes FROM c",
}
