"""Further operators of the inventory over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import dates, text
from siftline.operators import upsert, views
from siftline.sources import tables

from .key_queries import _NORM, _PARTS, word_sql
from .record_queries import _CAND, _EVID, _LOG

#: Place words of the test corpus in order of precedence, with their country.
PLACES = {"la": "fr", "el": "es", "der": "de", "the": "en"}


def s17_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 100 dealt evenly over nations, the remainder to the first."""
    n = tables.table(spark, sf_dir, "nation")
    total = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy("n_nationkey")) - 1
    return n.select("n_nationkey", (F.floor(F.lit(130) / total) + (place < 130 % total).cast("int")).cast("long").alias("budget"))


def a12_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.candidates(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


def a16_duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("source", F.xxhash64("text").alias("h"))
    out = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("distinct_n"))
    return out.select("source", "n", "distinct_n", F.round(1 - F.col("distinct_n") / F.col("n"), 4).alias("duplicate_rate"))


def a17_mode_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common set of evidence types that records have."""
    ev = tables.evidence(spark, sf_dir)
    per = ev.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set("type")), "+").alias("signature"))
    counts = per.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("signature", F.struct("n", "signature")).alias("signature"), F.max("n").alias("n"))


def a19_column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and uniqueness of each column of parts, in long form."""
    part = tables.table(spark, sf_dir, "part")
    names = ["p_name", "p_brand", "p_type", "p_size"]
    long_form = part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*")
    out = long_form.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"), F.countDistinct("value").alias("distinct_n"))
    return out.select("path", F.round(F.col("filled") / F.col("n"), 4).alias("coverage"), F.round(F.col("distinct_n") / F.col("n"), 4).alias("uniqueness"))


def a22_date_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last day per year's batch, and whether it goes on from the one before."""
    o = tables.table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("batch")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("first_day"), F.max(F.col("o_orderdate").cast("date")).alias("last_day"), F.count(F.lit(1)).alias("n")
    )
    before = F.lag("last_day").over(Window.orderBy("batch"))
    return o.withColumn("progressed", F.coalesce(F.col("first_day") > before, F.lit(False)))


def a23_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good labels per source and the class that it gives."""
    docs, labels = tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels")
    out = docs.select("doc_id", "source").join(labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 4).alias("precision"))
    return out.withColumn("class", F.when(F.col("precision") >= 0.9, "complete").when(F.col("precision") >= 0.8, "degraded").otherwise("under_extracted"))


def a27_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = ["APPROVED", "NEEDS_REVIEW", "READY_FOR_REVIEW"]
    out = tables.candidates(spark, sf_dir).groupBy("source").pivot("status", statuses).agg(F.count(F.lit(1)))
    return out.select("source", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in statuses])


def a31_run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("kind") == "purchase").alias("stored"))
    status = F.when(F.col("errors") == 0, "COMPLETED").when(F.col("stored") > 0, "PARTIAL").otherwise("FAILED")
    return log.select(F.col("day").cast("date").alias("day"), "errors", "stored", status.alias("status"))


def c16_stable_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))
    return c.select("c_custkey", text.stable_key(F.col("c_name"), segment, F.lit(" "), F.col("c_nationkey")).alias("key"))


def f4_theme_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many wanted words each title holds as a whole word."""
    wanted = ["the", "de", "la", "and", "der"]
    return tables.leads(spark, sf_dir).select("page_id", sum((text.has_word(F.col("title"), w).cast("int") for w in wanted), F.lit(0)).alias("matches"))


def f23_open_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = tables.table(spark, sf_dir, "orders")
    deadline = F.when(F.col("o_orderkey") % 6 == 0, F.lit(" ")).when(F.col("o_orderkey") % 7 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.groupBy(dates.deadline_state(deadline, F.lit("1997-06-15")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def j1_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with its record's status; evidence without a record keeps null."""
    ev, c = tables.evidence(spark, sf_dir), tables.candidates(spark, sf_dir).filter("id % 5 > 0")
    out = ev.join(c, ev.candidate_id == c.id, "left")
    return out.groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


def j15_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contradictions among estimates: line quantities of an order of which one is at least half as much again and ten more.

    The inequality is inside an equi-join on the order, so no cross join arises.
    """
    ev = tables.evidence(spark, sf_dir).select("candidate_id", "ordinal", "seen_count")
    other = ev.select(F.col("candidate_id").alias("c"), F.col("ordinal").alias("o"), F.col("seen_count").alias("m"))
    apart = F.greatest("seen_count", "m") >= F.least("seen_count", "m") * 1.5 + 10
    bad = ev.join(other, (F.col("candidate_id") == F.col("c")) & (F.col("ordinal") < F.col("o")) & apart)
    return bad.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("contradictions"))


def k14_append_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New entries numbered on from the last stored one of their job."""
    log = tables.event_log(spark, sf_dir)
    stored, new = views.sequence(log.filter("event_id % 3 > 0")), log.filter("event_id % 3 = 0")
    last = stored.groupBy("job_id").agg(F.max("sequence").alias("last"))
    out = views.sequence(new).join(last, "job_id", "left")
    return out.select("event_id", "job_id", (F.coalesce("last", F.lit(0)) + F.col("sequence")).alias("sequence"))


def o14_did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation that a misspelt name most likely means: the first of the closest within two edits."""
    n = tables.table(spark, sf_dir, "nation").withColumn("distance", F.levenshtein(F.lower("n_name"), F.lit("gemrany"))).filter("distance <= 2")
    return n.agg(F.min_by("n_name", F.struct("distance", "n_nationkey")).alias("n_name"), F.min("distance").alias("distance"))


def u6_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, sold = tables.table(spark, sf_dir, "part"), tables.table(spark, sf_dir, "lineitem").filter("l_quantity > 45")
    return parts.select("p_partkey").exceptAll(sold.select(F.col("l_partkey").alias("p_partkey")).distinct())


def w2_partition_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("candidate_id")
    ev = tables.evidence(spark, sf_dir)
    return ev.select("candidate_id", "ordinal", "part", F.min("seen_at").over(w).alias("first_seen"), F.sum("seen_count").over(w).cast("long").alias("seen"))


def w7_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir)
    gap = F.col("value") - F.lag("value").over(Window.partitionBy("job_id").orderBy("ts", "event_id"))
    return log.select("event_id", F.round(gap, 2).alias("gain"))


def w11_reused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of titles that more than one page has, per source."""
    per = tables.leads(spark, sf_dir).groupBy("source", text.normalize_text(F.col("title")).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source").agg(F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("reused"))


def m11_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between stored and incoming records, how many differ in each field."""
    c = tables.candidates(spark, sf_dir)
    new = c.withColumn("score", F.when(F.col("id") % 6 == 0, F.lit(None)).otherwise(F.col("score"))).withColumn("name", F.when(F.col("id") % 8 == 0, F.lit("x")).otherwise(F.col("name")))
    return upsert.parity(c, new, ["id"], ["score", "name", "source"])


QUERIES = {f.__name__: f for f in (
    s17_budgets, a12_source_counts, a16_duplicate_rate, a17_mode_signature, a19_column_roles, a22_date_coverage,
    a23_quality, a27_bucket_counts, a31_run_status, c16_stable_key, f4_theme_match, f23_open_state, j1_lookup, j15_theta,
    k14_append_sequence, o14_did_you_mean, u6_difference, w2_partition_frames, w7_progression, w11_reused, m11_changed_fields, 
)}

_KIND_WORTH = "CASE WHEN regexp_matches(lower(path), '(^|/)(tag|tags|category|calendar|explore|discover|search)(/|$)') OR regexp_matches(lower(path), '(^|/)(u|user|users|profile|people)/') THEN 0 WHEN regexp_matches(lower(path), '[.]html?$') THEN 2 WHEN regexp_matches(path, '/[0-9]+/?$') THEN 1 ELSE 0 END"

ORACLES = {
    "s17_budgets": "SELECT n_nationkey, CAST(130 // total + CASE WHEN place < 130 % total THEN 1 ELSE 0 END AS BIGINT) AS budget FROM (SELECT n_nationkey, count(*) OVER () AS total, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation)",
    "a12_source_counts": f"WITH {_CAND} SELECT source, count(*) AS n FROM cand GROUP BY source",
    "a16_duplicate_rate": "SELECT source, count(*) AS n, count(DISTINCT text) AS distinct_n, round(1 - count(DISTINCT text) / count(*), 4) AS duplicate_rate FROM documents GROUP BY source",
    "a17_mode_signature": f"WITH {_EVID}, p AS (SELECT candidate_id, string_agg(DISTINCT type, '+' ORDER BY type) AS signature FROM evid GROUP BY 1) SELECT signature, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, signature DESC LIMIT 1",
    "a19_column_roles": " UNION ALL ".join(f"SELECT '{c}' AS path, round(count({c}) / count(*), 4) AS coverage, round(count(DISTINCT {c}) / count(*), 4) AS uniqueness FROM part" for c in ("p_name", "p_brand", "p_type", "p_size")),
    "a22_date_coverage": """
        SELECT *, coalesce(first_day > lag(last_day) OVER (ORDER BY batch), false) AS progressed
        FROM (SELECT CAST(year(o_orderdate) AS INT) AS batch, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, count(*) AS n FROM orders GROUP BY 1)
    """,
    "a23_quality": """
        SELECT *, CASE WHEN precision >= 0.9 THEN 'complete' WHEN precision >= 0.8 THEN 'degraded' ELSE 'under_extracted' END AS class
        FROM (SELECT source, count(*) AS n, round(avg(quality), 4) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY source)
    """,
    "a27_bucket_counts": f"WITH {_CAND} SELECT source, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (status = 'READY_FOR_REVIEW') AS ready_for_review FROM cand GROUP BY source",
    "a31_run_status": f"""
        WITH {_LOG}, d AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (kind = 'purchase') AS stored FROM log GROUP BY 1)
        SELECT *, CASE WHEN errors = 0 THEN 'COMPLETED' WHEN stored > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM d
    """,
    "c16_stable_key": "SELECT c_custkey, lower(concat_ws('|', c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, c_nationkey)) AS key FROM customer",
    "f4_theme_match": "SELECT page_id, CAST(" + " + ".join(f"CASE WHEN {word_sql('title', w)} THEN 1 ELSE 0 END" for w in ("the", "de", "la", "and", "der")) + " AS INT) AS matches FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)",
    "f23_open_state": "SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'unclear' WHEN o_orderdate < DATE '1997-06-15' THEN 'closed' ELSE 'open' END AS state, count(*) AS n FROM orders GROUP BY 1",
    "j1_lookup": f"WITH {_CAND}, {_EVID} SELECT type, status, count(*) AS n FROM evid LEFT JOIN (SELECT * FROM cand WHERE id % 5 > 0) ON candidate_id = id GROUP BY 1, 2",
    "j15_theta": f"WITH {_EVID} SELECT a.candidate_id, count(*) AS contradictions FROM evid a JOIN evid b ON a.candidate_id = b.candidate_id AND a.ordinal < b.ordinal AND greatest(a.seen_count, b.seen_count) >= least(a.seen_count, b.seen_count) * 1.5 + 10 GROUP BY 1",
    "k14_append_sequence": f"""
        WITH {_LOG}, s AS (SELECT job_id, count(*) AS last FROM log WHERE event_id % 3 > 0 GROUP BY 1)
        SELECT event_id, job_id, coalesce(last, 0) + row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS sequence FROM log LEFT JOIN s USING (job_id) WHERE event_id % 3 = 0
    """,
    "o14_did_you_mean": "SELECT arg_min(n_name, {'d': d, 'k': n_nationkey}) AS n_name, CAST(min(d) AS INT) AS distance FROM (SELECT *, levenshtein(lower(n_name), 'gemrany') AS d FROM nation) WHERE d <= 2",
    "u6_difference": "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45",
    "w2_partition_frames": f"WITH {_EVID} SELECT candidate_id, ordinal, part, min(seen_at) OVER w AS first_seen, CAST(sum(seen_count) OVER w AS BIGINT) AS seen FROM evid WINDOW w AS (PARTITION BY candidate_id)",
    "w7_progression": f"WITH {_LOG} SELECT event_id, round(value - lag(value) OVER (PARTITION BY job_id ORDER BY ts, event_id), 2) AS gain FROM log",
    "w11_reused": f"""
        WITH {_PARTS}, p AS (SELECT source, {_NORM.format('title')} AS t, count(*) AS n FROM parts GROUP BY 1, 2)
        SELECT source, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 4) AS reused FROM p GROUP BY source
    """,
    "m11_changed_fields": f"WITH {_CAND} SELECT CAST(0 AS BIGINT) AS missing, count(*) FILTER (id % 6 = 0) AS score_differs, count(*) FILTER (id % 8 = 0) AS name_differs, CAST(0 AS BIGINT) AS source_differs FROM cand",
}
