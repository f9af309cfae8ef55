"""Records: rules and scores, evidence, upsert plans, queues, resolution, the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import keys, text, urls
from siftline.operators import resolve, rules, upsert, views
from siftline.sources import tables

from .key_queries import _NORM, _PARTS

_CAND = """
    cand AS (
        SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'READY_FOR_REVIEW' ELSE 'NEEDS_REVIEW' END AS status,
               lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS source, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INT) AS score,
               CAST(o_orderdate AS DATE) AS found_at, 'record ' || o_custkey AS name
        FROM orders
    )
"""
_EVID = """
    evid AS (
        SELECT l_orderkey AS candidate_id, CASE l_returnflag WHEN 'A' THEN 'official_page' WHEN 'R' THEN 'apply_page' ELSE 'search_result' END AS type,
               'https://host' || (l_partkey % 3) || '.example.org/' || (l_suppkey % 5) AS url_key, CAST(l_shipdate AS DATE) AS seen_at,
               CAST(l_quantity AS INT) AS seen_count, l_linenumber AS ordinal, l_partkey AS part, l_suppkey AS supplier
        FROM lineitem
    )
"""
_GROUPS = f"""
    {_EVID},
    grp AS (
        SELECT candidate_id, type, url_key, CAST(sum(seen_count) AS BIGINT) AS seen_count, max(seen_at) AS last_seen, count(*) AS members,
               CASE type WHEN 'official_page' THEN 100 WHEN 'apply_page' THEN 90 ELSE 35 END AS authority
        FROM evid GROUP BY 1, 2, 3
    )
"""
_LOG = """
    log AS (
        SELECT event_id, user_id AS job_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
               event_type AS kind, value, props AS metadata
        FROM events
    )
"""
_AUTH = "CASE source WHEN 'mlh' THEN 80 WHEN 'devpost' THEN 78 WHEN 'luma' THEN 70 WHEN 'hacklist' THEN 55 WHEN 'hakku' THEN 55 WHEN 'web' THEN 40 WHEN 'x' THEN 20 WHEN 'custom:board' THEN 60 ELSE 30 END"

#: The vocabulary that the flagship query asks for.
VOCABULARY = ["the", "and", "that", "de", "la", "que", "der", "und", "el", "los"]


def pipeline_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which distinct pages best match the vocabulary: scan, key, keep the first, score, take 20.

    Duplicates go before bodies are cleaned, so each distinct page is cleaned once.
    """
    leads = tables.leads(spark, sf_dir).withColumn("fingerprint", F.concat(F.lit("official:"), urls.identity_url(F.col("url"))))
    leads = leads.withColumn("authority", keys.authority(F.col("source")))
    best = leads.groupBy("fingerprint").agg(F.max_by(F.struct("page_id", "source", "authority", "html"), F.struct(F.col("authority"), -F.col("page_id"))).alias("x")).select("fingerprint", "x.*")
    words = F.array_distinct(F.split(text.normalize_text(tables.strip_tags(F.col("html"))), " "))
    hits = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in VOCABULARY]))).cast("long")
    scored = best.withColumn("hits", hits).filter("hits > 0")
    scored = scored.withColumn("score", rules.clamp(40 + F.least(10 * F.col("hits"), F.lit(30)) + 10 + 8 * (F.col("authority") >= 70).cast("int")).cast("int"))
    return scored.orderBy(F.desc("score"), F.desc("page_id")).limit(20).select("page_id", "fingerprint", "source", "hits", "score")


def r1_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "customer").join(F.broadcast(tables.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    score = rules.rank(
        place=F.col("n_regionkey") == 1, remote=F.col("c_custkey") % 3 == 0, themes=(F.col("c_custkey") % 5), apply=F.col("c_acctbal") > 0,
        official=F.col("c_custkey") % 2 == 0, prize=F.col("c_acctbal") > 5000, student=F.col("c_mktsegment") == "BUILDING",
        authority=keys.authority(F.element_at(F.array(*[F.lit(s) for s in tables.SOURCES]), (F.col("c_custkey") % 8 + 1).cast("int"))),
        has_start=F.col("c_custkey") % 7 > 0, metro=F.col("c_nationkey") == 3,
    )
    return c.select("c_custkey", score.alias("score"))


def f31_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each answer its conversation's question supports."""
    said = tables.table(spark, sf_dir, "conversations")
    asked = said.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    share = text.support(F.col("question"), F.col("text"))
    both = said.filter("role = 'assistant'").join(asked, "conv_id")
    return both.groupBy("conv_id").agg(F.count(F.lit(1)).alias("answers"), F.round(F.max(share), 4).alias("support"))


def a1_source_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and in total: discovered, distinct, dropped, and share of duplicates."""
    leads = tables.leads(spark, sf_dir).withColumn("key", urls.dedupe_key(F.col("url")))
    out = leads.rollup("source").agg(F.count(F.lit(1)).alias("discovered"), F.countDistinct("key").alias("returned"))
    dropped = F.col("discovered") - F.col("returned")
    return out.select(F.coalesce("source", F.lit("total")).alias("source"), "discovered", "returned", dropped.alias("dropped"), F.round(dropped / F.col("discovered"), 4).alias("duplicate_rate"))


def a4_quality_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.candidates(spark, sf_dir)
    return c.groupBy("source").agg(
        F.count_if(F.expr("status = 'APPROVED'")).alias("approved"), F.count_if(F.expr("status = 'READY_FOR_REVIEW'")).alias("ready"),
        F.count_if(F.expr("status = 'NEEDS_REVIEW'")).alias("review"), F.count_if(F.expr("score >= 70")).alias("strong"), F.count_if(F.expr("score < 30")).alias("weak"),
    )


def a10_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.evidence(spark, sf_dir)
    return ev.groupBy("candidate_id", "type", "url_key").agg(
        F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.sum("seen_count").cast("long").alias("seen_count")
    )


def a11_evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.evidence_groups(tables.evidence(spark, sf_dir))


def a20_repeated_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated element shapes of pages: how many pages hold them and how often."""
    opened = tables.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)[ >]"), F.lit(1))).alias("tag"))
    per = opened.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return per.groupBy("tag").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").cast("long").alias("units"), F.max("n").alias("most"))


def a25_timing_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir)
    return log.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"), F.max_by("value", F.struct("ts", "event_id")).alias("last")
    )


def w1_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.evidence(spark, sf_dir)
    first = upsert.keep_first(ev, ["candidate_id", "type"], [F.asc("seen_at"), F.asc("ordinal"), F.asc("part"), F.asc("supplier")])
    return first.select("candidate_id", "type", "seen_at", "ordinal", "part")


def w4_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of a job takes the value of the last purchase before it."""
    log = tables.event_log(spark, sf_dir).withColumn("price", F.when(F.col("kind") == "purchase", F.col("value")))
    return views.forward_fill(log.withColumn("at", F.struct("ts", "event_id")), "price", "job_id", "at").select("event_id", "price")


def w5_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sequence(tables.event_log(spark, sf_dir)).select("event_id", "job_id", "sequence")


def w6_growth_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New addresses per step of ten pages, with runs of steps that brought none."""
    leads = tables.leads(spark, sf_dir)
    steps = leads.select(F.floor(F.col("page_id") / 10).cast("long").alias("step"), F.regexp_replace(urls.host(F.col("url")), "^(m|blog)[.]", "").alias("identity"))
    return resolve.growth(steps, "step", "identity").select("step", "new", "total", "dry_steps")


def w9_action_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three entries of each job, and how many older ones are folded away."""
    log = tables.event_log(spark, sf_dir)
    w = Window.partitionBy("job_id").orderBy(F.desc("ts"), F.desc("event_id"))
    ranked = log.withColumn("position", F.row_number().over(w)).withColumn("entries", F.count(F.lit(1)).over(Window.partitionBy("job_id")))
    return ranked.filter("position <= 3").select("job_id", "position", "event_id", "kind", F.greatest(F.col("entries") - 3, F.lit(0)).alias("folded"))


def w12_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = tables.event_log(spark, sf_dir).withColumn("size", F.octet_length("metadata").cast("long"))
    return views.byte_prefix(log, "size", "event_id", 40, "job_id").select("event_id", "job_id", "used")


def o1_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page(tables.candidates(spark, sf_dir), "score", 20, statuses=["READY_FOR_REVIEW", "NEEDS_REVIEW"]).select("id", "status", "score", "found_at")


def o3_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    cursor = (97, datetime.date(1998, 1, 1), 500)
    return views.page(tables.candidates(spark, sf_dir), "score", 25, cursor=cursor).select("id", "score", "found_at")


def a13_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.candidates(spark, sf_dir).filter(F.col("status") == "APPROVED").groupBy("source").agg(F.count(F.lit(1)).alias("total"))


def w10_primary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.primary_evidence(views.evidence_groups(tables.evidence(spark, sf_dir)))
    return out.select("candidate_id", "position", "type", "url_key", "seen_count")


def m10_upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan of an upsert: stored are all but each 10th record, some of them stale."""
    c = tables.candidates(spark, sf_dir)
    existing = c.filter("id % 10 <> 0").withColumn("score", F.when(F.col("id") % 4 == 0, F.lit(0)).otherwise(F.col("score")))
    incoming = c.filter("id % 3 <> 0")
    return upsert.plan(existing, incoming, "id", ["name", "source", "score"]).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def m9_row_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after that upsert; status stays as stored."""
    c = tables.candidates(spark, sf_dir)
    existing = c.filter("id % 10 <> 0").withColumn("score", F.lit(0)).withColumn("status", F.lit("SAVED"))
    return upsert.snapshot(existing, c.filter("id % 3 <> 0"), "id", ["name", "score"], ["status"])


def m12_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.evidence(spark, sf_dir).withColumn("title", F.when(F.col("part") % 2 == 0, F.concat(F.lit("part "), F.col("part"))))
    return upsert.observe(ev, ["candidate_id", "type"], "title", "seen_at", "ordinal", "seen_count")


def m16_latest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.latest_status(tables.event_log(spark, sf_dir), "job_id", "kind", ["ts", "event_id"])


def a30_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between consolidated evidence and a copy with some counts off."""
    left = a10_consolidate(spark, sf_dir)
    right = left.filter("candidate_id % 50 <> 0").withColumn("seen_count", F.col("seen_count") + (F.col("candidate_id") % 20 == 0).cast("int"))
    return upsert.parity(left, right, ["candidate_id", "type", "url_key"], ["first_seen", "last_seen", "seen_count"])


def k12_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.candidates(spark, sf_dir)
    return upsert.reconcile(c.filter("status = 'APPROVED'"), c.filter("id % 2 = 0"), "id").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def k9_sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.candidates(spark, sf_dir).filter("status = 'APPROVED'")
    return c.select(F.concat_ws(",", "id", "name", "source", "score", F.date_format("found_at", "yyyy-MM-dd")).alias("row"))


def j6_blocking_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    leads = tables.leads(spark, sf_dir)
    ks = leads.select(F.col("page_id").alias("ordinal"), F.lit("url").alias("kind"), urls.identity_url(F.col("url")).alias("key"))
    ks = ks.unionByName(leads.select(F.col("page_id").alias("ordinal"), F.lit("title").alias("kind"), text.normalize_text(F.col("title")).alias("key")))
    return resolve.blocking_edges(ks)


def m8_entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages linked through address or title, merged by authority of their source."""
    leads = tables.leads(spark, sf_dir)
    ks = leads.select(F.col("page_id").alias("ordinal"), F.lit("url").alias("kind"), urls.identity_url(F.col("url")).alias("key"))
    ks = ks.unionByName(leads.select(F.col("page_id").alias("ordinal"), F.lit("title").alias("kind"), text.normalize_text(F.col("title")).alias("key")))
    records = leads.select(F.col("page_id").alias("ordinal"), keys.authority(F.col("source")).alias("authority"), "url", "source")
    return resolve.resolve(records, ks, ["url", "source"])


def j10_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, ev = tables.candidates(spark, sf_dir), tables.evidence(spark, sf_dir).filter("type = 'official_page'")
    return c.join(ev, c.id == ev.candidate_id, "left_semi").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def j11_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, ev = tables.candidates(spark, sf_dir), tables.evidence(spark, sf_dir).filter("type = 'official_page'")
    return c.join(ev, c.id == ev.candidate_id, "left_anti").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def u2_ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's parts in order of lines, repeats dropped."""
    ev = tables.evidence(spark, sf_dir).groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "part", "supplier"))).alias("x"))
    parts = F.array_distinct(F.transform("x", lambda e: e["supplier"] % 7))
    return ev.select("candidate_id", F.array_join(parts.cast("array<string>"), ",").alias("parts"))


def t6_status_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each job from its log: entries, errors, first and last time, status."""
    log = tables.event_log(spark, sf_dir)
    errors = F.count_if(F.col("level") == "error")
    status = F.when(errors == 0, "COMPLETED").when(errors < F.count(F.lit(1)), "PARTIAL").otherwise("FAILED")
    return log.groupBy("job_id").agg(F.count(F.lit(1)).alias("entries"), errors.alias("errors"), F.min("ts").alias("started"), F.max("ts").alias("ended"), status.alias("status"))


def t2_tail_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each job logged after its fifth entry."""
    return views.sequence(tables.event_log(spark, sf_dir)).filter("sequence > 5").select("job_id", "sequence", "kind")


QUERIES = {f.__name__: f for f in (
    pipeline_topk, r1_rank, f31_groundedness, a1_source_accounting, a4_quality_counters, a10_consolidate,
    a11_evidence_groups, a13_total, a20_repeated_units, a25_timing_buckets, w1_keep_first, w4_forward_fill, w5_sequence, w6_growth_steps, w9_action_history, w10_primary_evidence,
    w12_byte_budget, o1_queue_page, o3_keyset_page, m8_entity_resolution, m9_row_merge, m10_upsert_plan, m12_observations, m16_latest_bucket, a30_parity, k9_sheet_rows, k12_reconcile,
    j6_blocking_edges, j10_semi, j11_anti, u2_ordered_union, t2_tail_after, t6_status_projection,
)}

_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_VOCAB = "[" + ", ".join(f"'{w}'" for w in VOCABULARY) + "]"

ORACLES = {
    "pipeline_topk": f"""
        WITH {_PARTS},
        best AS (SELECT 'official:' || identity AS fingerprint, page_id, source, {_AUTH} AS authority FROM ids
                 QUALIFY row_number() OVER (PARTITION BY identity ORDER BY {_AUTH} DESC, page_id) = 1),
        hit AS (SELECT b.*, CAST(len(list_filter({_VOCAB}, lambda w: list_contains(string_split({_NORM.format(_STRIP)}, ' '), w))) AS BIGINT) AS hits FROM best b JOIN pages USING (page_id))
        SELECT page_id, fingerprint, source, hits, CAST(least(100, 50 + least(10 * hits, 30) + CASE WHEN authority >= 70 THEN 8 ELSE 0 END) AS INT) AS score
        FROM hit WHERE hits > 0 ORDER BY score DESC, page_id DESC LIMIT 20
    """,
    "r1_rank": f"""
        SELECT c_custkey, CAST(greatest(0, least(100, 40 + CASE WHEN n_regionkey = 1 THEN 25 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 20 ELSE 0 END
               + least(10 * (c_custkey % 5), 30) + CASE WHEN c_acctbal > 0 THEN 10 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 10 ELSE 0 END
               + CASE WHEN c_acctbal > 5000 THEN 8 ELSE 0 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 8 ELSE 0 END
               + CASE WHEN c_custkey % 8 IN (0, 1, 2) THEN 8 ELSE 0 END - CASE WHEN c_custkey % 7 = 0 THEN 10 ELSE 0 END + CASE WHEN c_nationkey = 3 THEN 5 ELSE 0 END)) AS INT) AS score
        FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
    "f31_groundedness": f"""
        WITH q AS (SELECT conv_id, list_distinct(list_filter(string_split({_NORM.format('arg_min(text, turn)')}, ' '), lambda x: length(x) >= 4)) AS w FROM conversations WHERE role = 'user' GROUP BY conv_id),
             a AS (SELECT conv_id, list_distinct(string_split({_NORM.format('text')}, ' ')) AS t FROM conversations WHERE role = 'assistant')
        SELECT conv_id, count(*) AS answers, round(max(CASE WHEN len(w) > 0 THEN len(list_intersect(w, t)) / len(w) END), 4) AS support FROM a JOIN q USING (conv_id) GROUP BY conv_id
    """,
    "a1_source_accounting": f"""
        WITH {_PARTS},
        k AS (SELECT source, scheme || '://' || host || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS key FROM parts),
        r AS (SELECT coalesce(source, 'total') AS source, count(*) AS discovered, count(DISTINCT key) AS returned FROM k GROUP BY ROLLUP (source))
        SELECT source, discovered, returned, discovered - returned AS dropped, round((discovered - returned) / discovered, 4) AS duplicate_rate FROM r
    """,
    "a4_quality_counters": f"WITH {_CAND} SELECT source, count(*) FILTER (status = 'APPROVED') AS approved, count(*) FILTER (status = 'READY_FOR_REVIEW') AS ready, count(*) FILTER (status = 'NEEDS_REVIEW') AS review, count(*) FILTER (score >= 70) AS strong, count(*) FILTER (score < 30) AS weak FROM cand GROUP BY source",
    "a10_consolidate": f"WITH {_EVID} SELECT candidate_id, type, url_key, min(seen_at) AS first_seen, max(seen_at) AS last_seen, CAST(sum(seen_count) AS BIGINT) AS seen_count FROM evid GROUP BY 1, 2, 3",
    "a11_evidence_groups": f"WITH {_GROUPS} SELECT * FROM grp",
    "a13_total": f"WITH {_CAND} SELECT source, count(*) AS total FROM cand WHERE status = 'APPROVED' GROUP BY source",
    "a20_repeated_units": """
        WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages),
             p AS (SELECT page_id, tag, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) > 1)
        SELECT tag, count(*) AS pages, CAST(sum(n) AS BIGINT) AS units, max(n) AS most FROM p GROUP BY tag
    """,
    "a25_timing_buckets": f"WITH {_LOG} SELECT kind, count(*) AS n, round(avg(value), 4) AS mean, max(value) AS most, arg_max(value, (ts, event_id)) AS last FROM log GROUP BY kind",
    "w1_keep_first": f"WITH {_EVID} SELECT candidate_id, type, seen_at, ordinal, part FROM evid QUALIFY row_number() OVER (PARTITION BY candidate_id, type ORDER BY seen_at, ordinal, part, supplier) = 1",
    "w4_forward_fill": f"WITH {_LOG} SELECT event_id, last_value(CASE WHEN kind = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS price FROM log",
    "w5_sequence": f"WITH {_LOG} SELECT event_id, job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS sequence FROM log",
    "w6_growth_steps": f"""
        WITH {_PARTS},
        s AS (SELECT page_id // 10 AS step, regexp_replace(host, '^(m|blog)[.]', '') AS identity FROM parts),
        f AS (SELECT identity, min(step) AS step FROM s GROUP BY 1), n AS (SELECT step, count(*) AS new FROM f GROUP BY 1),
        e AS (SELECT step, coalesce(new, 0) AS new FROM (SELECT DISTINCT step FROM s) LEFT JOIN n USING (step)),
        i AS (SELECT *, sum(CAST(new > 0 AS INT)) OVER (ORDER BY step) AS island, CAST(sum(new) OVER (ORDER BY step) AS BIGINT) AS total FROM e)
        SELECT step, new, total, CAST(sum(CAST(new = 0 AS INT)) OVER (PARTITION BY island ORDER BY step) AS BIGINT) AS dry_steps FROM i
    """,
    "w9_action_history": f"""
        WITH {_LOG} SELECT job_id, CAST(position AS INT) AS position, event_id, kind, greatest(entries - 3, 0) AS folded
        FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS position, count(*) OVER (PARTITION BY job_id) AS entries FROM log) WHERE position <= 3
    """,
    "w10_primary_evidence": f"""
        WITH {_GROUPS}, o AS (SELECT *, max(CAST(type = 'official_page' AS INT)) OVER (PARTITION BY candidate_id, url_key) AS has FROM grp)
        SELECT candidate_id, CAST(position AS INT) AS position, type, url_key, seen_count
        FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY authority DESC, last_seen DESC, url_key) AS position FROM o WHERE NOT (type = 'apply_page' AND has = 1)) WHERE position <= 5
    """,
    "w12_byte_budget": f"WITH {_LOG} SELECT * FROM (SELECT event_id, job_id, CAST(sum(octet_length(encode(metadata))) OVER (PARTITION BY job_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM log) WHERE used <= 40",
    "o1_queue_page": f"WITH {_CAND} SELECT id, status, score, found_at FROM cand WHERE status IN ('READY_FOR_REVIEW', 'NEEDS_REVIEW') ORDER BY score DESC, found_at DESC, id DESC LIMIT 20",
    "o3_keyset_page": f"WITH {_CAND} SELECT id, score, found_at FROM cand WHERE (score, found_at, id) < (97, DATE '1998-01-01', 500) ORDER BY score DESC, found_at DESC, id DESC LIMIT 25",
    "m8_entity_resolution": f"""
        WITH RECURSIVE {_PARTS},
        k AS (SELECT page_id, 'u' || identity AS key FROM ids UNION ALL SELECT page_id, 't' || {_NORM.format('title')} FROM ids WHERE {_NORM.format('title')} <> ''),
        f AS (SELECT key, min(page_id) AS a FROM k GROUP BY key), e AS (SELECT DISTINCT a, page_id AS b FROM k JOIN f USING (key) WHERE a <> page_id),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        walk AS (SELECT page_id AS n, page_id AS r FROM ids UNION SELECT b, r FROM walk JOIN both_ways ON n = a),
        root AS (SELECT n AS page_id, min(r) AS root FROM walk GROUP BY n),
        rec AS (SELECT root, page_id, url, source, {_AUTH} AS authority FROM ids JOIN root USING (page_id))
        SELECT root, count(*) AS members, arg_max(url, (authority, -page_id)) AS url, arg_max(source, (authority, -page_id)) AS source FROM rec GROUP BY root
    """,
    "m9_row_merge": f"""
        WITH {_CAND}, a AS (SELECT * FROM cand WHERE id % 10 <> 0), b AS (SELECT * FROM cand WHERE id % 3 <> 0)
        SELECT coalesce(a.id, b.id) AS id, coalesce(b.name, a.name) AS name, CASE WHEN b.id IS NOT NULL THEN b.score ELSE 0 END AS score, CASE WHEN a.id IS NOT NULL THEN 'SAVED' ELSE b.status END AS status
        FROM a FULL JOIN b ON a.id = b.id
    """,
    "m10_upsert_plan": f"""
        WITH {_CAND}, a AS (SELECT id, name, source, CASE WHEN id % 4 = 0 THEN 0 ELSE score END AS score FROM cand WHERE id % 10 <> 0), b AS (SELECT * FROM cand WHERE id % 3 <> 0)
        SELECT CASE WHEN a.id IS NULL THEN 'create' WHEN b.id IS NULL THEN 'absent' WHEN a.score IS DISTINCT FROM b.score THEN 'update' ELSE 'unchanged' END AS action, count(*) AS n
        FROM a FULL JOIN b ON a.id = b.id GROUP BY 1
    """,
    "m12_observations": f"""
        WITH {_EVID} SELECT candidate_id, type, min(seen_at) AS first_seen, max(seen_at) AS last_seen, CAST(sum(seen_count) AS BIGINT) AS seen_count,
               arg_max('part ' || part, (seen_at, ordinal, 'part ' || part)) FILTER (part % 2 = 0) AS title FROM evid GROUP BY 1, 2
    """,
    "m16_latest_bucket": f"WITH {_LOG} SELECT job_id, arg_max(kind, (ts, event_id)) AS kind FROM log GROUP BY job_id",
    "a30_parity": f"""
        WITH {_EVID}, a AS (SELECT candidate_id, type, url_key, sum(seen_count) AS n FROM evid GROUP BY 1, 2, 3)
        SELECT count(*) FILTER (candidate_id % 50 = 0) AS missing, CAST(0 AS BIGINT) AS first_seen_differs, CAST(0 AS BIGINT) AS last_seen_differs,
               count(*) FILTER (candidate_id % 50 <> 0 AND candidate_id % 20 = 0) AS seen_count_differs FROM a
    """,
    "k9_sheet_rows": f"WITH {_CAND} SELECT concat_ws(',', id, name, source, score, strftime(found_at, '%Y-%m-%d')) AS row FROM cand WHERE status = 'APPROVED'",
    "k12_reconcile": f"""
        WITH {_CAND}, w AS (SELECT id FROM cand WHERE status = 'APPROVED'), p AS (SELECT id FROM cand WHERE id % 2 = 0)
        SELECT CASE WHEN p.id IS NULL THEN 'append' WHEN w.id IS NULL THEN 'delete' ELSE 'noop' END AS action, count(*) AS n FROM w FULL JOIN p ON w.id = p.id GROUP BY 1
    """,
    "j6_blocking_edges": f"""
        WITH {_PARTS},
        k AS (SELECT page_id, 'u' || identity AS key FROM ids UNION ALL SELECT page_id, 't' || {_NORM.format('title')} FROM ids WHERE {_NORM.format('title')} <> ''),
        f AS (SELECT key, min(page_id) AS a FROM k GROUP BY key)
        SELECT DISTINCT a, page_id AS b FROM k JOIN f USING (key) WHERE a <> page_id
    """,
    "j10_semi": f"WITH {_CAND}, {_EVID} SELECT status, count(*) AS n FROM cand WHERE id IN (SELECT candidate_id FROM evid WHERE type = 'official_page') GROUP BY status",
    "j11_anti": f"WITH {_CAND}, {_EVID} SELECT status, count(*) AS n FROM cand WHERE id NOT IN (SELECT candidate_id FROM evid WHERE type = 'official_page') GROUP BY status",
    "u2_ordered_union": f"""
        WITH {_EVID}, f AS (SELECT candidate_id, supplier % 7 AS v, min((ordinal, part, supplier)) AS pos FROM evid GROUP BY 1, 2)
        SELECT candidate_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS parts FROM f GROUP BY candidate_id
    """,
    "t2_tail_after": f"WITH {_LOG} SELECT job_id, sequence, kind FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS sequence FROM log) WHERE sequence > 5",
    "t6_status_projection": f"""
        WITH {_LOG} SELECT job_id, count(*) AS entries, count(*) FILTER (level = 'error') AS errors, min(ts) AS started, max(ts) AS ended,
               CASE WHEN count(*) FILTER (level = 'error') = 0 THEN 'COMPLETED' WHEN count(*) FILTER (level = 'error') < count(*) THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM log GROUP BY job_id
    """,
}
