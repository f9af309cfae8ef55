"""Keys and projections: canonical text, URL identities, fingerprints, tags, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import dates, keys, text, urls
from siftline.sources import tables

#: Words tagged in texts of the test corpus, by theme.
THEMES = {"time": "the|and", "place": "in|on|at", "french": "le|la|les", "german": "der|die|das", "spanish": "el|los|las"}

_SOURCE = "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(tables.SOURCES)) + " END"
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), 'https?://', '', 'g'), 'www\\.', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
#: url, then host without www. and port, path and query of a page's address
_PARTS = f"""
    parts AS (
        SELECT page_id, url, {_SOURCE} AS source, {_TITLE} AS title,
               regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
               regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), ':[0-9]*$', ''), '^www\\.', '') AS host,
               regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
               string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') AS params
        FROM pages
    ),
    ids AS (
        SELECT *, scheme || '://' || host || regexp_replace(path, '/$', '') ||
               CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS identity
        FROM (SELECT *, list_transform(list_sort(list_transform(list_filter(params, lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|fbclid|gclid|mc_|ref)')), lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': p}})), lambda x: x.p) AS kept FROM parts)
    )
"""


def word_sql(column: str, pattern: str) -> str:
    return f"regexp_matches(lower({column}), '(^|[^a-z0-9_])({pattern})([^a-z0-9_]|$)')"


def c1_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normalized"))


def c2_identity_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", urls.identity_url(F.col("url")).alias("identity_url"))


def c3_evidence_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", urls.evidence_key(F.col("url")).alias("url_key"))


def c4_provisional_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", urls.provisional_key(F.col("url")).alias("url_key"))


def c5_dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", urls.dedupe_key(F.col("url")).alias("dedupe_key"))


def c8_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.leads(spark, sf_dir).select("page_id", text.slugify(F.col("title")).alias("slug"))


def c12_source_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.leads(spark, sf_dir).select("page_id", keys.source_url_identity(F.col("source"), F.col("url")).alias("identity"))


def c13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tier of the fingerprint: which address a page has goes by its number."""
    n, none = F.col("page_id") % 5, F.lit(None).cast("string")
    ids = F.when(n == 3, F.create_map(F.lit("page"), F.array(F.col("page_id").cast("string"))))
    fp = keys.fingerprint(
        F.when(n == 0, F.col("url")), F.when(n == 1, F.col("url")), F.when(n == 2, F.col("url")), ids,
        F.col("title"), F.lit("Paris France"), none, F.lit("2026-07-16T12:00:00Z"),
    )
    return tables.leads(spark, sf_dir).select("page_id", fp.alias("fingerprint"))


def c15_soft_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = tables.table(spark, sf_dir, "customer")
    city = F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("City "), F.col("c_nationkey")))
    mode = F.when(F.col("c_custkey") % 2 == 0, "Online")
    name = F.concat(F.col("c_name"), F.lit(" 2025 Edition"))
    return customers.select("c_custkey", keys.soft_key(name, city, mode, F.lit("2026-03-01"), F.lit(None).cast("string")).alias("soft_key"))


def c18_identity_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.evidence(spark, sf_dir)
    return ev.select(text.identity_hash(F.col("candidate_id"), F.col("type"), F.col("url_key")).alias("identity")).distinct()


def p3_theme_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(text.tags(F.col("text"), THEMES), ",").alias("themes"))


def p7_first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return tables.leads(spark, sf_dir).select("page_id", F.size(links).cast("long").alias("n_links"), F.try_element_at(links, F.lit(1)).alias("first_link"))


def p28_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "customer").join(
        F.broadcast(tables.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rows.select("c_custkey", F.concat_ws(" - ", "c_name", F.initcap("n_name"), F.initcap("c_mktsegment")).alias("summary"))


def f9_temporal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_format("o_orderdate", "yyyy-MM-dd")
    end = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 30), "yyyy-MM-dd"))
    status = dates.temporal_status(F.when(F.col("o_orderkey") % 7 > 0, start), end, F.lit("1998-10-03"))
    return tables.table(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def f12_stale_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat(F.lit("Summit "), F.year("o_orderdate") + 4, F.lit(" ("), F.year("o_orderdate") + 5, F.lit(")"))
    known = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 2000), "yyyy-MM-dd"))
    return tables.table(spark, sf_dir, "orders").select("o_orderkey", dates.stale_title_year(title, [known], 2003).alias("stale"))


def f2_range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    end = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 10), "yyyy-MM-dd")
    state = dates.range_overlap(start, end, F.lit("1997-01-01"), F.lit("1997-12-31"))
    return tables.table(spark, sf_dir, "orders").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def s18_page_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", urls.page_kind(F.col("url")).alias("kind"))


def f24_private_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("http://10.0.0."), F.col("page_id"), F.lit("/x"))).otherwise(F.col("url"))
    return tables.table(spark, sf_dir, "pages").select("page_id", urls.private_host(odd).alias("blocked"))


QUERIES = {f.__name__: f for f in (
    c1_normalize_text, c2_identity_url, c3_evidence_key, c4_provisional_key, c5_dedupe_key, c8_slug, c12_source_url, c13_fingerprint, c15_soft_key,
    c18_identity_hash, p3_theme_tags, p7_first_link, p28_summary, f9_temporal_status, f12_stale_year, f2_range_overlap,
    s18_page_kind, f24_private_host,
)}

ORACLES = {
    "c1_normalize_text": f"SELECT doc_id, {_NORM.format('text')} AS normalized FROM documents",
    "c2_identity_url": f"WITH {_PARTS} SELECT page_id, identity AS identity_url FROM ids",
    "c3_evidence_key": f"""
        WITH {_PARTS}
        SELECT page_id, scheme || '://' || host || CASE WHEN bare = '' THEN '/' ELSE bare END || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url_key
        FROM (SELECT *, regexp_replace(path, '/+$', '') AS bare,
                     list_transform(list_sort(list_transform(list_filter(params, lambda p: p <> '' AND NOT (starts_with(lower(p), 'utm_') OR lower(split_part(p, '=', 1)) IN ('fbclid','gclid','mc_cid','mc_eid','msclkid','ref','ref_src','s','si'))), lambda p: {{'k': split_part(p, '=', 1), 'v': substr(p, strpos(p, '=') + 1), 'p': p}})), lambda x: x.p) AS k
              FROM parts)
    """,
    "c4_provisional_key": "SELECT page_id, lower(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '')) AS url_key FROM pages",
    "c5_dedupe_key": f"WITH {_PARTS} SELECT page_id, scheme || '://' || host || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS dedupe_key FROM parts",
    "c8_slug": f"SELECT page_id, substring(regexp_replace(regexp_replace(lower({_TITLE}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug FROM pages",
    "c12_source_url": f"WITH {_PARTS} SELECT page_id, 'source-url:' || {_NORM.format('source')} || ':' || identity AS identity FROM ids",
    "c13_fingerprint": f"""
        WITH {_PARTS}
        SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'official:' || identity WHEN 1 THEN 'apply:' || identity WHEN 2 THEN 'social:' || identity
               WHEN 3 THEN 'source-id:page:' || page_id ELSE 'event:' || {_NORM.format('title')} || ':paris france:2026-07-16' END AS fingerprint
        FROM ids
    """,
    "c15_soft_key": f"""
        SELECT c_custkey, 'soft:' || {_NORM.format('c_name')} || ':' ||
               CASE WHEN c_custkey % 3 > 0 THEN 'city ' || c_nationkey WHEN c_custkey % 2 = 0 THEN 'online' END || ':2026' AS soft_key
        FROM customer
    """,
    "c18_identity_hash": """
        SELECT DISTINCT substring(sha256(l_orderkey || chr(0) || CASE l_returnflag WHEN 'A' THEN 'official_page' WHEN 'R' THEN 'apply_page' ELSE 'search_result' END
               || chr(0) || 'https://host' || (l_partkey % 3) || '.example.org/' || (l_suppkey % 5)), 1, 16) AS identity
        FROM lineitem
    """,
    "p3_theme_tags": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {word_sql('text', p)} THEN '{n}' END" for n, p in THEMES.items()) + "], lambda x: x IS NOT NULL), ',') AS themes FROM documents",
    "p7_first_link": """
        SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, l[1] AS first_link
        FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS l FROM pages)
    """,
    "p28_summary": """
        SELECT c_custkey, c_name || ' - ' || upper(n_name[1]) || lower(n_name[2:]) || ' - ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS summary
        FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
    "f9_temporal_status": """
        SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'UNKNOWN' WHEN e < DATE '1998-10-03' THEN 'FINISHED' WHEN CAST(o_orderdate AS DATE) > DATE '1998-10-03' THEN 'UPCOMING' ELSE 'ONGOING' END AS status,
               count(*) AS n
        FROM (SELECT *, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 30 DAY ELSE o_orderdate END AS DATE) AS e FROM orders) GROUP BY 1
    """,
    "f12_stale_year": """
        SELECT o_orderkey, year(o_orderdate) + 4 < 2003 AND NOT (o_orderkey % 3 = 0 AND year(o_orderdate + INTERVAL 2000 DAY) >= 2003) AS stale FROM orders
    """,
    "f2_range_overlap": """
        SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN o_orderdate <= DATE '1997-12-31' AND o_orderdate + INTERVAL 10 DAY >= DATE '1997-01-01' THEN 'inside' ELSE 'outside' END AS state, count(*) AS n
        FROM orders GROUP BY 1
    """,
    "s18_page_kind": f"""
        WITH {_PARTS}
        SELECT page_id, CASE WHEN regexp_replace(lower(path), '/+$', '') = '' THEN 'root'
               WHEN regexp_matches(lower(path), '(^|/)(tag|tags|category|calendar|explore|discover|search)(/|$)') THEN 'directory'
               WHEN regexp_matches(lower(path), '(^|/)(u|user|users|profile|people)/') THEN 'profile'
               WHEN regexp_matches(lower(path), '[.]html?$') THEN 'document' WHEN regexp_matches(path, '/[0-9]+/?$') THEN 'record' ELSE 'page' END AS kind
        FROM parts
    """,
    "f24_private_host": "SELECT page_id, page_id % 4 = 0 AS blocked FROM pages",
}
