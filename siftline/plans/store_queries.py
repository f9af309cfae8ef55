"""Nested JSON, crawls over links, committed batches, and names in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import storage
from siftline.functions import nested
from siftline.operators import frontier, ledger, mentions
from siftline.sources import tables


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of an order nested as deep as the order's key modulo nine says, with secrets at every depth and inside lists."""
    o = tables.table(spark, sf_dir, "orders")
    key, deep = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 9).cast("int")
    inner = F.concat(F.lit('{"v": '), key, F.lit(', "note": "Bearer abc.'), key, F.lit('", "password": {"x": 1}, "list": [{"apiKey": "k", "b": 2, "a": "é\\"q"}, null, 1.5]}'))
    text = F.concat(F.repeat(F.lit('{"z": true, "client_secret": "s", "n": '), deep), inner, F.repeat(F.lit("}"), deep))
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, F.lit("{oops")).otherwise(text).alias("payload"))


def p9_redacted_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without what their secret keys hold; what is no JSON gives null."""
    return _payload(spark, sf_dir).select("o_orderkey", nested.redacted(F.col("payload")).alias("payload"))


def c19_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with sorted keys at every depth, by how many have the same."""
    o = tables.table(spark, sf_dir, "orders")
    one = F.format_string('{"b": {"y": %d, "x": [1, {"d": 1, "c": 2}]}, "a": null}', F.col("o_custkey"))
    two = F.format_string('{ "a":null,"b":{"x":[1,{"c":2,"d":1}],"y":%d} }', F.col("o_custkey"))
    return o.groupBy(nested.canonical(F.when(F.col("o_orderkey") % 2 == 0, one).otherwise(two)).alias("payload")).agg(F.count(F.lit(1)).alias("n"))


def c20_call_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each kind of event by their arguments."""
    e = tables.table(spark, sf_dir, "events")
    return e.groupBy(nested.call_key(F.col("event_type"), F.col("props")).alias("call")).agg(F.count(F.lit(1)).alias("calls"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link from each part of an order to the part of the order's next line."""
    l = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = l.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("to_url"))
    return l.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("from_url"), "to_url")


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").filter("p_partkey % 40 = 1").select((F.col("p_partkey") % 3).alias("source"), F.col("p_partkey").alias("url"))


def t8_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that links lead to from each source's seeds, by how many steps."""
    pages, _ = frontier.reached(_seeds(spark, sf_dir), _links(spark, sf_dir), 2)
    return pages


def t8_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parts each source's crawl came to, and why it stopped."""
    _, stops = frontier.reached(_seeds(spark, sf_dir), _links(spark, sf_dir), 40)
    return stops.select("source", "pages", "stop")


def k7_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders committed in two batches, the second sent twice; rows without a positive price or with an urgent priority are kept apart."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    book = ledger.Ledger(spark, storage.new_path(spark, "ledger"))
    checks = {"price": F.col("o_totalprice") >= 50000, "priority": F.col("o_orderpriority") != "1-URGENT"}
    for batch, part in (("even", "o_orderkey % 2 = 0"), ("odd", "o_orderkey % 2 = 1"), ("odd", "o_orderkey % 2 = 1")):
        book.append(o.filter(part), batch, checks)
    why = book.rows(rejected=True).select(F.array_join("__failed", ",").alias("failed"), "o_totalprice")
    good = book.rows().select(F.lit("").alias("failed"), "o_totalprice")
    return good.unionByName(why).groupBy("failed").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def k8_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of three batches: what each wrote and rejected, and what it came to."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    book = ledger.Ledger(spark, storage.new_path(spark, "ledger"))
    checks = {"open": F.col("o_orderstatus") != "P"}
    tallies = [book.append(o.filter(part), batch, checks) for batch, part in (("all", "true"), ("some", "o_orderstatus = 'F'"), ("none", "o_orderstatus = 'P'"))]
    dry = book.append(o, "dry", checks, dry=True)
    rows = [(t["batch"], t["written"], t["rejected"], t["status"]) for t in [*tallies, dry]]
    return spark.createDataFrame(rows, "batch string, written long, rejected long, status string")


def k1_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after an upsert of two thirds, then of all at another price, then the same batch again: the first date stays."""
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen"))
    book = ledger.Ledger(spark, storage.new_path(spark, "ledger"))
    again = o.withColumns({"price": F.col("price") + F.col("o_orderkey") % 2, "seen": F.lit("2030-01-01")})
    book.upsert(o.filter("o_orderkey % 3 <> 0"), "first", ["o_orderkey"], ["seen"])
    book.upsert(again, "second", ["o_orderkey"], ["seen"])
    book.upsert(o, "second", ["o_orderkey"], ["seen"])
    return book.state()


def k13_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync does with each approved record, by status of the sync."""
    c = tables.candidates(spark, sf_dir)
    out = ledger.synced(c.filter("status = 'APPROVED'"), c.filter("id % 4 = 0"), "id", F.col("score") >= 50)
    return out.groupBy("sync").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("id").cast("long")).alias("ids"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.slice(F.split(F.trim("text"), r"\s+"), 1, 3)
    return tables.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(words, " ").alias("name"))


def f38_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the names that they hold: names are the first three words of every benchmark passage."""
    return mentions.mentioned(tables.table(spark, sf_dir, "documents"), _names(spark, sf_dir), "doc_id", "text", "item_id", "name")


def f38_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of each document, longer ones first."""
    out = mentions.longest(f38_mentions(spark, sf_dir).select("doc_id", "name").distinct(), "doc_id")
    return out.select("doc_id", F.array_join("names", "|").alias("names"))


QUERIES = {f.__name__: f for f in (p9_redacted_json, c19_canonical_json, c20_call_keys, t8_frontier, t8_stops, k7_batches, k8_runs, k1_upserted, k13_synced, f38_mentions, f38_longest)}

_LINKS = """
    links AS (SELECT DISTINCT a.l_partkey AS from_url, b.l_partkey AS to_url FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
    seeds AS (SELECT p_partkey % 3 AS source, p_partkey AS url FROM part WHERE p_partkey % 40 = 1)
"""
_MENTIONS = """
    SELECT DISTINCT doc_id, item_id, name FROM documents
    JOIN (SELECT item_id, array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:3], ' ') AS name FROM benchmark) b
      ON length(name) >= 3 AND regexp_matches(text, '(?i)\\b' || regexp_escape(name) || '\\b')
"""

ORACLES = {
    "p9_redacted_json": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN repeat('{"n":', CAST(o_orderkey % 9 AS INT))
            || '{"list":[{"a":"é\\"q","b":2},null,1.5],"note":"[redacted]","v":' || o_orderkey || '}' || repeat(',"z":true}', CAST(o_orderkey % 9 AS INT)) END AS payload FROM orders
    """,
    "c19_canonical_json": """SELECT '{"a":null,"b":{"x":[1,{"c":2,"d":1}],"y":' || o_custkey || '}}' AS payload, count(*) AS n FROM orders GROUP BY o_custkey""",
    "c20_call_keys": "SELECT event_type || ':{\"k\":' || regexp_extract(props, '[0-9]+') || '}' AS call, count(*) AS calls FROM events GROUP BY 1",
    "t8_frontier": "WITH RECURSIVE" + _LINKS + """,
        r AS (SELECT source, url, 0 AS depth FROM seeds UNION SELECT r.source, to_url, depth + 1 FROM r JOIN links ON from_url = url WHERE depth < 2)
        SELECT source, url, min(depth)::INT AS depth FROM r GROUP BY source, url""",
    "t8_stops": "WITH RECURSIVE" + _LINKS + """,
        r AS (SELECT source, url FROM seeds UNION SELECT r.source, to_url FROM r JOIN links ON from_url = url)
        SELECT source, count(*) AS pages, 'exhausted' AS stop FROM r GROUP BY source""",
    "k7_batches": """
        SELECT concat_ws(',', CASE WHEN o_totalprice < 50000 THEN 'price' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'priority' END) AS failed, count(*) AS n, round(sum(o_totalprice), 2) AS total
        FROM orders GROUP BY 1
    """,
    "k8_runs": """
        WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders)
        SELECT 'all' AS batch, n - p AS written, p AS rejected, CASE WHEN p = 0 THEN 'COMPLETED' ELSE 'PARTIAL' END AS status FROM n UNION ALL SELECT 'some', f, 0, 'COMPLETED' FROM n
        UNION ALL SELECT 'none', 0, p, CASE WHEN p = 0 THEN 'COMPLETED' ELSE 'FAILED' END FROM n UNION ALL SELECT 'dry', n - p, p, CASE WHEN p = 0 THEN 'COMPLETED' ELSE 'PARTIAL' END FROM n
    """,
    "k1_upserted": """
        SELECT o_orderkey, floor(o_totalprice)::BIGINT + o_orderkey % 2 AS price, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '2030-01-01' END AS seen FROM orders
    """,
    "k13_synced": """
        SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'skipped' WHEN floor(o_totalprice)::BIGINT % 101 < 50 THEN 'failed' ELSE 'appended' END AS sync, count(*) AS n, sum(o_orderkey)::BIGINT AS ids
        FROM orders WHERE o_orderstatus = 'F' GROUP BY 1
    """,
    "f38_mentions": _MENTIONS,
    "f38_longest": f"SELECT doc_id, string_agg(name, '|' ORDER BY length(name) DESC, name) AS names FROM (SELECT DISTINCT doc_id, name FROM ({_MENTIONS})) GROUP BY doc_id",
}
