"""Page scans: node tables, repeated units, embedded JSON, and rate-limited logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import dates, urls
from siftline.operators import sinks, views
from siftline.sources import html, tables
from siftline.streaming import log

from .scenario import expected, over_orders, tallied


def s26_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each page from the node table: how many, how many distinct targets."""
    found = html.nodes(tables.table(spark, sf_dir, "pages")).filter("tag = 'a' AND href IS NOT NULL")
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("href").alias("targets"))


def a20_list_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of repeated items by page, with the share of distinct texts among their anchors."""
    units = html.page_units(tables.table(spark, sf_dir, "pages")).filter("shape = 'li'")
    return units.groupBy("units").agg(F.count(F.lit(1)).alias("lists"))


def _dealt(orders: DataFrame) -> DataFrame:
    """Few narrow rows that each become a page are dealt over all cores before they do."""
    return orders.repartition(orders.sparkSession.sparkContext.defaultParallelism, "o_orderkey")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing page per order, 28 years on: a heading, two tiles, one of them over, and a table."""
    o = _dealt(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey"))
    tile = '<a class="tile %s" href="/o/%d?ref=x#y"><h2>Order  %d</h2><span class="prize">$%d</span><span class="status">%s</span></a>'
    page = (
        '<html><nav><a href="/">home</a></nav><section><h3 class="day">%s</h3>' + tile + "<p>note <b>bold</b> &amp; more</p>" + tile + "</section>"
        "<table><tr><th>Event name</th><th>When</th></tr><tr><td>T%d</td><td>%s</td></tr><tr><td>U</td><td></td></tr></table>"
        '<script type="application/ld+json">{"name": "L%d"}</script></html>'
    )
    key, day = F.col("o_orderkey"), F.date_format(F.add_months("o_orderdate", 336), "MMM d, yyyy")
    size = F.col("o_custkey")
    html_ = F.format_string(page, day, F.lit("big"), key, key, size, F.lit("open"), F.lit("small"), key, key, size, F.lit("ended"), key, day, key)
    return o.select(key.alias("page_id"), "o_orderdate", "o_custkey", html_.alias("html"))


def s9_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of listing pages: title, prize and address; what has ended is dropped, copies of an address go, the first stays."""
    found = html.cards(_tiles(spark, sf_dir), "a.tile", {"title": "h2,h3", "prize": ".prize", "status": ".status", "href": "a@href"})
    url = urls.resolve(F.col("href"), F.lit("https://list.example/"))
    live = found.filter("status <> 'ended'").withColumn("url", F.regexp_replace(url, r"\?.*$", ""))
    return live.groupBy("page_id", "url").agg(F.min_by(F.struct("title", "prize"), "position").alias("x")).select("page_id", "url", "x.title", "x.prize")


def s15_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards under the date of the heading above them."""
    found = html.cards(_tiles(spark, sf_dir), "h3.day, a.tile", {"day": "h3.day", "title": "h2"})
    filled = views.forward_fill(found, "day", "page_id", "position").filter("title IS NOT NULL")
    return filled.select("page_id", "position", dates.heading_day(F.col("day"), F.lit("2026-07-16")).alias("day"))


def s26_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables as records, columns told by their headers' aliases; rows without a name are no records."""
    rows = html.table_rows(_tiles(spark, sf_dir))
    name, when = (html.column_of(F.col("header"), a) for a in (["name", "title"], ["when", "date"]))
    cell = lambda at: F.nullif(F.try_element_at("cells", at + 1), F.lit(""))
    return rows.select("page_id", "row_no", cell(name).alias("name"), dates.day_of(cell(when)).alias("day"))


#: header, column asked for, aliases: place
HEADERS = [("Event name|When", None, 0), ("When|Title of it", None, 1), ("a|b", None, -1), ("Name|Title", "title", 1), ("Name|Title", "other", 0)]


def s27_header_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(h, n) for h, n, _ in HEADERS], "header string, named string")
    header = F.split("header", "[|]")
    parts = [tallied(df.filter(F.col("named").eqNullSafe(F.lit(n))), place=html.column_of(header, ["name", "title"], n)) for n in (None, "title", "other")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def s33_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of pages' JSON-LD."""
    scripts = _tiles(spark, sf_dir).select("page_id", F.explode(html.json_scripts(F.col("html"))).alias("j"))
    return html.walk_json(scripts, "page_id", "j").select("page_id", "path", "value")


def x17_deep_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of pages with elements nested as deep as the order key's last two digits: their number, depth and innermost text."""
    o = _dealt(tables.table(spark, sf_dir, "orders").select("o_orderkey"))
    depth = (F.col("o_orderkey") % 100).cast("int")
    page = F.concat(F.repeat(F.lit("<div>"), depth), F.lit("<b>in</b>"), F.repeat(F.lit("</div>"), depth), F.lit("<p>after</p>"))
    found = html.nodes(o.select(F.col("o_orderkey").alias("page_id"), page.alias("html")))
    out = found.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("depth").cast("long").alias("depth"), F.max(F.when(F.col("text") == "in", F.col("depth"))).cast("long").alias("at"), F.max(F.when(F.col("tag") == "p", F.col("parent_id"))).cast("long").alias("p_parent"))
    return out


def a20_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest repeated units of each page."""
    units = html.page_units(_tiles(spark, sf_dir))
    return units.groupBy("page_id").agg(F.max_by("shape", F.struct("confidence", "shape")).alias("shape"), F.max("confidence").alias("confidence"))


def j14_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by the shapes of their children."""
    found = html.children(_tiles(spark, sf_dir)).filter("tag = 'section'")
    return found.groupBy("child_shapes").agg(F.count(F.lit(1)).alias("n"), F.max("child_count").alias("children"))


def s14_json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of the log's JSON by path."""
    walked = html.walk_json(tables.table(spark, sf_dir, "events"), "event_id", "props")
    return walked.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


def s7_api_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of JSON answers made of orders, exploded, with the answer's total."""
    o = tables.table(spark, sf_dir, "orders")
    payload = F.format_string('{"items": [{"id": %d, "ended": false}, {"id": %d, "ended": true}], "meta": {"total_count": 2}}', "o_orderkey", "o_custkey")
    page = html.api_page(F.when(F.col("o_orderkey") % 10 == 0, F.lit("oops")).otherwise(payload), "id:long,ended:boolean")
    out = o.select("o_orderkey", page.alias("p")).select("o_orderkey", F.col("p.meta.total_count").alias("total"), F.explode("p.items").alias("i"))
    return out.filter("NOT i.ended").select("o_orderkey", F.col("i.id").alias("item_id"), "total")


def k11_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved records that a sheet of every third record lacks."""
    c = tables.candidates(spark, sf_dir)
    return sinks.sheet_rows(sinks.pending(c, sinks.sheet_rows(c.filter("id % 3 = 0"))))


def t13_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a limiter of two a day and job lets through."""
    return log.limited(tables.event_log(spark, sf_dir), 86_400, 2)


QUERIES = {f.__name__: f for f in (s9_tiles, s15_timeline, s26_table_rows, s27_header_alias, s33_json_ld, x17_deep_nodes, a20_units, j14_children, s26_links, a20_list_units, s14_json_walk, s7_api_page, k11_pending, t13_rate_limit)}

ORACLES = {
    "s9_tiles": "SELECT o_orderkey AS page_id, 'https://list.example/o/' || o_orderkey AS url, 'Order ' || o_orderkey AS title, '$' || o_custkey AS prize FROM orders",
    "s15_timeline": "SELECT o_orderkey AS page_id, p AS position, strftime(o_orderdate + INTERVAL 28 YEAR, '%Y-%m-%d') AS day FROM orders, (VALUES (1), (2)) v(p)",
    "s26_table_rows": "SELECT o_orderkey AS page_id, r AS row_no, CASE WHEN r = 0 THEN 'T' || o_orderkey ELSE 'U' END AS name, CASE WHEN r = 0 THEN strftime(o_orderdate + INTERVAL 28 YEAR, '%Y-%m-%d') END AS day FROM orders, (VALUES (0), (1)) v(r)",
    "s27_header_alias": expected(["place"], [(h[2],) for h in HEADERS]),
    "s33_json_ld": "SELECT o_orderkey AS page_id, '$.name' AS path, 'L' || o_orderkey AS value FROM orders",
    "x17_deep_nodes": "SELECT o_orderkey AS page_id, o_orderkey % 100 + 2 AS nodes, o_orderkey % 100 AS depth, o_orderkey % 100 AS at, CAST(-1 AS BIGINT) AS p_parent FROM orders",
    "a20_units": "SELECT o_orderkey AS page_id, 'th' AS shape, CAST(0.35 AS DOUBLE) AS confidence FROM orders",
    "j14_children": "SELECT 'h3.day a.big.tile p a.small.tile' AS child_shapes, count(*) AS n, CAST(4 AS BIGINT) AS children FROM orders",
    "s26_links": """
        SELECT page_id, count(*) AS links, count(DISTINCT href) AS targets
        FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id
    """,
    "a20_list_units": """
        SELECT units, count(*) AS lists FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS units FROM pages) WHERE units >= 2 GROUP BY units
    """,
    "s14_json_walk": "SELECT '$.k' AS path, count(*) AS n, CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS total FROM events",
    "s7_api_page": "SELECT o_orderkey, o_orderkey AS item_id, CAST(2 AS BIGINT) AS total FROM orders WHERE o_orderkey % 10 <> 0",
    "k11_pending": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, 'record ' || o_custkey AS name, 'APPROVED' AS status, lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS source,
               CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS VARCHAR) AS score, strftime(o_orderdate, '%Y-%m-%d') AS found_at
        FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0
    """,
    "t13_rate_limit": """
        WITH RECURSIVE s AS (SELECT user_id AS job_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (
            SELECT job_id, n, event_id, ts + INTERVAL 1 DAY AS until, 1 AS count, true AS ok FROM s WHERE n = 1
            UNION ALL
            SELECT s.job_id, s.n, s.event_id, CASE WHEN s.ts >= until THEN s.ts + INTERVAL 1 DAY ELSE until END,
                   CASE WHEN s.ts >= until THEN 1 ELSE least(count + 1, 2) END, s.ts >= until OR count < 2
            FROM r JOIN s ON s.job_id = r.job_id AND s.n = r.n + 1
        )
        SELECT job_id, event_id FROM r WHERE ok
    """,
}
