"""Listings read from the structure of pages that are made of orders, and fingerprints of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import storage
from siftline.operators import layout
from siftline.sources import html, structure, tables

BASE = "https://list.example/all"


def _join(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x["card"]), "")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per customer: its orders of even keys as cards of one list, those of odd keys as cards of another class in a second, and a menu.

    A card without a day has none of its markup; every third has its parts in another order.
    """
    o = tables.table(spark, sf_dir, "orders")
    key, day = F.col("o_orderkey").cast("string"), F.date_format(F.add_months("o_orderdate", 336), "yyyy-MM-dd")
    title, link = F.concat(F.lit("<h3>Order "), key, F.lit(" Hackathon</h3>")), F.concat(F.lit('<a href="/o/'), key, F.lit('">go</a>'))
    when = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.lit('<span class="when">'), day, F.lit("</span>")))
    place = F.lit('<p class="where">Oslo, Norway</p>')
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(place, when, link, title)).otherwise(F.concat(title, link, when, place))
    hot = F.when(F.col("o_orderkey") % 2 == 1, " hot").otherwise("")
    card = F.concat(F.lit('<li class="card'), hot, F.lit(" k"), (F.col("o_orderkey") % 1000).cast("string"), F.lit('">'), body, F.lit("</li>"))
    cards = F.array_sort(F.collect_list(F.struct("o_orderkey", card.alias("card"))))
    even, odd = F.filter("cards", lambda x: x["o_orderkey"] % 2 == 0), F.filter("cards", lambda x: x["o_orderkey"] % 2 == 1)
    page = F.concat(F.lit('<html><body><h1>All</h1><ul class="list">'), _join(even), F.lit('</ul><ul class="more">'), _join(odd), F.lit('</ul><nav><a href="/x">home</a><a href="/y">about</a></nav></body></html>'))
    return o.groupBy(F.col("o_custkey").alias("page_id")).agg(cards.alias("cards")).select("page_id", page.alias("html"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings' units; several steps read them, and pages are parsed once."""
    return storage.materialize(structure.units(_listing(spark, sf_dir)), "units")


def x18_unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as rows whose columns come from the paths that they share."""
    found = layout.unit_table(_units(spark, sf_dir), 0.5).filter("shape LIKE 'li.%'")
    field = lambda path: F.try_element_at("fields", F.lit(path))
    return found.select("page_id", "shape", "unit", field("h3").alias("title"), field("span.when").alias("day"), field("p.where").alias("place"))


def x18_unit_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as leads, without a word about which part is which."""
    leads = layout.unit_leads(_units(spark, sf_dir), F.lit(BASE))
    return leads.select("page_id", "tag", "title", "url", "start_day", "place", "status")


def x18_set_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit sets by how complete their leads are and why they are no listing."""
    units = _units(spark, sf_dir)
    judged = layout.judged_sets(units, layout.unit_leads(units, F.lit(BASE)))
    return judged.select("page_id", "shape", "units", "titled", "identified", F.array_join("reasons", "; ").alias("reasons"), "confidence")


def j13_kindred_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of one page whose cards are alike in classes and parts, taken together."""
    units = _units(spark, sf_dir)
    grouped = layout.kindred_sets(layout.unit_sets(units), units)
    return grouped.filter("shape LIKE 'li.%'").groupBy("page_id", "group_parent", "group_shape").agg(F.count(F.lit(1)).alias("sets"), F.sum("units").alias("units")).drop("group_parent")


def c23_page_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The short fingerprint of every page, and the signature of its list of links."""
    pages = tables.table(spark, sf_dir, "pages")
    links = F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0)))
    signature = structure.shape_signature(F.lit("dom"), F.when(links > 0, "li"), links, F.array(F.col("url")))
    return pages.select("page_id", structure.page_fingerprint(F.col("html")).alias("fingerprint"), signature.alias("signature"))


def c23_tree_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of pages that differ in the length of their list, and of some whose menu has moved: how many kinds there are."""
    o = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    list_, menu = F.concat(F.lit("<ul>"), F.repeat(F.lit('<li class="r1"><b>x</b></li>'), F.col("n")), F.lit("</ul>")), F.lit('<nav><a href="/">home</a></nav>')
    moved = F.col("page_id") % 3 == 0
    pages = o.select("page_id", F.concat(F.lit("<body>"), F.when(moved, F.concat(menu, list_)).otherwise(F.concat(list_, menu)), F.lit("</body>")).alias("html"))
    return structure.fingerprints(pages).groupBy((F.col("page_id") % 3 == 0).alias("moved")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("fingerprint").alias("kinds"), F.sum(F.col("nodes").cast("long")).alias("nodes"))


def s10_schedule_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of schedule pages made of orders, by what the labels of their segments say."""
    day = lambda n: F.date_format(F.date_add(F.add_months("o_orderdate", 336).cast("date"), n), "MMM d, yyyy")
    lines = [
        ("Hackathon begins: ", day(0), " and ends ", day(2)), ("Registration opens ", day(-30), " at 9:00 am EST and closes ", day(-5)),
        ("Judging ", day(3), " - ", day(5)), ("Event starts ", day(50), "", F.lit("")), ("Winners announced ", day(9), "", F.lit("")),
    ]
    text = F.concat(F.lit("<ol>"), *[F.concat(F.lit(f"<li><b>{a}</b>"), x, F.lit(b), y, F.lit("</li>")) for a, x, b, y in lines], F.lit("</ol>"))
    o = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    pages = o.select(F.col("o_orderkey").alias("page_id"), text.alias("html"))
    segments = html.cards(pages, layout.SEGMENTS, {"text": layout.SEGMENTS})
    return layout.schedule_days(segments, 2026).select("page_id", "kind", "day")


def j18_labelled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase of the log under the view nearest before it of the same user, if that is not too far."""
    e = tables.table(spark, sf_dir, "events")
    label = F.when(F.col("event_type") == "view", F.concat(F.lit("view "), F.col("event_id").cast("string")))
    date = F.when(F.col("event_type") == "purchase", F.date_format("ts", "yyyy-MM-dd"))
    return layout.labelled_dates(e.select("user_id", "event_id", label.alias("label"), date.alias("day")), "user_id", "event_id", "label", "day", 2000)


QUERIES = {f.__name__: f for f in (x18_unit_table, x18_unit_leads, x18_set_metrics, j13_kindred_sets, c23_page_fingerprint, c23_tree_fingerprints, s10_schedule_days, j18_labelled_dates)}

_CARDS = """
    WITH c AS (SELECT o_custkey AS page_id, o_orderkey, o_orderkey % 2 AS odd, CASE WHEN o_orderkey % 2 = 1 THEN 'li.card.hot.kn' ELSE 'li.card.kn' END AS shape,
                      CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate + INTERVAL 28 YEAR, '%Y-%m-%d') END AS day,
                      count(*) OVER w AS units, avg(CASE WHEN o_orderkey % 5 <> 0 THEN 1.0 ELSE 0 END) OVER w AS dated, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS unit
               FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderkey % 2))
"""

ORACLES = {
    "x18_unit_table": _CARDS + "SELECT page_id, shape, unit::INT AS unit, 'Order ' || o_orderkey || ' Hackathon' AS title, CASE WHEN dated >= 0.5 THEN day END AS day, 'Oslo, Norway' AS place FROM c WHERE units >= 2",
    "x18_unit_leads": _CARDS + """SELECT page_id, 'li' AS tag, 'Order ' || o_orderkey || ' Hackathon' AS title, 'https://list.example/o/' || o_orderkey AS url, day AS start_day, 'Oslo, Norway' AS place, 'unknown' AS status
        FROM c WHERE units >= 2""",
    "x18_set_metrics": _CARDS + """SELECT DISTINCT page_id, shape, units, 1.0::DOUBLE AS titled, 1.0::DOUBLE AS identified, '' AS reasons, round(0.75 + 0.25 * least(units / 10, 1.0) + 1e-9, 3)::DOUBLE AS confidence FROM c WHERE units >= 2
        UNION ALL SELECT DISTINCT page_id, 'a', 2, 0.0, 0.0, 'low title completeness; low identity completeness; too few valid DOM records', 0.8 FROM c""",
    "j13_kindred_sets": _CARDS + "SELECT page_id, arg_min(shape, odd) AS group_shape, count(*) AS sets, sum(units)::BIGINT AS units FROM (SELECT DISTINCT page_id, shape, odd, units FROM c WHERE units >= 2) GROUP BY page_id",
    "c23_page_fingerprint": """
        SELECT page_id, left(sha256(left(regexp_replace(html, '\\s+', ' ', 'g'), 12000)), 16) AS fingerprint,
               left(sha256('dom|' || CASE WHEN n > 0 THEN 'li' ELSE '?' END || '|' || n || '|' || coalesce(url, '')), 24) AS signature
        FROM (SELECT page_id, url, html, len(regexp_extract_all(html, '<li>')) AS n FROM pages)
    """,
    "c23_tree_fingerprints": """
        SELECT page_id % 3 = 0 AS moved, count(*) AS pages, CAST(1 AS BIGINT) AS kinds, CAST(sum(4 + 2 * n) AS BIGINT) AS nodes
        FROM (SELECT o_custkey AS page_id, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY 1
    """,
    "s10_schedule_days": """
        SELECT o_orderkey AS page_id, kind, strftime(CAST(o_orderdate + INTERVAL 28 YEAR AS DATE) + n, '%Y-%m-%d') AS day
        FROM orders, (VALUES ('event_start', 0), ('event_end', 2), ('registration_open', -30), ('registration_deadline', -5), ('judging_start', 3), ('judging_end', 5), ('result_announcement', 9)) v(kind, n)
    """,
    "j18_labelled_dates": """
        SELECT p.user_id, p.event_id, strftime(p.ts, '%Y-%m-%d') AS day, 'view ' || v.event_id AS label, p.event_id - v.event_id AS distance
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.event_id >= v.event_id
        WHERE p.event_id - v.event_id <= 2000
    """,
}
