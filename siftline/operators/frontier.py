"""A crawl over a table of links: breadth first, what is known left out, a budget per source, and why each source stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.storage import discard, materialize


def reached(seeds: DataFrame, links: DataFrame, most_depth: int = 10, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages (source, url, depth) reached from seeds (source, url) over links (from_url, to_url), and each source's stop.

    A round joins the links of the frontier only and keeps what no round before
    had; with a budget, a source's smallest new addresses fill what is left of it.
    A source stops for `exhausted` (no new pages), `budget` or `depth`.
    """
    links = links.select("from_url", "to_url").filter("from_url IS NOT NULL AND to_url IS NOT NULL").distinct()

    def within(new: DataFrame, known: DataFrame | None) -> DataFrame:
        if budget is None:
            return new
        used = known.groupBy("source").agg(F.count(F.lit(1)).alias("used")) if known is not None else None
        ranked = new.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("url")))
        ranked = ranked.join(used, "source", "left") if used is not None else ranked.withColumn("used", F.lit(0))
        return ranked.filter(F.col("n") + F.coalesce("used", F.lit(0)) <= budget).select("source", "url", "depth")

    start = seeds.select("source", "url").filter("url IS NOT NULL").distinct().withColumn("depth", F.lit(0))
    levels = [materialize(within(start, None), "frontier")]
    last = {}
    for depth in range(1, most_depth + 1):
        known = levels[0]
        for level in levels[1:]:
            known = known.unionByName(level)
        near = levels[-1].select("source", F.col("url").alias("from_url")).join(links, "from_url").select("source", F.col("to_url").alias("url")).distinct()
        new = near.join(known.select("source", "url"), ["source", "url"], "left_anti").withColumn("depth", F.lit(depth))
        level = materialize(within(new, known), "frontier")
        if level.isEmpty():
            discard(level)
            break
        levels.append(level)
    pages = levels[0]
    for level in levels[1:]:
        pages = pages.unionByName(level)
    last = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.max("depth").alias("depth"))
    # a source that still has new neighbours was cut by its budget or by the depth
    edge = pages.select("source", F.col("url").alias("from_url"), "depth").join(links, "from_url").select("source", F.col("to_url").alias("url"), "depth")
    left = edge.join(pages.select("source", "url"), ["source", "url"], "left_anti").select("source").distinct().withColumn("more", F.lit(True))
    full = F.col("pages") >= budget if budget is not None else F.lit(False)
    stop = F.when(F.col("more").isNull(), "exhausted").when(full, "budget").otherwise("depth")
    return pages, last.join(left, "source", "left").select("source", "pages", "depth", stop.alias("stop"))
