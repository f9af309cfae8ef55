"""Scans of the Parquet tables as leads, candidates, evidence and an event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which source a page stands for, by page number modulo eight.
SOURCES = ["mlh", "devpost", "luma", "hacklist", "hakku", "web", "x", "custom:board"]

TITLE = r"<title>([^<]*)</title>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.pmod(number, F.lit(len(SOURCES))) + 1).cast("int"))


def strip_tags(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces."""
    for pattern in ("<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<!--.*?-->"):
        html = F.regexp_replace(html, "(?s)" + pattern, " ")
    return F.regexp_replace(html, "<[^>]*>", " ")


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, source, url, title and html of every page; page_id is the arrival order."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", source_of(F.col("page_id")).alias("source"), "url", F.regexp_extract("html", TITLE, 1).alias("title"), "html")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviewed records: id, status, source, score, found_at, name."""
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").when(F.col("o_orderstatus") == "O", "READY_FOR_REVIEW").otherwise("NEEDS_REVIEW")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), status.alias("status"),
        F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "")).alias("source"),
        (F.floor("o_totalprice").cast("long") % 101).cast("int").alias("score"),
        F.col("o_orderdate").cast("date").alias("found_at"), F.concat(F.lit("record "), F.col("o_custkey")).alias("name"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as observations: candidate_id, type, url_key, seen_at, seen_count, ordinal."""
    kind = F.when(F.col("l_returnflag") == "A", "official_page").when(F.col("l_returnflag") == "R", "apply_page").otherwise("search_result")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("candidate_id"), kind.alias("type"),
        F.concat(F.lit("https://host"), F.col("l_partkey") % 3, F.lit(".example.org/"), F.col("l_suppkey") % 5).alias("url_key"),
        F.col("l_shipdate").cast("date").alias("seen_at"), F.col("l_quantity").cast("int").alias("seen_count"),
        F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as a job log: event_id, job_id, ts, level, kind, metadata."""
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("info")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("job_id"), "ts", level.alias("level"), F.col("event_type").alias("kind"), "value", F.col("props").alias("metadata")
    )


def scan_sources(factories: dict[str, Callable[[], DataFrame]], wanted: list[str] | None = None) -> tuple[DataFrame | None, dict[str, str]]:
    """The leads of all wanted sources in one frame, and what went wrong with those that could not be read.

    A factory makes a source's frame; one that raises (no such table, wrong schema)
    is left out and named, the others go on.  Sources come in the order asked for,
    each once; one that is not registered is an error of the caller.
    """
    names = list(dict.fromkeys(wanted if wanted is not None else factories))
    if unknown := [n for n in names if n not in factories]:
        raise ValueError(f"unknown sources {unknown}, registered are {sorted(factories)}")
    frames, failed = {}, {}
    for name in names:
        try:
            frames[name] = factories[name]()
        except Exception as e:  # noqa: BLE001 - whatever it is, it is this source's failure alone
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return union_sources(frames) if frames else None, failed


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """One frame of all sources' leads, each tagged; columns a source lacks are null."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("source", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
