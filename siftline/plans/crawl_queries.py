"""Crawls over the driver's tables: sources, scan results, growth, budgets, coverage, paging, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import crawl, resolve
from siftline.sources import html, tables

from .record_queries import _CAND, _EVID
from .scenario import expected, over_orders, tallied

#: The health of the test corpus's sources.
HEALTH = [("mlh", True, "healthy", None), ("devpost", True, "degraded", "slow"), ("luma", False, None, None), ("hakku", True, "auth_required", None), ("web", True, "unconfigured", "no key")]


def s4_select_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the pages' sources may run, and why the others may not."""
    asked = tables.leads(spark, sf_dir).select(F.col("page_id").alias("ordinal"), "source")
    return crawl.select_sources(asked, spark.createDataFrame(HEALTH, "source string, enabled boolean, health string, reason string"))


def s6_reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner's order against the sources that may run: every source of the pages is one, the planner names some."""
    mine = tables.leads(spark, sf_dir).select(F.col("page_id").alias("ordinal"), "source")
    planned = spark.createDataFrame([(0, "devpost", False), (1, "luma", True), (2, "mlh", False), (3, "nowhere", True)], "ordinal long, source string, wanted boolean")
    return crawl.reconcile_plan(mine, planned, spark.createDataFrame([("devpost", "degraded"), ("hakku", "auth_required")], "source string, health string"))


#: (status, discovered, leads, errors, warnings), then status, discovered, dropped, warnings
SCANS = [
    (("completed", 5, 3, [], []), ("completed", 5, 2, 0)), (("completed", 1, 3, [], ["slow"]), ("degraded", 3, 0, 1)), ((None, None, 4, ["boom"], []), ("failed", 4, 0, 0)),
    (("completed", 7, 0, [], []), ("degraded", 7, 7, 1)), (("capped", 7, 7, ["boom"], []), ("capped", 7, 0, 0)), ((None, 0, 0, ["please sign in"], []), ("auth_required", 0, 0, 0)),
]


def a2_normalized_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [s for s, _ in SCANS], "status string, discovered int, leads int, errors array<string>, warnings array<string>")
    out = crawl.normalized_scan(df.withColumn("source", F.col("case_no").cast("string"))).withColumn("case_no", F.col("source").cast("int"))
    return tallied(out, status=F.col("status"), discovered=F.col("discovered"), dropped=F.col("dropped"), warnings=F.size("warnings"))


UNITS = [((10, 3), (7, True)), ((10, 4), (6, False)), ((4, 0), (4, False)), ((0, 0), (0, False)), ((5, 9), (0, False))]


def s28_under_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [u for u, _ in UNITS], "units int, leads int")
    out = crawl.under_extracted(F.col("units"), F.col("leads"))
    return tallied(df, rejected=out["rejected"], under=out["under"])


#: (source, total it states, unique records, how it stopped), then value, method, confidence
STOCK = [
    (("devpost", 13601, 500, "maximum_cards_reached"), (13601, "api_total", "strong")), (("devpost", None, 70, "no_next_page"), (70, "api_total", "strong")), (("luma", None, 44, "no_growth"), (44, "scroll_plateau", "strong")),
    (("luma", None, 44, "no_growth after timeout"), (44, "unknown", "weak")), (("web", None, 9, "maximum_scrolls"), (9, "pagination_derived", "weak")), (("web", None, 0, None), (None, None, None)),
]


def a7_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [s for s, _ in STOCK], "source string, total int, found int, stop string")
    out = crawl.inventory(F.col("source"), F.col("total"), F.col("found"), F.col("stop"))
    return tallied(df, value=out["value"].cast("string"), method=out["method"], confidence=out["confidence"])


def a3_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counters per source."""
    status = F.when(F.col("status") == "READY_FOR_REVIEW", "NEW").when(F.col("status") == "APPROVED", "REJECTED").otherwise(F.col("status"))
    return crawl.outcome_counts(tables.candidates(spark, sf_dir).withColumn("status", status))


def a5_sources_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources are above and which below a thousand on average, as lists."""
    c = tables.candidates(spark, sf_dir).groupBy("source").agg(F.avg("score").alias("m"))
    return crawl.sources_by_outcome(c.withColumn("outcome", F.when(F.col("m") >= 50, "executed").otherwise("degraded")))


def t7_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New parts and repeats by day of shipping."""
    ev = tables.table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("step"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), F.col("l_partkey").cast("string").alias("part"))
    return crawl.accumulated(ev, "step", "at", "part")


def t9_stable_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a crawl of customers by nation would stop, a nation being a scroll."""
    c = tables.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("step"), (F.col("c_custkey") % 40).alias("identity"))
    return crawl.stable_stop(resolve.growth(c, "step", "identity"), most_items=1000, most_steps=20, dry_limit=3)


#: (unique, target, most, stop at target), then the cap, and its state
CAPS = [((10, 10, 50, True), ("target_reached", "healthy_bounded")), ((10, 10, 10, False), ("maximum_cards_reached", "healthy_bounded")), ((9, 10, 50, True), (None, "degraded")), ((60, None, 50, True), ("maximum_cards_reached", "healthy_bounded"))]


def t10_cap_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [c for c, _ in CAPS], "found int, target int, most int, at_target boolean")
    cap = crawl.cap_stop(F.col("found"), F.col("target"), F.col("most"), F.col("at_target"))
    return tallied(df, cap=cap, state=crawl.stop_state(cap))


STATES = [("exhausted", "healthy_complete"), ("no_growth", "healthy_complete"), ("max_budget", "healthy_bounded"), ("timeout", "usable_partial"), ("cancelled", "usable_partial"), ("blocked_authentication", "blocked_authentication"), ("acquisition_failed", "acquisition_failed"), ("odd", "degraded")]


def t10_stop_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(r,) for r, _ in STATES], "reason string")
    return tallied(df, state=crawl.stop_state(F.col("reason")))


def t11_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order leaves of a budget of lines and quantity."""
    used = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))
    left = crawl.budget_left({"lines": 5, "quantity": 100}, {"lines": F.col("lines"), "quantity": F.col("quantity")})
    return used.select("l_orderkey", left.alias("x")).groupBy("x.lines", "x.exhausted").agg(F.count(F.lit(1)).alias("n"))


#: (elapsed, pages, repeated, streak, more pages, accepted, horizon, growth), then the reason
GOES_ON = [
    ((99, 1, False, 0, True, 0, False, 5), "timeout"), ((1, 9, False, 0, True, 0, False, 5), "page_cap"), ((1, 1, True, 3, True, 0, False, 5), "repeated_fingerprint"),
    ((1, 1, False, 3, True, 0, False, 5), "expired_or_irrelevant_streak"), ((1, 1, False, 0, False, 9, True, 5), "source_exhausted"), ((1, 1, False, 0, True, 9, True, 5), "target_and_horizon_satisfied"),
    ((1, 1, False, 0, True, 9, False, 0), "no_stable_identity_growth"), ((1, 0, False, 0, True, 0, False, 0), "continue"), ((1, 1, False, 2, True, 1, True, 1), "continue"),
]


def t12_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [g for g, _ in GOES_ON], "elapsed int, pages int, repeated boolean, streak int, more boolean, accepted int, horizon boolean, growth int")
    c = F.col
    why = crawl.continuation(c("elapsed"), 60, c("pages"), 9, c("repeated"), c("streak"), c("more"), c("accepted"), 5, c("horizon"), c("growth"))
    return tallied(df, why=why)


def a22_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order priority: first and last day, orders within 1996, whether that is covered, share still open."""
    o = tables.table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    leads = o.select(
        "o_orderpriority", F.when(F.col("o_orderkey") % 10 > 0, day).alias("start_date"), F.lit(None).cast("string").alias("end_date"), day.alias("deadline"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("past").alias("status"),
    )
    return crawl.date_coverage(leads, "o_orderpriority", "1996-01-01", "1996-12-31")


def a24_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of an order's quantity by return flag: the first flag's largest, never below the number of lines."""
    li = tables.table(spark, sf_dir, "lineitem")
    priority = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    lines = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("seen"))
    est = li.join(lines, "l_orderkey").select("l_orderkey", F.col("l_returnflag").alias("method"), priority.alias("priority"), F.when(F.col("l_quantity") > 2, F.col("l_quantity").cast("long")).alias("value"), "seen")
    return crawl.available_count(est, "l_orderkey", "seen")


def x16_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How JSON answers made of orders are paged."""
    o = tables.table(spark, sf_dir, "orders")
    shapes = ['{"items": [], "page": 1}', '{"items": [], "nextCursor": "x", "page": 2}', '{"data": {"has_more": true}}', '{"offset": 3, "rows": []}', '{"rows": [1]}']
    payload = F.element_at(F.array(*[F.lit(s) for s in shapes]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    walked = html.walk_json(o.select("o_orderkey", payload.alias("j")), "o_orderkey", "j")
    return crawl.pagination(walked, "o_orderkey").groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def a28_sync_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in ("appended", "already_synced", "recovered_existing_row", "skipped_not_approved", "odd", "failed")]), (F.col("id") % 6 + 1).cast("int"))
    return crawl.sync_tally(tables.candidates(spark, sf_dir).select(status.alias("status")))


def a29_area_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which areas of two final states differ: quantities are made to, others are not."""
    ev = tables.evidence(spark, sf_dir)
    areas = F.when(F.col("seen_count") > 49, "evidence").when(F.col("seen_count") < 0, "candidate")
    return crawl.area_parity(ev.select(areas.alias("area")).filter("area IS NOT NULL"), ["candidate", "status", "evidence", "action"])


def a26_stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.floor("value").alias("ms"))
    return crawl.stage_timing(spans)


QUERIES = {f.__name__: f for f in (
    s4_select_sources, s6_reconcile_plan, a2_normalized_scans, s28_under_extracted, a7_inventory, a3_outcomes, a5_sources_by_outcome, t7_accumulation, t9_stable_stop, t10_cap_stop, t10_stop_states, t11_budget,
    t12_continuation, a22_horizon, a24_available, x16_pagination, a28_sync_tally, a29_area_parity, a26_stage_timing,
)}

_SRC = "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(tables.SOURCES)) + " END"
ORACLES = {
    "s4_select_sources": f"""
        WITH f AS (SELECT {_SRC} AS source, min(page_id) AS ordinal FROM pages GROUP BY 1),
             v(source, reason, warning) AS (VALUES ('devpost', CAST(NULL AS VARCHAR), 'devpost is degraded: slow'), ('luma', 'luma is disabled', 'Skipped luma: luma is disabled'),
                  ('hakku', 'hakku requires authentication', 'Skipped hakku: hakku requires authentication'), ('web', 'no key', 'Skipped web: no key'), ('x', 'X is not included by default', 'Skipped x: X is not included by default'))
        SELECT ordinal, source, reason IS NULL AS runs, reason, warning FROM f LEFT JOIN v USING (source)
    """,
    "s6_reconcile_plan": f"""
        WITH f AS (SELECT {_SRC} AS source, min(page_id) AS own FROM pages GROUP BY 1),
             v(source, place, state, warning) AS (VALUES ('devpost', 0, 'skip_degraded', CAST(NULL AS VARCHAR)), ('luma', 1, 'execute', NULL), ('mlh', 2, 'execute', 'planner skip overruled'), ('hakku', NULL, 'skip_auth_required', NULL))
        SELECT source, place IS NULL AS left_out, coalesce(place, own) AS place, coalesce(state, 'execute') AS state,
               CASE WHEN state IS NULL THEN 'planner left it out' ELSE warning END AS warning
        FROM f LEFT JOIN v USING (source)
    """,
    "a2_normalized_scans": expected(["status", "discovered", "dropped", "warnings"], [s[1] for s in SCANS]),
    "s28_under_extracted": expected(["rejected", "under"], [u[1] for u in UNITS]),
    "a7_inventory": expected(["value", "method", "confidence"], [(None if s[1][0] is None else str(s[1][0]), *s[1][1:]) for s in STOCK]),
    "a3_outcomes": f"""
        WITH {_CAND} SELECT source, count(*) FILTER (status <> 'APPROVED') AS queued, count(*) FILTER (status = 'READY_FOR_REVIEW') AS ready,
               count(*) FILTER (status = 'NEEDS_REVIEW') AS review, count(*) FILTER (status = 'APPROVED') AS rejected FROM cand GROUP BY source
    """,
    "a5_sources_by_outcome": f"""
        WITH {_CAND}, m AS (SELECT source, CASE WHEN avg(score) >= 50 THEN 'executed' ELSE 'degraded' END AS outcome FROM cand GROUP BY 1)
        SELECT outcome, string_agg(source, ',' ORDER BY source) AS sources FROM m GROUP BY 1
    """,
    "t7_accumulation": """
        WITH e AS (SELECT CAST(l_shipdate AS DATE) AS step, row_number() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE), l_orderkey * 8 + l_linenumber) AS k FROM lineitem)
        SELECT step, count(*) FILTER (k = 1) AS added, count(*) FILTER (k > 1) AS duplicates, round(count(*) FILTER (k > 1) / count(*), 4) AS duplicate_rate FROM e GROUP BY step
    """,
    "t9_stable_stop": """
        WITH f AS (SELECT c_custkey % 40 AS i, min(c_nationkey) AS s FROM customer GROUP BY 1),
             g AS (SELECT step, coalesce(new, 0) AS new FROM (SELECT DISTINCT c_nationkey AS step FROM customer) LEFT JOIN (SELECT s AS step, count(*) AS new FROM f GROUP BY 1) USING (step)),
             h AS (SELECT *, sum(new) OVER (ORDER BY step) AS total, sum(CASE WHEN new > 0 THEN 1 ELSE 0 END) OVER (ORDER BY step) AS island FROM g),
             k AS (SELECT *, sum(CASE WHEN new = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY step) AS dry FROM h),
             e AS (SELECT *, CASE WHEN total >= 1000 THEN 'max_items' WHEN step > 0 AND dry >= 3 THEN 'no_growth' WHEN step >= 20 THEN 'max_scrolls' END AS reason FROM k)
        SELECT CAST(min(step) AS BIGINT) AS step, arg_min(reason, step) AS reason FROM e WHERE reason IS NOT NULL
    """,
    "t10_cap_stop": expected(["cap", "state"], [c[1] for c in CAPS]),
    "t10_stop_states": expected(["state"], [(s[1],) for s in STATES]),
    "t11_budget": """
        SELECT CAST(greatest(0, 5 - lines) AS BIGINT) AS lines, lines >= 5 OR quantity >= 100 AS exhausted, count(*) AS n
        FROM (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1) GROUP BY 1, 2
    """,
    "t12_continuation": expected(["why"], [(g[1],) for g in GOES_ON]),
    "a22_horizon": """
        WITH d AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
        SELECT o_orderpriority, min(day) FILTER (o_orderkey % 10 > 0) AS first_day, max(day) FILTER (o_orderkey % 10 > 0) AS last_day, count(*) FILTER (day BETWEEN '1996-01-01' AND '1996-12-31') AS in_horizon,
               count(*) AS n, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 3) AS open_rate,
               min(day) FILTER (o_orderkey % 10 > 0) <= '1996-01-01' AND max(day) FILTER (o_orderkey % 10 > 0) >= '1996-12-31' AS covered
        FROM d GROUP BY 1
    """,
    "a24_available": """
        WITH n AS (SELECT l_orderkey, count(*) AS seen FROM lineitem GROUP BY 1),
             e AS (SELECT l_orderkey, l_returnflag AS method, CAST(l_quantity AS BIGINT) AS value, seen, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS p FROM lineitem JOIN n USING (l_orderkey) WHERE l_quantity > 2)
        SELECT l_orderkey, arg_min(method, {'p': p, 'v': -value}) AS method, greatest(arg_min(value, {'p': p, 'v': -value}), max(seen)) AS value, arg_min(value, {'p': p, 'v': -value}) < max(seen) AS raised FROM e GROUP BY 1
    """,
    "x16_pagination": "SELECT CASE o_orderkey % 5 WHEN 0 THEN 'page_number' WHEN 1 THEN 'cursor' WHEN 2 THEN 'next_link' WHEN 3 THEN 'offset' ELSE 'none' END AS method, count(*) AS n FROM orders GROUP BY 1",
    "a28_sync_tally": f"WITH {_CAND} SELECT CASE id % 6 WHEN 0 THEN 'appended' WHEN 1 THEN 'already_synced' WHEN 2 THEN 'recovered' WHEN 5 THEN 'failed' ELSE 'skipped' END AS status, count(*) AS n FROM cand GROUP BY 1",
    "a29_area_parity": f"WITH {_EVID} SELECT a AS area, CASE WHEN a = 'evidence' AND (SELECT count(*) FROM evid WHERE seen_count > 49) > 0 THEN 'fail' ELSE 'pass' END AS parity FROM (VALUES ('candidate'), ('status'), ('evidence'), ('action')) v(a)",
    "a26_stage_timing": """
        SELECT *, round(total_ms / sum(total_ms) OVER (), 4) AS share FROM (
            SELECT event_type AS stage, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total_ms, round(avg(CAST(floor(value) AS BIGINT)), 2) AS mean_ms, max(CAST(floor(value) AS BIGINT)) AS longest_ms FROM events GROUP BY 1)
    """,
}
