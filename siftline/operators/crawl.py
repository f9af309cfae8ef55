"""Crawls: which sources run, what a scan returned, when to stop, and what it all adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.text import ratio


# ---- sources

#: The health of a source that keeps it from running, and why.
UNUSABLE = {"disabled": "is disabled", "disconnected": "is disconnected", "auth_required": "requires authentication", "unconfigured": "is unconfigured"}


def select_sources(requested: DataFrame, availability: DataFrame) -> DataFrame:
    """Each requested source once, in order: runs, reason (why not) and warning.

    requested: ordinal, source; availability: source, enabled, health, reason.  A
    degraded source runs with a warning; one without availability is healthy.
    """
    first = requested.groupBy("source").agg(F.min("ordinal").alias("ordinal"))
    both = first.join(availability, "source", "left")
    health = F.when(~F.coalesce("enabled", F.lit(True)), "disabled").otherwise(F.coalesce("health", F.lit("healthy")))
    why = F.when(F.col("source") == "x", "X is not included by default").when(F.col("source") == "mock", "Mock source requires allowMock")
    for state, words in UNUSABLE.items():
        why = why.when(health == state, F.coalesce("reason", F.concat("source", F.lit(f" {words}"))))
    degraded = F.when(health == "degraded", F.concat("source", F.lit(" is degraded"), F.coalesce(F.concat(F.lit(": "), F.col("reason")), F.lit(""))))
    return both.select("ordinal", "source", why.isNull().alias("runs"), why.alias("reason"), F.when(why.isNotNull(), F.concat(F.lit("Skipped "), F.col("source"), F.lit(": "), why)).otherwise(degraded).alias("warning"))


def reconcile_plan(effective: DataFrame, planned: DataFrame, availability: DataFrame) -> DataFrame:
    """The order in which sources run: the planner's first, then those it left out; its skips hold only for degraded sources.

    effective: ordinal, source; planned: ordinal, source, wanted; availability: source, health.
    """
    mine = effective.groupBy("source").agg(F.min("ordinal").alias("own"))
    plan = planned.groupBy("source").agg(F.min("ordinal").alias("place"), F.min_by("wanted", "ordinal").alias("wanted"))
    both = mine.join(plan, "source", "left").join(availability, "source", "left")
    stopped = F.col("health").isin(*UNUSABLE)
    state = F.when(stopped, F.concat(F.lit("skip_"), F.col("health"))).when(~F.col("wanted") & (F.col("health") == "degraded"), "skip_degraded").otherwise("execute")
    warning = F.when(state == "execute", F.when(~F.col("wanted"), "planner skip overruled").when(F.col("place").isNull(), "planner left it out"))
    return both.select("source", F.col("place").isNull().alias("left_out"), F.coalesce("place", "own").alias("place"), state.alias("state"), warning.alias("warning"))


# ---- results of scans

def scan_status(status: Column, errors: Column, warnings: Column) -> Column:
    """What a scan came to: its own word unless that is "completed", then errors, then warnings."""
    signed_out = F.exists(errors, lambda e: e.rlike(r"(?i)auth|login|sign[\s-]?in|session"))
    return (
        F.when(status.isNotNull() & (status != "completed"), status).when(signed_out, "auth_required").when(F.size(errors) > 0, "failed")
        .when(F.size(warnings) > 0, "degraded").otherwise("completed")
    )


def normalized_scan(df: DataFrame) -> DataFrame:
    """Scan results with counts that agree: discovered is at least what was returned, dropped is the difference.

    Input: source, status, discovered, leads (number), errors, warnings.  A scan that
    found something and returned nothing is degraded and says so.
    """
    found = F.greatest(F.coalesce("discovered", F.col("leads")), F.col("leads"))
    empty = (found > 0) & (F.col("leads") == 0)
    status = scan_status(F.col("status"), F.col("errors"), F.col("warnings"))
    warning = F.concat(F.lit("Collector contract warning: "), found.cast("string"), F.lit(" discovered, 0 returned."))
    return df.select(
        "source", F.when(empty & (status == "completed"), "degraded").otherwise(status).alias("status"), found.alias("discovered"), F.col("leads").alias("returned"),
        F.greatest(F.lit(0), found - F.col("leads")).alias("dropped"), F.size("errors").alias("errors"),
        F.when(empty, F.concat("warnings", F.array(warning))).otherwise(F.col("warnings")).alias("warnings"),
    )


def under_extracted(units: Column, leads: Column) -> Column:
    """(rejected, under): of at least five units, less than two fifths became records."""
    units, leads = F.greatest(units, F.lit(0)), F.greatest(leads, F.lit(0))
    return F.struct(F.greatest(units - leads, F.lit(0)).alias("rejected"), ((units >= 5) & (leads / units < 0.4)).alias("under"))


def inventory(source: Column, meta_total: Column, unique: Column, stop: Column) -> Column:
    """(value, method, confidence): how many records a source has, from its own total or how its scan ended."""
    done = stop.rlike("(?i)no_additional_cards|no_next_page|no_growth|exhausted|completed|end_marker") & ~stop.rlike(
        "(?i)maximum_cards_reached|maximum_pages_reached|maximum_scrolls|timeout|capped|safety_|target_reached")
    done = F.coalesce(done, F.lit(False))

    def verdict(value, method, confidence):
        return F.struct(value.cast("long").alias("value"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))

    return (
        F.when((source == "devpost") & (meta_total > 0), verdict(meta_total, "api_total", "strong")).when((source == "devpost") & done, verdict(unique, "api_total", "strong"))
        .when(source.isin("luma", "hakku") & done, verdict(unique, "scroll_plateau", "strong"))
        .when(stop.rlike("(?i)maximum_cards_reached|maximum_pages_reached|maximum_scrolls"), verdict(unique, "pagination_derived", "weak"))
        .when(unique > 0, verdict(unique, "unknown", "weak"))
    )


def outcome_counts(records: DataFrame) -> DataFrame:
    """Per source: queued, ready, in review and rejected records."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return records.groupBy("source").agg(
        F.count_if(F.col("status").isin("NEW", "NEEDS_REVIEW")).alias("queued"), is_("NEW").alias("ready"), is_("NEEDS_REVIEW").alias("review"), is_("REJECTED").alias("rejected"),
    )


def sources_by_outcome(stats: DataFrame) -> DataFrame:
    """Sources of each outcome, as one sorted list each."""
    return stats.groupBy("outcome").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


# ---- growth

def accumulated(cards: DataFrame, step: str, order: str, identity: str) -> DataFrame:
    """Per step: new identities, duplicates and their share; a blank identity is a duplicate."""
    key = F.trim(F.col(identity))
    first = cards.filter(key != "").groupBy(key.alias("__id")).agg(F.min(F.struct(step, order)).alias("__first"))
    new = first.groupBy(F.col(f"__first.{step}").alias(step)).agg(F.count(F.lit(1)).alias("added"))
    out = cards.groupBy(step).agg(F.count(F.lit(1)).alias("cards")).join(new, step, "left").fillna(0, ["added"])
    return out.select(step, "added", (F.col("cards") - F.col("added")).alias("duplicates"), F.round((F.col("cards") - F.col("added")) / F.col("cards"), 4).alias("duplicate_rate"))


def stable_stop(grown: DataFrame, most_items: int, most_steps: int, dry_limit: int) -> DataFrame:
    """(step, reason) at which collecting until stable ends: enough items, so many steps without growth, or no steps left.

    grown: step from 0, total and dry_steps, as growth() gives them; the first step only opens the page.
    """
    full, dry, out = F.col("total") >= most_items, (F.col("step") > 0) & (F.col("dry_steps") >= dry_limit), F.col("step") >= most_steps
    reason = F.when(full, "max_items").when(dry, "no_growth").otherwise("max_scrolls")
    ends = grown.filter(full | dry | out)
    return ends.agg(F.min("step").alias("step"), F.min_by(reason, "step").alias("reason"))


def cap_stop(unique: Column, target: Column, most: Column, at_target: Column) -> Column:
    """The cap that a number of unique records reaches: the soft target first if one stops there."""
    return F.when(at_target & (unique >= target), "target_reached").when(unique >= most, "maximum_cards_reached")


#: What a stop reason says about the source.
STOP_STATES = {
    "healthy_complete": ["exhausted", "no_growth"], "healthy_bounded": ["target_reached", "maximum_cards_reached", "max_budget"], "usable_partial": ["timeout", "cancelled"],
    "blocked_human_verification": ["blocked_human_verification"], "blocked_authentication": ["blocked_authentication"], "acquisition_failed": ["acquisition_failed"],
}


def stop_state(reason: Column) -> Column:
    out = None
    for state, reasons in STOP_STATES.items():
        out = F.when(reason.isin(reasons), state) if out is None else out.when(reason.isin(reasons), state)
    return out.otherwise("degraded")


def budget_left(most: dict[str, int], used: dict[str, Column]) -> Column:
    """What is left of each budget, and whether any is used up."""
    left = [F.greatest(F.lit(0), F.lit(n) - used[k]).cast("long").alias(k) for k, n in most.items()]
    gone = None
    for k, n in most.items():
        gone = used[k] >= n if gone is None else gone | (used[k] >= n)
    return F.struct(*left, gone.alias("exhausted"))


def continuation(elapsed, duration, pages, most_pages, repeated, streak, more, accepted, target, horizon, growth) -> Column:
    """Why a crawl ends, in order of precedence, or "continue"."""
    return (
        F.when(elapsed >= duration, "timeout").when(pages >= most_pages, "page_cap").when(repeated, "repeated_fingerprint").when(streak >= 3, "expired_or_irrelevant_streak")
        .when(~more, "source_exhausted").when((accepted >= target) & horizon, "target_and_horizon_satisfied")
        .when((growth <= 0) & (pages > 0), "no_stable_identity_growth").otherwise("continue")
    )


def date_coverage(leads: DataFrame, batch: str, low: str | None, high: str | None) -> DataFrame:
    """Per batch: first and last day, records inside the horizon, whether it is covered, and the share that is open.

    leads: start_date, end_date, deadline (ISO days) and status.
    """
    days = F.array_compact(F.array("start_date", "end_date"))
    known = F.array_compact(F.array("start_date", "end_date", "deadline"))
    inside = F.exists(known, lambda d: (d >= F.lit(low or "")) & (d <= F.lit(high or "9999-12-31")))
    out = leads.groupBy(batch).agg(
        F.min(F.array_min(days)).alias("first_day"), F.max(F.array_max(days)).alias("last_day"), F.count_if(inside).alias("in_horizon"), F.count(F.lit(1)).alias("n"),
        ratio(F.count_if(F.col("status").isin("open", "upcoming", "ongoing")) / F.count(F.lit(1))).alias("open_rate"),
    )
    covered = F.lit(True)
    if low:
        covered = covered & F.coalesce(F.col("first_day") <= low, F.lit(False))
    if high:
        covered = covered & F.coalesce(F.col("last_day") >= high, F.lit(False))
    return out.withColumn("covered", covered)


def available_count(estimates: DataFrame, by: str, observed: str) -> DataFrame:
    """The best estimate of what a source has: the least priority, then the largest, never below what was seen.

    estimates: by, method, priority, value, and the number observed.
    """
    best = F.min_by(F.struct("method", "value"), F.struct("priority", -F.col("value")))
    out = estimates.filter("value IS NOT NULL").groupBy(by).agg(best.alias("b"), F.max(observed).alias("__seen"))
    return out.select(by, F.col("b.method").alias("method"), F.greatest(F.col("b.value"), F.col("__seen")).alias("value"), (F.col("b.value") < F.col("__seen")).alias("raised"))


#: Words in the names of fields that tell how a listing goes on, most telling first.
PAGING = [("cursor", "cursor|endcursor|nextcursor|after"), ("next_link", "next|nextpage|next_page|hasnext|has_more"), ("offset", "offset|limit|skip"), ("page_number", "page|pageinfo|totalpages|currentpage")]


def pagination(paths: DataFrame, by: str, path: str = "path") -> DataFrame:
    """How a JSON listing is paged, by the names of its fields (path as walk_json gives it)."""
    name = F.lower(F.regexp_extract(F.col(path), r"([^.\[\]]+)(?:\[\])?$", 1))
    marks = [F.bool_or(name.rlike(f"^({words})$")).alias(f"__{kind}") for kind, words in PAGING]
    out = paths.groupBy(by).agg(*marks, F.count_if(name.rlike("^(" + "|".join(w for _, w in PAGING) + ")$")).alias("signals"))
    method = None
    for kind, _ in PAGING:
        method = F.when(F.col(f"__{kind}"), kind) if method is None else method.when(F.col(f"__{kind}"), kind)
    return out.select(by, method.otherwise("none").alias("method"), "signals")


def sync_tally(results: DataFrame) -> DataFrame:
    """How many rows of a batch came to each sync status; unknown ones count as skipped."""
    known = ["appended", "already_synced", "recovered_existing_row", "mock_synced", "dry_run", "failed"]
    status = F.when(F.col("status") == "recovered_existing_row", "recovered").when(F.col("status").isin(known), F.col("status")).otherwise("skipped")
    return results.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def area_parity(mismatches: DataFrame, areas: list[str]) -> DataFrame:
    """pass or fail of each area: one mismatch fails it."""
    spark = mismatches.sparkSession
    every = spark.createDataFrame([(a,) for a in areas], "area string")
    hit = mismatches.groupBy("area").agg(F.count(F.lit(1)).alias("n"))
    return every.join(hit, "area", "left").select("area", F.when(F.coalesce("n", F.lit(0)) > 0, "fail").otherwise("pass").alias("parity"))


def stage_timing(spans: DataFrame) -> DataFrame:
    """Per stage: spans, total, mean and longest milliseconds, and the share of all time."""
    out = spans.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"), F.round(F.avg("ms"), 2).alias("mean_ms"), F.max("ms").alias("longest_ms"))
    # the window holds one row per stage, however many spans there are
    return out.withColumn("share", F.round(F.col("total_ms") / F.sum("total_ms").over(Window.partitionBy()), 4))
