"""Serving views: filtered, sorted and keyset-paged queues, groups and histories."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far each type of evidence is trusted.
EVIDENCE_AUTHORITY = {
    "official_page": 100, "apply_page": 90, "mlh_page": 80, "devpost_page": 78, "luma_page": 70, "hacklist_card": 55, "hakku_card": 55, "source_card": 40, "search_result": 35, "manual_lead": 25, "x_post": 20,
}

#: Sort orders of the queue: columns with their direction, ids last so that order is total.
ORDERS = {
    "score": [("score", False), ("found_at", False), ("id", False)],
    "found_at": [("found_at", False), ("id", False)],
    "name": [("name", True), ("id", True)],
}


def after(order: list[tuple[str, bool]], cursor: tuple) -> Column:
    """Rows strictly after the cursor: the tuple comparison, spelt out per column.

    Descending columns have their nulls first, ascending ones last, here as in the sort.
    """
    out, equal = F.lit(False), F.lit(True)
    for (name, ascending), value in zip(order, cursor):
        c = F.col(name)
        if value is None:
            beyond, same = (F.lit(False) if ascending else c.isNotNull()), c.isNull()
        else:
            v = F.lit(value)
            beyond, same = ((c > v) | c.isNull() if ascending else c < v), c == v
        out = out | (equal & F.coalesce(beyond, F.lit(False)))
        equal = equal & F.coalesce(same, F.lit(False))
    return out


def encode_cursor(values: tuple) -> str:
    """A row's sort values as an opaque text."""
    return base64.urlsafe_b64encode(json.dumps([v if v is None or isinstance(v, (int, float, str)) else str(v) for v in values]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple:
    try:
        return tuple(json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))))
    except (ValueError, TypeError) as e:
        raise ValueError("invalid cursor") from e


def from_source(df: DataFrame, source: str) -> Column:
    """Records whose source it is, or that carry an identifier of that source."""
    own = F.col("source") == source
    return own | F.coalesce(F.map_contains_key("source_ids", F.lit(source)), F.lit(False)) if "source_ids" in df.columns else own


def filtered(df: DataFrame, statuses=None, source: str | None = None, q: str | None = None) -> DataFrame:
    """The queue's filters, any of which may be left out."""
    if statuses:
        df = df.filter(F.col("status").isin(list(statuses)))
    if source:
        df = df.filter(from_source(df, source))
    if q:
        df = df.filter(F.lower("name").contains(q.lower()))
    return df


def page_size(limit: int) -> int:
    return min(max(limit, 1), 50)


def page(df: DataFrame, sort: str = "score", limit: int = 20, cursor: tuple | None = None, statuses=None, source: str | None = None, q: str | None = None, offset: int = 0, more: int = 0) -> DataFrame:
    """One page of the queue and `more` rows beyond it; limit is held to 1 to 50, and an offset wins over a cursor."""
    df, order = filtered(df, statuses, source, q), ORDERS[sort]
    if cursor is not None and not offset:
        df = df.filter(after(order, cursor))
    df = df.orderBy(*[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in order])
    return (df.offset(offset) if offset else df).limit(page_size(limit) + more)


def fetch(df: DataFrame, sort: str = "score", limit: int = 20, cursor: str | None = None, **filters) -> dict:
    """A page as rows, the cursor of the next page if there is one, and the total of all pages; at most 51 rows come to the driver."""
    rows = page(df, sort, limit, decode_cursor(cursor) if cursor else None, more=1, **filters).collect()
    kept, size = rows[: page_size(limit)], page_size(limit)
    last = encode_cursor(tuple(kept[-1][c] for c, _ in ORDERS[sort])) if len(rows) > size else None
    total = filtered(df, *(filters.get(k) for k in ("statuses", "source", "q"))).count()
    return {"rows": kept, "next": last, "total": total}


def pending_sources(df: DataFrame) -> DataFrame:
    """Sources of records that wait for a decision: the main one and those whose identifiers they carry."""
    waiting = df.filter(F.col("status").isin("NEW", "NEEDS_REVIEW"))
    names = F.array_union(F.array("source"), F.coalesce(F.map_keys("source_ids"), F.array().cast("array<string>")))
    return waiting.select(F.explode(names).alias("source")).filter("source <> ''").distinct()


def detail(records: DataFrame, children: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Records with lists of their children, newest first; children: name -> (table, foreign key, time)."""
    for name, (table, key, at) in children.items():
        others = [c for c in table.columns if c != key]
        nested = table.groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_list(F.struct(at, *[c for c in others if c != at])), asc=False).alias(name))
        records = records.join(nested, F.col("id") == F.col("__key"), "left").drop("__key")
    return records


#: Actions that a reader of a record's history is shown.
MEANINGFUL = ["APPROVE", "REJECT", "SAVE_FOR_LATER", "RESTORE"]


def action_history(actions: DataFrame, by: str, order: list[str], limit: int = 20) -> DataFrame:
    """Per record the newest meaningful actions, numbered, and one row that counts all technical ones."""
    seen = F.col("action").isin(MEANINGFUL)
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    shown = actions.filter(seen).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
    shown = shown.select(by, "position", "action", F.lit(1).cast("long").alias("n"))
    rest = actions.filter(~seen).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return shown.unionByName(rest.select(by, F.lit(0).alias("position"), F.lit("TECHNICAL").alias("action"), "n"))


def claimable(jobs: DataFrame, now: Column, limit: int = 5) -> DataFrame:
    """The oldest queued jobs that are not cancelled and whose lease, if any, has run out."""
    free = F.col("claim_expires_at").isNull() | (F.col("claim_expires_at") <= now)
    return jobs.filter((F.col("status") == "queued") & ~F.coalesce("cancel_requested", F.lit(False)) & free).orderBy("created_at", "id").limit(limit)


def queue_positions(waiting: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The place of each waiter in its queue, from 1."""
    return waiting.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def evidence_authority(kind: Column) -> Column:
    out = F.when(kind.isNull(), 30)
    for name, value in EVIDENCE_AUTHORITY.items():
        out = out.when(kind == name, value)
    return out.otherwise(30)


def evidence_groups(evidence: DataFrame) -> DataFrame:
    """Observations by record, type and address: counts, last seen, authority."""
    return evidence.groupBy("candidate_id", "type", "url_key").agg(
        F.sum("seen_count").cast("long").alias("seen_count"), F.max("seen_at").alias("last_seen"), F.count(F.lit(1)).alias("members")
    ).withColumn("authority", evidence_authority(F.col("type")))


def primary_evidence(groups: DataFrame, limit: int = 5) -> DataFrame:
    """Up to `limit` groups per record by authority and recency; an apply page with an official page's address steps back."""
    by_address = Window.partitionBy("candidate_id", "url_key")
    official = F.max((F.col("type") == "official_page").cast("int")).over(by_address) == 1
    ranked = Window.partitionBy("candidate_id").orderBy(F.desc("authority"), F.desc("last_seen"), "url_key")
    kept = groups.withColumn("__dup", (F.col("type") == "apply_page") & official).filter("NOT __dup").drop("__dup")
    return kept.withColumn("position", F.row_number().over(ranked)).filter(F.col("position") <= limit)


def sequence(log: DataFrame, job: str = "job_id", order: tuple = ("ts", "event_id"), start: int = 0) -> DataFrame:
    """A gap-free number per job, in order."""
    return log.withColumn("sequence", (F.row_number().over(Window.partitionBy(job).orderBy(*order)) + start).cast("long"))


def byte_prefix(rows: DataFrame, size: str, order: str, budget: int, by: str) -> DataFrame:
    """Rows in order as long as their sizes, summed, stay within the budget."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def forward_fill(rows: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """Nulls take the last value before them."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
