"""Merging records of several sources into one per event, in order of arrival.

Which of two values is preferred depends on trust, exactness and length, and not
associatively, so an event's records are folded one after the other.  Records
that could ever meet share a blocking key (an address, a source's id, or the
name without year); components of shared keys are dealt to tasks, sorted, and
streamed through the fold, which keeps the merged records of one component.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import keys, urls
from siftline.functions.dates import date_part
from siftline.functions.text import normalize_text

from .resolve import blocking_edges, components

ADDRESSES = ["official_url", "apply_url", "social_url"]
TEXTS = ["name", "start_date", "end_date", "deadline", "location", "city", "region", "country", "prize", "eligibility", "description"]
#: Names too general to tell an event by.
GENERAL = "^(hackathon|ai hackathon|ml hackathon|event|events|builders|challenge)$"


def prefer_url(old: Column, new: Column, old_source: Column, new_source: Column) -> Column:
    """The address whose host and source are trusted more; the old one of equals."""
    a, b = (urls.host_authority(u) + keys.authority(F.coalesce(s, F.lit(""))) for u, s in ((old, old_source), (new, new_source)))
    return F.when(F.coalesce(old, F.lit("")) == "", new).when(F.coalesce(new, F.lit("")) == "", old).when(b > a, new).otherwise(old)


def prefer_mode(old: Column, new: Column, old_source: Column, new_source: Column) -> Column:
    """A known mode, from the source trusted more; the old one of equals."""
    known = lambda c: F.when((c != "unknown") & (c != ""), c)
    a, b = keys.authority(F.coalesce(old_source, F.lit(""))), keys.authority(F.coalesce(new_source, F.lit("")))
    return F.when(known(old).isNull(), known(new)).when(known(new).isNull(), known(old)).when(b > a, new).otherwise(old)


_ISO = re.compile(r"^\d{4}-\d{2}-\d{2}")


def day(value: str | None) -> str | None:
    """The day of an ISO or named-month date, else nothing; the twin of dates.day_of."""
    value = (value or "").strip()
    if _ISO.match(value):
        return value[:10]
    for form in ("%b %d, %Y", "%B %d, %Y", "%b %d %Y", "%B %d %Y", "%d %b %Y", "%d %B %Y"):
        try:
            return datetime.strptime(value, form).strftime("%Y-%m-%d")
        except ValueError:
            continue
    return None


def stronger(old: str | None, new: str | None, old_trust: int, new_trust: int, dated: bool = True) -> str | None:
    """A day before vague words, then the trusted source's text, then one half as long again; the old one of equals."""
    old, new = (old or "").strip() or None, (new or "").strip() or None
    if old is None or new is None:
        return old or new
    old_day, new_day = (day(old), day(new)) if dated else (None, None)
    if new_day and not old_day:
        return new_day
    if old_day and not new_day:
        return old_day
    if new_trust > old_trust or (new_trust == old_trust and len(new) > 1.5 * len(old)):
        return (new_day or new) if new_trust > old_trust else new
    return old_day or old


def _canonical(value: str | None) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub(r"www\.", "", re.sub("https?://", "", (value or "").lower()))).strip()


class _Record:
    """A merged record with the keys that it is matched by."""

    def __init__(self, row: dict):
        self.row, self.members = row, [row["ordinal"]]
        self.derive()

    def derive(self) -> None:
        r = self.row
        bare = re.sub(r"\b(duplicate listing|copy|edition)\b", " ", re.sub(r"\b20\d{2}\b", " ", _canonical(r["name"])))
        self.name = re.sub(r"\s+", " ", bare).strip()
        self.when = day(r["start_date"]) or _canonical(r["start_date"]) or day(r["deadline"]) or _canonical(r["deadline"]) or None
        self.city, self.mode = _canonical(r["city"]), _canonical(r["mode"])
        tokens = {t for v in (r["city"], r["country"], r["mode"], f"{r['city'] or ''} {r['country'] or ''}") for t in (_canonical(v), *_canonical(v).split()) if t}
        self.place = tokens
        place = self.city or ("online" if self.mode in ("online", "remote") else "")
        self.soft = (self.name, place, self.when[:4]) if self.name and self.when and place else None
        ids = [r[f"{u}_id"] for u in ADDRESSES]
        first = next(((u, i) for u, i in zip(ADDRESSES, ids) if i), None)
        where = _canonical(" ".join(x for x in (r["city"], r["country"], r["mode"]) if x))
        self.print = first or (("ids", r["ids_key"]) if r["ids_key"] else ("event", _canonical(r["name"]), where, self.when))
        self.url = ids[0] or ids[1]
        self.telling = len(self.name) >= 8 and not re.match(GENERAL, self.name)
        self.keys = [("print", self.print), *([("soft", self.soft)] if self.soft else []), *([("url", self.url)] if self.url else []), *([("name", self.name)] if self.telling else [])]

    def like(self, other: "_Record") -> bool:
        """The same print, soft key or address, or the same telling name with year and place that do not differ."""
        if self.print == other.print or (self.soft and self.soft == other.soft) or (self.url and self.url == other.url):
            return True
        if self.name != other.name or not self.telling:
            return False
        if self.when and other.when and self.when[:4] != other.when[:4]:
            return False
        if self.city and other.city and self.city != other.city:
            return False
        return not self.place or not other.place or bool(self.place & other.place)

    def take(self, other: "_Record") -> None:
        a, b = self.row, other.row
        for u in ADDRESSES:
            if not a[u] or (b[u] and (b[f"{u}_host"] or 0) + b["authority"] > (a[f"{u}_host"] or 0) + a["authority"]):
                if b[u]:
                    a[u], a[f"{u}_id"], a[f"{u}_host"] = b[u], b[f"{u}_id"], b[f"{u}_host"]
        for t in TEXTS:
            a[t] = stronger(a[t], b[t], a["authority"], b["authority"], dated=t != "name")
        old, new = (x["mode"] if x["mode"] not in (None, "", "unknown") else None for x in (a, b))
        a["mode"] = new if old is None or (new and b["authority"] > a["authority"]) else old
        a["themes"] = list(dict.fromkeys([*(a["themes"] or []), *(b["themes"] or [])]))
        if b["authority"] > a["authority"]:
            a["source"], a["authority"] = b["source"], b["authority"]
        self.members += other.members
        self.derive()


_KEPT = ["source", *ADDRESSES, *TEXTS, "mode", "themes"]
_MERGED = "root long, first long, members array<long>, " + ", ".join(f"{c} {'array<string>' if c == 'themes' else 'string'}" for c in _KEPT)


class _Merged:
    """The merged records of one component, found by any key that a match needs."""

    def __init__(self):
        self.records: list[_Record] = []
        self.of_key: dict[tuple, set[int]] = {}

    def add(self, new: _Record) -> None:
        """Into the first record that it is like, else as one of its own."""
        near = sorted(set().union(*[self.of_key.get(k, ()) for k in new.keys]))
        at = next((i for i in near if self.records[i].like(new)), None)
        if at is None:
            at = len(self.records)
            self.records.append(new)
        else:
            for k in self.records[at].keys:
                self.of_key[k].discard(at)
            self.records[at].take(new)
        for k in self.records[at].keys:
            self.of_key.setdefault(k, set()).add(at)


def _fold(batches):
    """Rows sorted by (root, ordinal) to merged records."""
    import pyarrow as pa

    names = [f.split()[0] for f in _MERGED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.string()) if c == "themes" else pa.string() for c in _KEPT]]

    def batch(root, merged):
        rows = [[root, m.members[0], m.members, *[m.row[c] for c in _KEPT]] for m in merged]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    root, merged = None, _Merged()
    for table in batches:
        for row in table.to_pylist():
            if row["root"] != root:
                if merged.records:
                    yield batch(root, merged.records)
                root, merged = row["root"], _Merged()
            merged.add(_Record(row))
    if merged.records:
        yield batch(root, merged.records)


def merge_sources(events: DataFrame) -> DataFrame:
    """One row per event: its records folded in order of `ordinal`, as root, first, members and the merged fields.

    Input columns: ordinal, source, the addresses, the texts, mode, themes, and
    source_ids (map of id lists).

    Records meet in one task only if a chain of keys links them.  Records of a general
    name ("Hackathon") are linked by place and date, not by the name, which never
    matches alone; a record whose place or date came from another one through an
    address is then still matched within its own component only.
    """
    keyed = events.withColumn("ids_key", keys.source_id_identity(F.col("source_ids"))).withColumn("authority", keys.authority(F.col("source")))
    for u in ADDRESSES:
        keyed = keyed.withColumn(f"{u}_id", urls.identity_url(F.col(u))).withColumn(f"{u}_host", urls.host_authority(F.col(u)))
    # a telling name links whatever has it; a general one only with a place and a day, or a place and a year
    name = keys.event_name(F.col("name"))
    telling = (F.length(name) >= 8) & ~name.rlike(GENERAL)
    when = F.coalesce(date_part(F.col("start_date")), date_part(F.col("deadline")))
    where, city = normalize_text(F.concat_ws(" ", "city", "country", "mode")), F.nullif(normalize_text(F.coalesce("city", F.lit(""))), F.lit(""))
    exact = F.concat_ws("|", normalize_text(F.col("name")), where, F.coalesce(when, F.lit("")))
    place = F.coalesce(city, F.when(normalize_text(F.coalesce("mode", F.lit(""))).isin("online", "remote"), "online"))
    soft = F.concat(name, F.lit("|"), place, F.lit("|"), F.substring(when, 1, 4))
    kinds = [
        *[(u, F.col(f"{u}_id")) for u in ADDRESSES], ("ids", F.col("ids_key")), ("name", F.when(telling, name)),
        ("exact", F.when(~telling, exact)), ("soft", F.when(~telling, soft)),
    ]
    # any address may be another record's official one
    listed = F.explode(F.array(*[F.struct(F.lit("url" if k in ADDRESSES else k).alias("kind"), c.alias("key")) for k, c in kinds]))
    roots = components(blocking_edges(keyed.select("ordinal", listed.alias("x")).select("ordinal", "x.kind", "x.key")))
    named = keyed.join(roots, "ordinal", "left").withColumn("root", F.coalesce("root", "ordinal")).drop("source_ids")
    return named.repartition("root").sortWithinPartitions("root", "ordinal").mapInArrow(_fold, _MERGED)


# ---- set operations of a merge

def union_maps(left: Column, right: Column) -> Column:
    """Maps of id lists: lists of a shared key are united in order."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(left, right, lambda k, a, b: F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty))))


def overlay_maps(left: Column, right: Column) -> Column:
    """Maps: the right one's value wins wherever it has the key."""
    return F.map_zip_with(left, right, lambda k, a, b: F.coalesce(b, a))


def united_evidence(evidence: DataFrame, by: str, order: str) -> DataFrame:
    """Evidence of one type, address, title and snippet once per record: the first."""
    key = [by, "type", "url", "title", "snippet"]
    return evidence.groupBy(*key).agg(F.min(order).alias(order))


def united_dates(found: DataFrame, by: str, order: str, key: list[str], value: str) -> DataFrame:
    """Repeated finds of a key: the place of the first and the value of the last."""
    return found.groupBy(by, *key).agg(F.min(order).alias(order), F.max_by(value, F.struct(order, value)).alias(value))


# ---- the write plan


def incoming_groups(incoming: DataFrame, texts: list[str], lists: list[str]) -> DataFrame:
    """Records of one fingerprint in a batch as one: first non-empty texts, united lists, the last score.

    ``ordinal`` is the order in which a batch is worked through; the aggregates have
    partial sums, except the lists, which are as long as the group's distinct items.
    """
    filled = [F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ordinal"))).alias(c) for c in texts]
    out = incoming.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("members"), F.max_by("score", F.when(F.col("score").isNotNull(), F.col("ordinal"))).alias("score"),
        F.min_by("status", F.when(F.col("status").isNotNull(), F.col("ordinal"))).alias("status"), *filled,
    )
    for c in lists:
        items = incoming.select("fingerprint", "ordinal", F.posexplode(c).alias("at", "item")).filter("item <> ''")
        first = items.groupBy("fingerprint", "item").agg(F.min(F.struct("ordinal", "at")).alias("x"))
        listed = first.groupBy("fingerprint").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "item"))), lambda e: e["item"]).alias(c))
        out = out.join(listed, "fingerprint", "left").withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    return out


def kept_field(old: Column, new: Column) -> Column:
    """The stored value unless it is empty, or not a day where the new one is."""
    iso = r"^\d{4}-\d{2}-\d{2}"
    return F.when(F.coalesce(old, F.lit("")) == "", F.coalesce(new, old)).when(new.rlike(iso) & ~old.rlike(iso), new).otherwise(old)


def merged_row(texts: list[str], lists: list[str], old: str = "a", new: str = "b") -> list[Column]:
    """The columns of a stored row (alias old) after an incoming one (alias new); status is never touched."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    out = [F.coalesce(F.nullif(n("name"), F.lit("")), o("name")).alias("name")]
    trust = keys.authority(n("source")) > keys.authority(o("source"))
    out.append(F.when(F.coalesce(n("source"), F.lit("")) == "", o("source")).when(F.coalesce(o("source"), F.lit("")) == "", n("source")).when(trust, n("source")).otherwise(o("source")).alias("source"))
    out.append(F.coalesce(n("score"), o("score")).alias("score"))
    out += [kept_field(o(c), n(c)).alias(c) for c in texts if c not in ("name", "source")]
    empty = F.array().cast("array<string>")
    out += [F.filter(F.array_distinct(F.concat(F.coalesce(o(c), empty), F.coalesce(n(c), empty))), lambda x: x != "").alias(c) for c in lists]
    return out


def write_plan(groups: DataFrame, existing: DataFrame, texts: list[str], lists: list[str]) -> DataFrame:
    """fingerprint, action (create, update, unchanged), audit (the action row an update leaves), status and the row to store."""
    a, b = existing.alias("a"), groups.alias("b")
    both = b.join(a, F.col("a.fingerprint") == F.col("b.fingerprint"), "left")
    is_new = F.col("a.fingerprint").isNull()
    names = ["name", "source", "score", *[t for t in texts if t not in ("name", "source")], *lists]
    merged = dict(zip(names, merged_row(texts, lists)))
    same = None
    for c in names:
        equal = F.col(f"a.{c}").eqNullSafe(merged[c])
        same = equal if same is None else same & equal
    action = F.when(is_new, "create").when(same, "unchanged").otherwise("update")
    row = [F.when(is_new, F.col(f"b.{c}")).otherwise(merged[c]).alias(c) for c in names]
    status = F.when(is_new, F.coalesce(F.col("b.status"), F.lit("NEW"))).otherwise(F.col("a.status"))
    return both.select(
        F.col("b.fingerprint").alias("fingerprint"), action.alias("action"), F.when(action == "update", "UPDATE_FROM_DUPLICATE").alias("audit"), status.alias("status"), *row,
    )


def final_state(plan: DataFrame, existing: DataFrame, columns: list[str]) -> DataFrame:
    """The stored table once a plan has been written."""
    kept = existing.join(plan.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", "status", *columns)
    return kept.unionByName(plan.select("fingerprint", "status", *columns))


def evidence_plan(observed: DataFrame, existing: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Evidence after a batch of observations: stored counts go up by one each, the last non-null value wins.

    observed: key, values, at, ordinal; existing: key, values, first_seen, last_seen, seen_count.
    """
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c) for c in values]
    seen = observed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by("at", "ordinal").alias("first"), F.max_by("at", "ordinal").alias("last"), *last)
    both = seen.alias("s").join(existing.alias("e"), [F.col(f"s.{k}") == F.col(f"e.{k}") for k in key], "left")
    known = F.col(f"e.{key[0]}").isNotNull()
    return both.select(
        *[F.col(f"s.{k}").alias(k) for k in key], F.when(known, "update").otherwise("create").alias("action"),
        *[F.coalesce(F.col(f"s.{c}"), F.col(f"e.{c}")).alias(c) for c in values],
        F.coalesce(F.col("e.first_seen"), F.col("s.first")).alias("first_seen"), F.col("s.last").alias("last_seen"),
        (F.coalesce(F.col("e.seen_count"), F.lit(0)) + F.col("s.n")).cast("long").alias("seen_count"),
    )


# ---- status changes

def transition(records: DataFrame, wanted: Column, at: Column) -> DataFrame:
    """Each record with its new status, decision times, and the action that is logged; the same status again changes nothing."""
    moves = wanted.isNotNull() & ~wanted.eqNullSafe(F.col("status"))
    stamp = lambda name, state: F.when(moves & (wanted == state), at).when(moves & (wanted == "NEW"), F.lit(None)).otherwise(F.col(name)).alias(name)
    action = F.when(moves, F.when(wanted == "APPROVED", "APPROVE").when(wanted == "REJECTED", "REJECT").when(wanted == "SAVED_FOR_LATER", "SAVE_FOR_LATER").when(wanted == "NEW", "RESTORE"))
    others = [c for c in records.columns if c not in ("status", "approved_at", "rejected_at", "saved_at")]
    return records.select(
        *others, F.col("status").alias("previous_status"), F.when(moves, wanted).otherwise(F.col("status")).alias("status"),
        stamp("approved_at", "APPROVED"), stamp("rejected_at", "REJECTED"), stamp("saved_at", "SAVED_FOR_LATER"), action.alias("action"),
    )
