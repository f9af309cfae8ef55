"""Identity keys of events: fingerprints in tiers, and a softer key across sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import day_of
from .text import normalize_text
from .urls import identity_url


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def source_id_identity(ids: Column) -> Column:
    """source-id:k:v1,v2|... over a map of id lists: canonical values, sorted, and keys sorted; null if none."""
    lists = F.transform(F.map_entries(ids), lambda e: F.struct(e["key"].alias("k"), F.array_sort(F.filter(F.transform(e["value"], normalize_text), lambda v: v != "")).alias("v")))
    parts = F.array_sort(F.transform(F.filter(lists, lambda e: F.size(e["v"]) > 0), lambda e: F.concat(e["k"], F.lit(":"), F.array_join(e["v"], ","))))
    return F.when(F.size(parts) > 0, F.concat(F.lit("source-id:"), F.array_join(parts, "|")))


def source_url_identity(source: Column, url: Column) -> Column:
    return F.concat(F.lit("source-url:"), _some(normalize_text(source)), F.lit(":"), _some(identity_url(url)))


def event_name(c: Column) -> Column:
    """The canonical name without years and edition words."""
    bare = F.regexp_replace(F.concat(F.lit(" "), normalize_text(c), F.lit(" ")), r"(?<![a-z0-9])20[0-9]{2}(?![a-z0-9])", " ")
    bare = F.regexp_replace(bare, r"(?<![a-z0-9])(duplicate listing|copy|edition)(?![a-z0-9])", " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def fingerprint(official: Column, apply: Column, social: Column, ids: Column, name: Column, place: Column, start: Column, deadline: Column) -> Column:
    """The first that exists of: official, apply and social address, source ids, name with place and day."""
    day = F.coalesce(day_of(start), day_of(deadline), F.lit("unknown-date"))
    return F.coalesce(
        F.concat(F.lit("official:"), _some(identity_url(official))),
        F.concat(F.lit("apply:"), _some(identity_url(apply))),
        F.concat(F.lit("social:"), _some(identity_url(social))),
        source_id_identity(ids),
        F.concat(F.lit("event:"), normalize_text(name), F.lit(":"), normalize_text(place), F.lit(":"), day),
    )


def soft_key(name: Column, city: Column, mode: Column, start: Column, deadline: Column) -> Column:
    """soft:name:place:year; null without a name, a day, or a place (online counts as one)."""
    online = F.when(normalize_text(mode).isin("online", "remote"), "online")
    place = F.coalesce(_some(normalize_text(city)), online)
    year = F.substring(F.coalesce(day_of(start), day_of(deadline)), 1, 4)
    return F.concat(F.lit("soft:"), _some(event_name(name)), F.lit(":"), place, F.lit(":"), year)


#: How far each source is trusted.
AUTHORITY = {"mlh": 80, "devpost": 78, "luma": 70, "hacklist": 55, "hakku": 55, "web": 40, "x": 20, "mock": 10}


def authority(source: Column) -> Column:
    out = F.when(source.rlike("^custom:[a-z0-9]+(?:-[a-z0-9]+)*$"), 60)
    for name, value in AUTHORITY.items():
        out = out.when(source == name, value)
    return out.otherwise(30)
