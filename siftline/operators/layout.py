"""Listings read from the structure of pages: tables of aligned parts, leads, kindred unit sets, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline import storage
from siftline.functions import dates, urls
from siftline.functions.stages import held
from siftline.functions.text import borders

from . import resolve
from .discovery import ISO_DAY, NAMED_DAY, ratio

SET = ["page_id", "parent_id", "shape"]

#: Texts that are labels or badges and no titles, and words of titles.
META_TITLE = (
    r"^(registration\s+(start|end|opens?|closes?)|starts?|ends?|deadline|status|mode|format|location|venue|prize|eligibility|team size|apply by|applications?\s+close|submissions?\s+close)\s*:"
)
BADGE = r"^(registration\s+(closed|open|opens|closes|ended|live)|closed|open|upcoming|past|active|ended|sold out|applications?\s+(closed|open))$"
TITLE_WORDS = r"\b(hackathon|hack|challenge|competition|summit|conference|build|jam|sprint|meetup|workshop|bounty|cup|fest)\b"
REGISTRATION_TITLE, DATED_LABEL = r"^registration\s+(start|end|opens?|closes?)\b", r"^(starts?|ends?|deadline)\b.{0,40}\d{4}"
PLAIN_WORDS = r"^(open|past|upcoming|all|home|about|sponsors?|organizers?|faq|login|sign in|listitem|closed|online|virtual)$"
PLAIN_SLUGS = r"^(hack|hacks|event|events|allhacks|index)$"
REGISTRATION_START, REGISTRATION_END = r"registration\s+(start|opens?)\b", r"registration\s+(end|closes?)\b"
DEADLINE_WORDS, REGISTRATION_LABEL = r"\b(deadline|apply by|application|submission)\b", r"\bregistration\s+(start|end|opens?|closes?)\b"
PLACE = r"\b(?:online|virtual|hybrid|remote|in-person|onsite|[A-Z][a-z]+,\s*[A-Z][a-z]+|[A-Z][a-z]+\s*,\s*[A-Z]{2})\b"
MODE = r"(?i)\b(online|virtual|hybrid|remote|in-person|onsite)\b"
#: What a schedule names, by the words of its label and which of its dates is meant.
SCHEDULE = [
    ("event_start", r"\b(?:hackathon|event|challenge|competition)\b", "begin"), ("event_end", r"\b(?:hackathon|event|challenge|competition)\b", "end"),
    ("registration_open", r"\b(?:registration|applications?)\b", "begin"), ("registration_deadline", r"\b(?:registration|applications?)\b", "end"),
    ("submission_open", r"\bsubmissions?\b", "begin"), ("submission_deadline", r"\bsubmissions?\b", "end"),
    ("judging_start", r"\bjudging\b", "begin"), ("judging_end", r"\bjudging\b", "end"), ("result_announcement", r"\b(?:winners?|results?)\b", "single"),
]
ENDPOINTS = {"begin": r"begins?|starts?|opens?", "end": r"ends?|closes?|deadline", "single": r"announced?|posted|winners?|results?"}
SCHEDULE_DATE = r"([A-Za-z]{3,9}\s+\d{1,2}(?:,?\s+20\d{2})?)(?:\s+at\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)?(?:\s+[A-Z]{2,4})?)?"
SEGMENTS = "section, article, li, tr, .challenge-timeline-item, .timeline-item, .phase"


def _has(text: Column, words: str) -> Column:
    return text.rlike("(?i)" + borders(words))


def unit_sets(units: DataFrame) -> DataFrame:
    """One row per set of repeated units: how many, how alike, and how sure that makes it a listing."""
    text, href = F.nullif(F.col("text"), F.lit("")), F.array_compact(F.col("parts.href"))
    first = F.try_element_at(href, F.lit(1))
    out = units.groupBy(*SET, "parent_shape", "tag").agg(
        F.count(F.lit(1)).alias("units"), F.countDistinct(text).alias("distinct_texts"), F.count(first).alias("with_href"), F.countDistinct(first).alias("distinct_hrefs"), F.min("depth").alias("depth")
    )
    n = F.col("units")
    return out.withColumn("confidence", ratio(0.3 * F.col("distinct_texts") / n + 0.25 * F.col("distinct_hrefs") / n + 0.2 * F.col("with_href") / n + 0.25 * F.least(n / 10, F.lit(1.0))))


def columns(units: DataFrame) -> DataFrame:
    """The parts of a set's units aligned by path: in how many units each occurs, and with how many values."""
    total = units.groupBy(*SET).agg(F.count(F.lit(1)).alias("units"))
    parts = units.select(*SET, "unit", F.posexplode("parts").alias("at", "p")).select(*SET, "unit", "at", "p.*")
    out = parts.groupBy(*SET, "path").agg(F.count(F.lit(1)).alias("present"), F.countDistinct("text").alias("texts"), F.countDistinct("href").alias("hrefs"), F.min("at").alias("at"))
    return out.join(total, SET).withColumn("coverage", F.col("present") / F.col("units"))


def shared_paths(units: DataFrame, least: float) -> DataFrame:
    """One row per set: its units, and the paths that at least `least` of them have.

    What units have in common is counted first: a set's units mostly have the same paths, in few different lists.
    """
    alike = units.groupBy(*SET, F.col("parts.path").alias("listed")).agg(F.count(F.lit(1)).alias("n"))
    # the null stands for the unit itself
    path = F.explode(F.array_append(F.coalesce(F.array_distinct("listed"), F.array().cast("array<string>")), F.lit(None).cast("string")))
    found = alike.select(*SET, "n", path.alias("path")).groupBy(*SET, "path").agg(F.sum("n").alias("present"))
    found = found.groupBy(*SET).agg(F.max(F.when(F.col("path").isNull(), F.col("present"))).alias("units"), F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "present"))).alias("p"))
    return found.select(*SET, "units", F.transform(F.filter("p", lambda x: x["present"] / F.col("units") >= least), lambda x: x["path"]).alias("paths"))


def unit_table(units: DataFrame, least: float = 0.5) -> DataFrame:
    """Each unit with a map of the paths that at least `least` of its set's units have to its texts, or addresses where there is no text."""
    kept = shared_paths(units, least).filter("size(paths) > 0").drop("units")
    value = F.transform(F.filter("parts", lambda p: F.array_contains("paths", p["path"])), lambda p: F.struct(p["path"], F.coalesce(p["text"], p["href"])))
    return units.join(kept, SET).withColumn("fields", F.map_from_entries(value)).select(*SET, "unit", "fields")


def is_label(text: Column) -> Column:
    """Whether a text labels a date or a state and is no title."""
    return _has(text, META_TITLE) | _has(text, BADGE) | _has(text, REGISTRATION_TITLE) | (_has(text, DATED_LABEL) & ~_has(text, TITLE_WORDS))


def _worth(text: Column, dated: Column) -> Column:
    point = lambda c, n: F.when(c, n).otherwise(0)
    return F.when(_has(text, TITLE_WORDS), 3).otherwise(-point(dated, 2)) + point(text.rlike("^[A-Z0-9]"), 1) + point(F.length(text).between(8, 100), 1)


def title_worth(text: Column, dated: Column) -> Column:
    """How much a text reads like a title."""
    return _worth(text, dated) - F.when(is_label(text), 5).otherwise(0)


def _dated(text: Column) -> Column:
    return text.rlike(borders(ISO_DAY)) | _has(text, NAMED_DAY)


def best_title(texts: Column) -> Column:
    """The text of an array that reads most like a title, the first of equals; parts before a dot or bar count too."""
    flat = F.transform(texts, lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    lines = F.flatten(F.transform(flat, lambda t: F.array_distinct(F.array(F.trim(F.element_at(F.split(t, r"\s*[·|]\s*"), 1)), t))))
    fit = F.filter(lines, lambda t: F.length(t).between(4, 160) & ~_has(t, PLAIN_WORDS) & ~_has(t, "^https?://") & ~is_label(t))
    best = F.array_max(F.transform(fit, lambda t, i: F.struct(_worth(t, _dated(t)).alias("worth"), (-i).alias("at"), t.alias("text"))))
    return best["text"]


def slug_title(url: Column) -> Column:
    """A title made of the last part of an address's path; null where that says nothing."""
    slug = F.element_at(F.filter(F.split(urls.pathname(url), "/"), lambda x: x != ""), -1)
    words = F.initcap(F.trim(F.regexp_replace(slug, "[-_\\s]+", " ")))
    return F.when((F.length(slug) >= 3) & ~_has(slug, PLAIN_SLUGS) & (F.length(words) >= 4) & ~is_label(words), words)


def unit_leads(units: DataFrame, base: Column) -> DataFrame:
    """Units as leads: title, address, days by what their labels say, place, mode and state; equal ones once, the first kept."""
    rows = units.withColumn("texts", F.array_compact(F.col("parts.text"))).withColumn("blob", F.array_join("texts", " · "))
    links = F.filter(F.array_compact(F.col("parts.href")), lambda h: ~_has(h, "^(#|javascript:|mailto:|tel:)") & (h != ""))
    here = lambda u: (urls.origin(u) == urls.origin(base)) & (F.regexp_replace(urls.pathname(u), "/$", "") == F.regexp_replace(urls.pathname(base), "/$", ""))
    # addresses are resolved in a stage of their own, one row each
    link = held(rows.select(*SET, "unit", F.posexplode(links).alias("at", "h")), u=urls.resolve(F.col("h"), base)).filter(F.col("u").rlike("^https?:") & ~here(F.col("u")))
    link = link.groupBy(*SET, "unit").agg(F.min_by("u", "at").alias("url"))
    kind = lambda t: (
        F.when(_has(t, REGISTRATION_START), "opens").when(_has(t, REGISTRATION_END), "closes").when(_has(t, DEADLINE_WORDS), "deadline").when(F.col("registered") | _has(t, "registration"), "none").otherwise("start")
    )
    rows = rows.join(link, [*SET, "unit"], "left")
    # what is read more than once is computed once: first what all texts say together, then each text's day, then what that makes
    rows = held(rows, registered=_has(F.col("blob"), REGISTRATION_LABEL), title=F.coalesce(best_title(F.col("texts")), slug_title(F.col("url"))))
    day = lambda t: F.date_format(dates.dateish(t), "yyyy-MM-dd")
    dated = F.transform(F.filter("texts", dates.maybe_dateish), lambda t: F.struct(day(t).alias("day"), kind(t).alias("kind")))
    rows = held(rows.filter("title IS NOT NULL"), said=F.filter(dated, lambda x: x["day"].isNotNull()))
    first = lambda k: F.get(F.filter("said", lambda x: x["kind"] == k), 0)["day"]
    rows = rows.withColumns({k: first(k) for k in ("opens", "closes", "deadline", "start")})
    place = F.get(F.filter(F.transform("texts", lambda t: F.regexp_extract(t, borders(PLACE), 0)), lambda x: x != ""), 0)
    rows = rows.withColumns({
        "start_day": F.col("start"), "deadline_day": F.coalesce("deadline", "closes"), "place": place,
        "mode": F.nullif(F.regexp_extract(F.array_join("texts", " "), borders(MODE), 1), F.lit("")),
        "status": F.when(_has(F.col("blob"), r"\bregistration\s+closed\b"), "closed").when(_has(F.col("blob"), r"\bregistration\s+open\b"), "open").otherwise("unknown"),
    })
    same = F.trim(F.lower(F.concat_ws("|", "url", "title", F.coalesce("start_day", "deadline_day", "opens"))))
    lead = F.struct("unit", "title", "url", "start_day", "deadline_day", "place", "mode", "status")
    return rows.groupBy(*SET, "tag", same.alias("same")).agg(F.min_by(lead, "unit").alias("lead")).select(*SET, "tag", "lead.*")


def judged_sets(units: DataFrame, leads: DataFrame) -> DataFrame:
    """Unit sets with the share of their units that gave a title and an address, and the reasons against them."""
    per = leads.groupBy(*SET).agg(F.count(F.lit(1)).alias("leads"), F.count("url").alias("addressed"))
    out = unit_sets(units).join(per, SET, "left").fillna(0, ["leads", "addressed"])
    out = out.withColumns({"titled": ratio(F.col("leads") / F.col("units")), "identified": ratio(F.col("addressed") / F.col("units"))})
    reasons = [(F.col("titled") < 0.6, "low title completeness"), (F.col("identified") < 0.5, "low identity completeness"), (F.col("leads") < 2, "too few valid DOM records")]
    return out.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons])))


def kindred_sets(sets: DataFrame, units: DataFrame, least: float = 0.6) -> DataFrame:
    """(page_id, parent_id, shape, group): unit sets of a page whose tag, classes and paths overlap by at least `least`, directly or through others.

    Sets are joined on the rarest of their tokens only, as many as an overlap of
    `least` cannot do without; the overlap itself is then told from the whole sets.
    """
    paths = shared_paths(units, 0).filter("size(paths) > 0").select(*SET, F.transform("paths", lambda p: F.concat(F.lit("/"), p)).alias("paths"))
    named = sets.join(paths, SET).withColumn("tokens", F.array_union(F.split("shape", "[.]"), "paths")).withColumn("set_no", F.abs(F.xxhash64(*SET)))
    # one row per set is all that the steps below read, again and again
    named = storage.materialize(named.select(*SET, "units", "tokens", "set_no"), "unit-sets")
    token = named.select("page_id", "set_no", F.explode("tokens").alias("token"))
    often = token.groupBy("page_id", "token").agg(F.count(F.lit(1)).alias("n"))
    ranked = token.join(often, ["page_id", "token"]).groupBy("page_id", "set_no").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    size = F.size("t")
    ranked = ranked.select("page_id", "set_no", F.col("t.token").alias("all"), F.slice("t", F.lit(1), (size - F.ceil(size * least) + 1).cast("int")).alias("first"))
    keyed = ranked.select("page_id", "set_no", "all", F.explode("first.token").alias("token"))
    a, b = keyed.select("page_id", "token", F.col("set_no").alias("a"), F.col("all").alias("x")), keyed.select("page_id", "token", F.col("set_no").alias("b"), F.col("all").alias("y"))
    near = a.join(b, ["page_id", "token"]).filter("a < b").filter(F.size(F.array_intersect("x", "y")) >= least * F.size(F.array_union("x", "y"))).select("a", "b").distinct()
    groups = resolve.components(near, "a", "b", "set_no", "root")
    out = named.join(groups, "set_no", "left").withColumn("root", F.coalesce("root", "set_no"))
    first = out.groupBy("page_id", "root").agg(F.min(F.struct("parent_id", "shape")).alias("first"))
    return out.join(first, ["page_id", "root"]).select(*SET, "units", F.col("first.parent_id").alias("group_parent"), F.col("first.shape").alias("group_shape"))


def _with_day(df: DataFrame, year: int) -> DataFrame:
    """Append the day that column said names, in `year` if it names none."""
    flat = F.trim(F.regexp_replace(F.regexp_replace("said", r"(?i)\bat\s+\d{1,2}(?::\d{2})?\s*(?:am|pm)?(?:\s+[A-Z]{2,4})?", ""), r"\s+", " "))
    df = held(df, __flat=flat)
    whole = F.when(F.col("__flat").rlike(r"\b20\d{2}\b"), F.col("__flat")).otherwise(F.concat("__flat", F.lit(f", {year}")))
    df = held(df, __whole=F.regexp_replace(whole, r"(\d)\s+(20\d{2})", "$1, $2"))
    return held(df, day=dates.month_day_range(F.col("__whole"), F.lit(year))["start"]).drop("__flat", "__whole")


def schedule_days(segments: DataFrame, year: int) -> DataFrame:
    """segments (page_id, position, text) to one row per page and kind: the day of the first segment whose label names the kind.

    A label asks for the date behind its own verb (begins, ends, announced); a
    segment without one gives its first date, or its second where an end is asked.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace("text", "([a-z])([A-Z])", "$1 $2"), r"\s+", " "))
    # dates are read once per segment, each a row of its own until they are an array again
    rows = segments.select("page_id", "position", text.alias("text")).filter(F.length("text") > 8)
    every = rows.select("page_id", "position", "text", F.posexplode_outer(F.regexp_extract_all("text", F.lit(borders(r"(?i)\b" + SCHEDULE_DATE)), F.lit(1))).alias("at", "said"))
    every = _with_day(every, year).groupBy("page_id", "position", "text").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("day").isNotNull(), F.struct("at", "day")))), lambda x: x["day"])).alias("days"))
    kinds = []
    for kind, label, endpoint in SCHEDULE:
        said = F.nullif(F.regexp_extract("text", borders(rf"(?i)\b(?:{ENDPOINTS[endpoint]})\s*:?\s*{SCHEDULE_DATE}"), 1), F.lit(""))
        kinds.append(F.when(_has(F.col("text"), label), F.struct(F.lit(kind).alias("kind"), said.alias("said"), F.lit(2 if endpoint == "end" else 1).alias("place"))))
    asked = every.select("page_id", "position", "text", "days", F.explode(F.array_compact(F.array(*kinds))).alias("k")).select("page_id", "position", "text", "days", "k.*")
    found = _with_day(asked, year).withColumn("day", F.coalesce("day", F.try_element_at("days", F.col("place")))).filter("day IS NOT NULL")
    return found.groupBy("page_id", "kind").agg(F.min_by(F.struct("day", F.substring("text", 1, 220).alias("text")), "position").alias("x")).select("page_id", "kind", "x.*")


def labelled_dates(pieces: DataFrame, by: str, at: str, label: str, date: str, most: int | None = None) -> DataFrame:
    """Each date under the nearest label before it, as an as-of join over positions: pieces hold a label or a date.

    `most` is the furthest that a label reaches.
    """
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col(label).isNotNull(), F.struct(F.col(at).alias("from"), F.col(label).alias("label"))), ignorenulls=True).over(w)
    out = pieces.withColumn("held", held).filter(F.col(date).isNotNull() & F.col("held").isNotNull())
    out = out.select(by, at, date, F.col("held.label").alias(label), (F.col(at) - F.col("held.from")).alias("distance"))
    return out.filter(F.col("distance") <= most) if most is not None else out
