"""Dates from dirty text, and temporal states.  The current time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text

ISO = r"^\d{4}-\d{2}-\d{2}"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Kind of date, confidence, label words, and whether "N days left" may stand for the date.
LABELS = [
    ("event_start", "high", "event date|starts?|begins?|hackathon dates?|competition period|hacking period|opening ceremony|final event|event starts?", False),
    ("registration_open", "high", "registration opens?|applications open|apply opens?", False),
    ("registration_deadline", "high", "registration deadline|registration closes?|register by|rsvp deadline|last day to register", True),
    ("application_deadline", "high", "application deadline|apply by|applications close", True),
    ("submission_deadline", "high", "submission deadline|submissions close|project submission|build deadline|final submission", True),
    ("submission_open", "high", "submissions? open|submissions? begin|submission period begins?|project submission opens?", False),
    ("judging_start", "high", "judging begins?|judging starts?|review period begins?", False),
    ("judging_end", "high", "judging ends?|judging closes?|review period ends?", False),
    ("result_announcement", "medium", "results? announced|winners? announced|result announcement", False),
]
RANGE_LABELS = "event date|hackathon dates?|competition period|hacking period"
APPLY_WORDS = "apply|registration|register|applications?"
#: An ASCII word's border before and after.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_DATE = r"20\d{2}-\d{2}-\d{2}|[A-Za-z]+\s+\d{1,2},?\s+20\d{2}"
_NAME = "((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))(?:(?<=jan)uary|(?<=feb)ruary|(?<=mar)ch|(?<=apr)il|(?<=jun)e|(?<=jul)y|(?<=aug)ust|(?<=sep)tember|(?<=oct)ober|(?<=nov)ember|(?<=dec)ember)?"
_NAMED = rf"^(?:{_NAME} (\d{{1,2}}),? (\d{{4}})|(\d{{1,2}}) {_NAME} (\d{{4}}))$"


def day_of(c: Column) -> Column:
    """yyyy-MM-dd of an ISO prefix or a named-month date; null otherwise."""
    text = F.trim(c)
    # "Sep 5, 2026", "September 5 2026" and "5 Sep 2026" are brought to one form and read once
    one_form = F.initcap(F.regexp_replace(F.lower(text), _NAMED, "$2$4 $1$5 $3$6"))
    parsed = F.try_to_timestamp(one_form, F.lit("d MMM yyyy"))
    return F.when(text.rlike(ISO), F.substring(text, 1, 10)).otherwise(F.date_format(parsed, "yyyy-MM-dd"))


def date_part(c: Column) -> Column:
    """The day if there is one, else the canonical text; null if that is empty."""
    return F.coalesce(day_of(c), F.nullif(normalize_text(F.trim(c)), F.lit("")))


def today_in(now: Column, zone: Column) -> Column:
    """The day of an instant (UTC) in a time zone."""
    return F.date_format(F.from_utc_timestamp(now, zone), "yyyy-MM-dd")


def temporal_status(start: Column, end: Column, today: Column) -> Column:
    """UPCOMING, ONGOING, FINISHED or UNKNOWN; the last day belongs to the event."""
    s, e = day_of(start), day_of(F.coalesce(end, start))
    return (
        F.when(s.isNull() | e.isNull(), "UNKNOWN").when(e < today, "FINISHED").when(s > today, "UPCOMING").otherwise("ONGOING")
    )


def deadline_closed(deadline: Column, today: Column) -> Column:
    """Strictly before today; without a day it is open."""
    return F.coalesce(day_of(deadline) < today, F.lit(False))


def deadline_state(deadline: Column, today: Column) -> Column:
    day = day_of(deadline)
    return F.when(F.nullif(F.trim(deadline), F.lit("")).isNull(), "missing").when(day.isNull(), "unclear").when(day < today, "closed").otherwise("open")


def stale_title_year(title: Column, days: list[Column], year: int) -> Column:
    """The oldest year named in the title is past, and no known date is of this year or later."""
    years = F.transform(F.regexp_extract_all(title, F.lit(r"(?<![0-9A-Za-z_])(20\d{2})(?![0-9A-Za-z_])"), F.lit(1)), lambda y: y.cast("int"))
    known = F.exists(F.array(*days), lambda d: F.coalesce(F.substring(day_of(d), 1, 4).cast("int") >= year, F.lit(False)))
    return F.coalesce(F.array_min(years) < year, F.lit(False)) & ~F.coalesce(known, F.lit(False))


def range_overlap(start: Column, end: Column, low: Column, high: Column) -> Column:
    """inside, outside or unknown: whether [start, end] meets the asked range."""
    s, e = day_of(start), day_of(F.coalesce(end, start))
    return F.when(s.isNull(), "unknown").when((s <= high) & (e >= low), "inside").otherwise("outside")


def _value(raw: Column, today: Column) -> Column:
    """A mined date: a day, or today and so many days, or canonical text."""
    left = F.regexp_extract(raw, r"(?i)^(\d{1,6})\s+days?\s+left", 1)
    return F.when(left != "", F.date_format(F.date_add(today.cast("date"), left.cast("int")), "yyyy-MM-dd")).otherwise(date_part(raw))


def _found(kind: Column, value: Column, confidence: str, said: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), F.lit(confidence).alias("confidence"), F.substring(said, 1, 180).alias("source_text"))


def mined(text: Column, today: Column) -> Column:
    """Array of (kind, value, confidence, source_text): labelled dates, a labelled range, days left.

    Labels are looked for one after the other, so "judging starts" gives both a
    judging and an event start.  Texts without any labelled date pass one test only.
    """
    kinds = []
    for kind, confidence, words, days in LABELS:
        date = _DATE + (r"|\d+\s+days?\s+left" if days else "")
        pattern = F.lit(rf"(?i){_B}(?:{words})\s*[:\-]?\s*({date})")
        pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("said"), F.regexp_extract_all(text, pattern, F.lit(1)).alias("raw"))
        kinds.append(F.transform(pairs, _mining(kind, confidence, today)))
    span = rf"(?i){_B}(?:{RANGE_LABELS})\s*[:\-]?\s*([A-Za-z]+\s+\d{{1,2}})(?:\s*(?:-|to|through|until)\s*(?:([A-Za-z]+)\s+)?(\d{{1,2}})),?\s*(20\d{{2}}){_E}"
    part = lambda i: F.regexp_extract(text, span, i)
    month = F.coalesce(F.nullif(part(2), F.lit("")), F.regexp_extract(part(1), "^[A-Za-z]+", 0))
    ends = F.array(
        _found(F.lit("event_start"), date_part(F.concat(part(1), F.lit(", "), part(4))), "high", part(0)),
        _found(F.lit("event_end"), date_part(F.concat(month, F.lit(" "), part(3), F.lit(", "), part(4))), "high", part(0)),
    )
    nothing = F.array().cast("array<struct<kind:string,value:string,confidence:string,source_text:string>>")
    left = F.regexp_extract(text, rf"(?i){_B}\d+\s+days?\s+left{_E}", 0)
    due = (left != "") & text.rlike(rf"(?i){_B}(?:{APPLY_WORDS}){_E}")
    more = F.concat(
        F.when(part(0) != "", ends).otherwise(nothing),
        F.when(due, F.array(_found(F.lit("registration_deadline"), _value(left, today), "medium", left))).otherwise(nothing),
    )
    every = "|".join(words for _, _, words, _ in LABELS)
    any_label = text.rlike(rf"(?i){_B}(?:{every})\s*[:\-]?\s*(?:20\d\d-|[A-Za-z]+\s+\d|\d+\s+days?\s+left)")
    return F.array_distinct(F.concat(F.when(any_label, F.flatten(F.array(*kinds))).otherwise(nothing), more))


def _mining(kind: str, confidence: str, today: Column):
    return lambda x: _found(F.lit(kind), _value(x["raw"], today), confidence, x["said"])


def first_of(evidence: Column, kind: str) -> Column:
    """The first mined value of a kind."""
    return F.try_element_at(F.filter(evidence, lambda x: (x["kind"] == kind) & x["value"].isNotNull()), F.lit(1))["value"]


def parsed_days(evidence: Column) -> Column:
    """start, end and deadline of mined dates; a missing end is the start."""
    start = first_of(evidence, "event_start")
    deadline = F.coalesce(first_of(evidence, "registration_deadline"), first_of(evidence, "application_deadline"))
    return F.struct(start.alias("start"), F.coalesce(first_of(evidence, "event_end"), start).alias("end"), deadline.alias("deadline"))


def _month(c: Column) -> Column:
    """The number of the month whose first three letters a word has."""
    return F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(c, 1, 3))).cast("int"), F.lit(0))


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"), "yyyy-MM-dd")


def displayed_range(text: Column, year: Column) -> Column:
    """(start, end) of a shown range, "Jul 1 - Aug 15, 2026": years may stand at either end, else it is the last one named or `year`."""
    flat = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), "[–—]", "-")
    pattern = rf"(?i){_B}([A-Za-z]{{3,9}})\s+(\d{{1,2}})(?:,?\s*(20\d{{2}}))?\s*(?:-|to|through|until)\s*(?:([A-Za-z]{{3,9}})\s+)?(\d{{1,2}})(?:,?\s*(20\d{{2}}))?{_E}"
    part = lambda i: F.nullif(F.regexp_extract(flat, pattern, i), F.lit(""))
    named = F.try_element_at(F.regexp_extract_all(flat, F.lit(rf"{_B}(20\d{{2}}){_E}"), F.lit(1)), F.lit(-1))
    fallback = F.coalesce(named.cast("int"), year)
    y1 = F.coalesce(part(3).cast("int"), fallback)
    y2 = F.coalesce(part(6).cast("int"), part(3).cast("int"), fallback)
    return F.struct(
        _iso(y1, _month(part(1)), part(2).cast("int")).alias("start"),
        _iso(y2, _month(F.coalesce(part(4), part(1))), part(5).cast("int")).alias("end"),
    )


def month_day_range(text: Column, year: Column) -> Column:
    """(start, end) of "Sep 5 - 7, 2026" within one month; no end if only one day is named."""
    pattern = rf"(?i){_B}(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?\s+(\d{{1,2}})(?:\s*[–-]\s*(\d{{1,2}}))?(?:,\s*(\d{{4}}))?"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    y, m = F.coalesce(part(4).cast("int"), year), _month(part(1))
    day = lambda d: F.when(m.isNotNull() & d.isNotNull(), F.format_string("%04d-%02d-%02d", y, m, d))
    return F.struct(day(part(2).cast("int")).alias("start"), day(part(3).cast("int")).alias("end"))


def heading_day(heading: Column, today: Column) -> Column:
    """The day that a timeline heading names: today, tomorrow, this weekend, a weekday, or a month and day.

    A month and day that lies before yesterday is next year's.
    """
    text, day = F.lower(F.trim(F.regexp_replace(heading, r"\s+", " "))), today.cast("date")
    now = F.dayofweek(day) - 1  # Sunday is 0
    ahead = lambda n: F.date_format(F.date_add(day, n), "yyyy-MM-dd")
    weekday = F.regexp_extract(text, "^(sun(?:day)?|mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?)$", 1)
    number = F.array_position(F.array(*[F.lit(d) for d in ("sun", "mon", "tue", "wed", "thu", "fri", "sat")]), F.substring(weekday, 1, 3)).cast("int") - 1
    pattern = rf"{_B}([a-z]{{3,9}})\s+(\d{{1,2}})(?:,?\s*(20\d{{2}}))?{_E}"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    named = lambda y: date_part(F.concat(part(1), F.lit(" "), part(2), F.lit(", "), y.cast("string")))
    this, given = F.year(day), part(3)
    rolled = F.when(given.isNull() & (named(F.coalesce(given, this)) < ahead(-1)), named(this + 1)).otherwise(named(F.coalesce(given, this.cast("string"))))
    return (
        F.when(text == "today", ahead(0)).when(text == "tomorrow", ahead(1))
        .when(text == "this weekend", ahead(F.when(now == 6, 7).otherwise(6 - now)))
        .when(weekday != "", ahead(F.pmod(number - now, F.lit(7))))
        .when(part(1).isNotNull(), rolled)
    )


def maybe_dateish(c: Column) -> Column:
    """Whether dateish may find anything: it asks for a year of this century or a bare number."""
    return c.rlike(r"20[0-9]{2}|^\s*[0-9][0-9.]*\s*$")


def dateish(c: Column) -> Column:
    """A timestamp of anything date-like: epoch seconds or milliseconds, an ISO stamp, or a named month; else null."""
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    number = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.cast("double"))
    millis = F.when(number > 10_000_000_000, number).when(number > 1_000_000_000, number * 1000)
    iso = F.nullif(F.regexp_extract(text, rf"{_B}(20\d{{2}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d+)?)?(?:Z|[+-]\d{{2}}:?\d{{2}})?)?)", 1), F.lit(""))
    month = F.nullif(F.regexp_extract(text, rf"(?i){_B}(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{{1,2}},?\s+20\d{{2}}{_E}", 0), F.lit(""))
    return F.coalesce(F.timestamp_millis(millis.cast("long")), F.try_to_timestamp(iso), F.try_to_timestamp(day_of(month)))


#: Words that place an event in a time zone.
ZONES = [("America/Toronto", "toronto|mississauga|waterloo|ontario|canada|gta|greater toronto"), ("Asia/Kolkata", "india|chhattisgarh|bilaspur")]


def zone_of(*place: Column) -> Column:
    """The time zone of a place by its words; UTC for the rest."""
    text, out = F.lower(F.concat_ws(" ", *place)), None
    for zone, words in ZONES:
        out = F.when(text.rlike(words), zone) if out is None else out.when(text.rlike(words), zone)
    return out.otherwise("UTC")


def season_range(text: Column, year: Column) -> Column:
    """(start, end) of 'Dec 30th - Jan 2nd' with the year rolled over where the end month is earlier."""
    low = F.lower(F.regexp_replace(text, r"(?i)(?<=\d)(st|nd|rd|th)", ""))
    pattern = r"^([a-z]+)\s+(\d{1,2})(?:\s*[-–—]\s*([a-z]+)?\s*(\d{1,2}))?"
    part = lambda i: F.nullif(F.regexp_extract(F.trim(low), pattern, i), F.lit(""))
    m1, d1 = _month(part(1)), part(2).cast("int")
    m2, d2 = _month(F.coalesce(part(3), part(1))), F.coalesce(part(4), part(2)).cast("int")
    start = _iso(year, m1, d1)
    return F.struct(start.alias("start"), F.coalesce(_iso(year + (m2 < m1).cast("int"), m2, d2), start).alias("end"))
