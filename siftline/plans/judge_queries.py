"""Judging records: gates, page classes, verification, scores, cities, missing facts, over rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import dates, text
from siftline.functions.stages import held
from siftline.operators import judge, rules
from siftline.operators.judge import Preferences

from .scenario import expected, over_orders, tallied

_BASE = {
    "name": "Toronto AI Hackathon", "source": "devpost", "official_url": "https://hack.example.org/", "apply_url": "https://hack.example.org/apply", "event_start_date": "2026-09-05",
    "event_end_date": "2026-09-06", "start_date": "2026-09-05", "end_date": "2026-09-06", "deadline": "2026-08-20", "city": "Toronto", "country": "Canada", "mode": "in-person",
    "themes": ["AI"], "description": "Build with AI", "evidence": [],
}
_UNDATED = {"event_start_date": None, "event_end_date": None, "start_date": None, "end_date": None, "deadline": None}
_NOWHERE = {"city": None, "country": None, "mode": None}


def _now():
    return F.lit("2026-07-16 12:00:00").cast("timestamp_ntz")


def _today():
    return F.lit("2026-07-16")


def event(**changes) -> tuple:
    """A record like the base one with some fields changed."""
    fields = _BASE | changes
    return tuple(fields.get(c) for c in judge.COLUMNS)


def _past(first: str, last: str) -> dict:
    return {"event_start_date": first, "event_end_date": last, "start_date": first, "end_date": last, "deadline": None}


OK = "Passed hard eligibility"
#: (preferences, record, eligible, needs review, reasons)
GATES = [
    (Preferences(), event(), True, False, OK),
    (Preferences(), event(deadline="2026-07-15"), False, False, "Registration/application deadline has passed"),
    (Preferences(), event(deadline="2026-07-16"), True, False, OK),
    (Preferences(), event(registration_deadline="2026-07-01", deadline="2026-12-01"), False, False, "Registration/application deadline has passed"),
    (Preferences(), event(**_past("2026-07-09", "2026-07-10")), False, False, "Event already ended"),
    (Preferences(), event(**_past("2026-07-09", "2026-07-16")), True, False, OK),
    (Preferences(), event(**_UNDATED), True, True, f"Event date unclear;{OK}"),
    (Preferences(), event(name="Toronto AI Hackathon 2024", **_UNDATED), False, False, "Title year is in the past without a verified current edition"),
    (Preferences(), event(name="Toronto AI Hackathon 2024"), True, False, OK),
    (Preferences(), event(official_url=None, apply_url=None), True, True, "No official/apply URL"),
    (Preferences(strict=True), event(official_url=None, apply_url=None), False, False, "No useful official or apply URL"),
    (Preferences(), event(name="AI Meetup", description=None), False, False, "Candidate is not a hackathon or hackathon-like competition"),
    (Preferences(), event(name="Agent Challenge", description="Build software"), True, False, OK),
    (Preferences(), event(name="Pie Contest", description="Bring a pie", themes=[]), False, False, "Candidate is not a hackathon or hackathon-like competition"),
    (Preferences(), event(name="Hackathon Workshop"), True, False, OK),
    (Preferences(), event(name="Top 50 hackers", description="hackathon"), False, False, "Candidate is not a hackathon or hackathon-like competition"),
    (Preferences(themes=("AI",)), event(name="Robot Hackathon", description="metal", themes=["robots"]), False, False, "Theme does not match requested topics"),
    (Preferences(themes=("AI",)), event(name="Chain Hackathon", description=None, themes=["blocks"]), True, False, OK),
    (Preferences(onsite_only=True), event(mode="online"), False, False, "Onsite-only query requires a physical event"),
    (Preferences(date_from="2026-08-01", date_to="2026-08-31"), event(), False, False, "Event date falls outside the requested range"),
    (Preferences(date_from="2026-09-06"), event(), True, False, OK),
    (Preferences(date_from="2026-08-01"), event(**_UNDATED), True, True, f"Event date unclear;Event date unknown after enrichment;{OK}"),
    (Preferences(locations=("Paris",)), event(), True, True, "Outside requested geography"),
    (Preferences(locations=("Paris",), strict=True), event(), False, False, "Location does not match requested regions and event is not remote"),
    (Preferences(locations=("Paris",)), event(mode="online"), True, False, OK),
    (Preferences(remote="only"), event(), False, False, "Remote-only query requires remote participation"),
    (Preferences(remote="exclude"), event(mode="online"), False, False, "Remote events excluded by onsite-only policy"),
]
_CITY = Preferences(command="hackathons in Toronto", locations=("Toronto",), constraint="event_location", remote="exclude", include_remote=False)
_CANADA = Preferences(command="for Canadians", locations=("Canada",), constraint="participant_eligibility")
GATES += [
    (_CITY, event(), True, False, OK),
    (_CITY, event(mode="online"), False, False, "Remote-only event was not requested for this city query"),
    (_CITY, event(city="Mississauga"), False, False, "Greater Toronto Area location match"),
    (_CITY, event(city="Waterloo"), False, False, "Ontario nearby location for explicit Toronto query"),
    (_CITY, event(city="Berlin", country="Germany"), False, False, "Location mismatch for explicit toronto query"),
    (_CITY, event(**_NOWHERE), False, False, "Location unclear for explicit city query"),
    (_CANADA, event(eligibility="Open to all students", country="Germany", city="Berlin"), True, False, OK),
    (_CANADA, event(mode="online", city=None, country="Germany", description="hackathon"), True, True, f"Remote eligibility for Canada unclear;{OK}"),
    (_CANADA, event(country="Germany", city="Berlin", eligibility="Berliners"), False, False, "Participant eligibility does not include Canada"),
]


def _by_preference(spark: SparkSession, sf_dir: str, cases: list[tuple], outcomes) -> DataFrame:
    """Each group of cases is judged by one asker's preferences, all of them in one scan."""
    df = judge.prepared(over_orders(spark, sf_dir, [c[1] for c in cases], judge.EVENT), _now())
    groups: dict[Preferences, list[int]] = {}
    for i, c in enumerate(cases):
        groups.setdefault(c[0], []).append(i)
    said = None
    for wants, numbers in groups.items():
        mine, row = F.col("case_no").isin(numbers), F.struct(*[c.alias(name) for name, c in outcomes(wants).items()])
        said = F.when(mine, row) if said is None else said.when(mine, row)
    return held(df, out=said).groupBy("case_no", "out").agg(F.count(F.lit(1)).alias("n")).select("case_no", "out.*", "n")


def f1_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard gates, first rejection wins."""
    def outcomes(wants):
        gate = judge.eligibility(wants)
        return {"eligible": gate["eligible"], "needs_review": gate["needs_review"], "reasons": F.array_join(gate["reasons"], ";")}

    return _by_preference(spark, sf_dir, GATES, outcomes)


_FR = Preferences(command="find in san francisco", remote="include")
#: (preferences, record, status, eligible, needs review)
CITIES = [
    (Preferences(command="anything"), event(), "UNKNOWN", True, False),
    (Preferences(command="in toronto"), event(), "EXACT_MATCH", True, False),
    (Preferences(command="in toronto"), event(city="Markham"), "GTA_MATCH", False, True),
    (Preferences(command="in the GTA"), event(city="Markham"), "GTA_MATCH", True, False),
    (Preferences(command="in toronto"), event(city="Ottawa"), "ONTARIO_NEARBY", False, False),
    (Preferences(command="in toronto"), event(mode="online"), "VIRTUAL", False, False),
    (Preferences(command="in toronto"), event(city="Rome", country="Italy"), "MISMATCH", False, False),
    (Preferences(command="in toronto"), event(**_NOWHERE), "UNKNOWN", False, True),
    (Preferences(command="near waterloo"), event(city="Waterloo"), "EXACT_MATCH", True, False),
    (Preferences(command="near waterloo"), event(city="Kitchener"), "ONTARIO_NEARBY", True, True),
    (Preferences(command="mississauga"), event(city="Toronto"), "GTA_MATCH", True, True),
    (_FR, event(city="San Francisco", country="USA"), "EXACT_MATCH", True, False),
    (_FR, event(city=None, country="California"), "MISMATCH", False, False),
    (_FR, event(mode="online"), "VIRTUAL", True, False),
]


def f7_place_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    def outcomes(wants):
        match = judge.city_match(wants)
        return {"status": match["status"], "eligible": match["eligible"], "needs_review": match["needs_review"]}

    return _by_preference(spark, sf_dir, CITIES, outcomes)


#: (preferences, record, score, rejected, why)
SCORES = [
    (Preferences(), event(), 40 + 10 + 10 + 8 + 5, False, "Eligible individual event;Has apply URL;Has official URL;Authoritative source;Toronto/Waterloo proximity"),
    (Preferences(locations=("Toronto",), themes=("AI",)), event(prize="$100", eligibility="Students only"), 100, False, "Eligible individual event;Matches preferred location;Matches 1 preferred theme(s);Has apply URL;Has official URL;Prize or sponsor listed;Student-friendly eligibility;Authoritative source;Toronto/Waterloo proximity"),
    (Preferences(), event(source="x", city="Rome", country="Italy", apply_url=None, **_UNDATED), 40 + 10 - 10, False, "Eligible individual event;Has official URL"),
    (Preferences(themes=("a", "i", "b", "u")), event(source="web", city="Rome", country="Italy"), 40 + 30 + 20, False, "Eligible individual event;Matches 4 preferred theme(s);Has apply URL;Has official URL"),
    (Preferences(), event(mode="online", source="web", city=None, country=None), 40 + 20 + 20, False, "Eligible individual event;Remote/online event;Has apply URL;Has official URL"),
    (Preferences(), event(deadline="2026-07-15"), 0, True, "Registration/application deadline has passed"),
]


def r3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final scores: ranked where the gates let a record through, else 0 with the reason."""
    def outcomes(wants):
        s = judge.scored(judge.eligibility(wants), judge.ranked(wants))
        return {"score": s["score"], "rejected": s["rejected"], "why": F.array_join(s["why_match"], ";")}

    return _by_preference(spark, sf_dir, SCORES, outcomes)


#: (url, title, body, dated, placed, applies), then class, confidence, signals
PAGES = [
    (("https://mlh.io/events", "Events", None, False, False, False), ("EVENT_DIRECTORY", "high", 1)),
    (("https://a.example/x", "Hackathon directory", "all", False, False, False), ("EVENT_DIRECTORY", "high", 2)),
    (("https://a.example/x", "Good Thing", "See upcoming hackathons", False, False, False), ("EVENT_DIRECTORY", "high", 3)),
    (("https://lu.ma/discover", "Good Thing", None, False, False, False), ("EVENT_DIRECTORY", "high", 2)),
    (("https://www.facebook.com/", "Facebook", None, False, False, False), ("UNCERTAIN", "high", 2)),
    (("https://www.linkedin.com/in/some", "Some Person", None, False, False, False), ("UNCERTAIN", "high", 2)),
    (("https://a.example/x", "How to win at length", "tips for all", False, False, False), ("ARTICLE", "high", 3)),
    (("https://a.example/x", "Acme Corp", "About us and careers", False, False, False), ("ORGANIZATION_PAGE", "medium", 3)),
    (("https://a.example/x", "Acme Jam", "Winners announced yesterday", False, False, False), ("HISTORICAL_EVENT", "medium", 3)),
    (("https://a.example/x", "Acme Jam", "Winners announced; register for more", False, False, False), ("INDIVIDUAL_EVENT", "medium", 4)),
    (("https://a.example/x", "Acme Jam 2026", "Register online", True, True, True), ("INDIVIDUAL_EVENT", "high", 6)),
    (("https://a.example/x", "Acme Jam 2026", "words", False, False, False), ("INDIVIDUAL_EVENT", "medium", 3)),
    (("https://a.example/x", "Jam", "words", False, False, False), ("UNCERTAIN", "low", 2)),
    ((None, None, None, False, False, False), ("UNCERTAIN", "low", 0)),
    (("https://a.example/x", "hackathon", "Register in Toronto", True, False, False), ("UNCERTAIN", "low", 5)),
]


def f13_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [c[0] for c in PAGES], "url string, title string, body string, dated boolean, placed boolean, applies boolean")
    kind = judge.page_class(F.col("url"), F.col("title"), F.col("body"), F.col("dated"), F.col("placed"), F.col("applies"))
    return tallied(df, **{"class": kind["class"], "confidence": kind["confidence"], "signals": kind["signals"]})


#: record, then status, confidence, first reason, red flags
CHECKS = [
    (event(), ("accepted", "high", "Official URL present", "")),
    (event(name="  "), ("rejected", "low", "Missing event name", "Missing event name")),
    (event(deadline="2026-07-15"), ("rejected", "high", "Registration deadline has passed", "Registration closed")),
    (event(**_past("2026-07-01", "2026-07-02")), ("rejected", "high", "Event already ended", "Event already ended")),
    (event(name="Jam 2023", **_UNDATED), ("rejected", "high", "Title year is in the past without a verified current edition", "Stale title year")),
    (event(official_url=None, apply_url=None), ("rejected", "low", "No official, apply, or social URL", "No useful URL")),
    (event(official_url=None, apply_url=None, social_url="https://x.com/a/status/1"), ("needs_review", "low", "Social-only lead without official page", "Needs official link")),
    (event(**_UNDATED), ("accepted", "medium", "Official URL present", "Date unclear;Applications close: Unknown;Event date unclear")),
    (event(official_url=None), ("accepted", "medium", "Apply URL present", "")),
    (event(deadline="sometime"), ("accepted", "high", "Official URL present", "Applications close: Unknown")),
]


def f15_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judge.prepared(over_orders(spark, sf_dir, [c[0] for c in CHECKS], judge.EVENT), _now())
    df, check = held(df, check=judge.verified()), F.col("check")
    return tallied(df, status=check["status"], confidence=check["confidence"], reason=check["reasons"][0], red_flags=F.array_join(check["red_flags"], ";"))


#: red flags and the record, then the reasons for a review
REVIEWS = [
    ("", event(), ""), ("Applications close: Unknown", event(), ""), ("Event date unclear", event(apply_url=None), "Event date unclear;Application URL missing or unclear"),
    ("", event(official_url=None, **_UNDATED), "Event date unclear;Official URL missing or unclear"), ("a;a;Applications close: Unknown", event(), "a"),
]


def f16_review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(*e, flags) for flags, e, _ in REVIEWS], judge.EVENT + ", flags string")
    flags = F.filter(F.split("flags", ";"), lambda x: x != "")
    return tallied(df, reasons=F.array_join(judge.review_reasons(flags), ";"))


#: reason, whether it stands whatever the review policy
HARD = [
    ("Registration deadline has passed", True), ("Registration closed", True), ("Event already ended", True), ("Title year is in the past without", True), ("No useful URL", False), ("Theme does not match", False), (None, False),
]


def f17_hard_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(r,) for r, _ in HARD], "reason string")
    return tallied(df, hard=judge.hard_invalid(F.col("reason")))


#: (preferences, record, status, score, class)
OUTCOMES = [
    (Preferences(), event(), "NEW", 73, "INDIVIDUAL_EVENT"),
    (Preferences(), event(apply_url=None), "NEEDS_REVIEW", 63, "INDIVIDUAL_EVENT"),
    (Preferences(strict=True), event(apply_url=None), "NEW", 63, "INDIVIDUAL_EVENT"),
    (Preferences(), event(deadline="2026-07-15"), "REJECTED", 0, "INDIVIDUAL_EVENT"),
    (Preferences(), event(name="Hackathon directory"), "REJECTED", 0, "EVENT_DIRECTORY"),
    (Preferences(), event(name="Hackathon", source="x"), "NEEDS_REVIEW", 0, "UNCERTAIN"),
]


def f14_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole judgement: gates, class, verification and score to a queue status."""
    df = over_orders(spark, sf_dir, [c[1] for c in OUTCOMES], judge.EVENT)
    parts = []
    for wants in dict.fromkeys(c[0] for c in OUTCOMES):
        numbers = [i for i, c in enumerate(OUTCOMES) if c[0] == wants]
        out = judge.judged(df.filter(F.col("case_no").isin(numbers)), wants, _now())
        parts.append(tallied(out, **{c: F.col(c) for c in ("status", "score", "class")}))
    return reduce(lambda a, b: a.unionByName(b), parts)


_ASKS = Preferences(themes=("AI",), include_remote=False)
#: record, then its missing facts as kind:priority
FACTS = [
    (event(prize="x", eligibility="y"), ""),
    (event(official_url=None, apply_url=None, prize="x", eligibility="y"), "officialUrl:high,applyUrl:high"),
    (event(deadline=None, prize="x", eligibility="y"), "deadline:medium"),
    (event(prize="x", eligibility="y", **_UNDATED), "deadline:high"),
    (event(prize="x", eligibility="y", **_NOWHERE), "location:medium,mode:medium"),
    (event(mode="unknown"), "mode:medium,eligibility:low,prize:low"),
    (event(mode="online", city=None, prize="x", themes=[]), "eligibility:low,themes:low"),
]


def f30_missing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [c[0] for c in FACTS], judge.EVENT)
    named = F.transform(judge.missing_facts(_ASKS), lambda x: F.concat(x["kind"], F.lit(":"), x["priority"]))
    return tallied(df, missing=F.array_join(named, ","))


#: message, category
FAILURES = [
    ("Search provider not configured", "missing_api_key"), ("HTTP 429 Too Many Requests", "rate_limit"), ("403 Forbidden", "anti_bot"), ("connect ETIMEDOUT 1.2.3.4", "network"),
    ("Executable doesn't exist", "browser_missing"), ("No browser profile found", "profile_missing"), ("Session expired, please sign in", "session_expired"), ("Login required", "auth_required"),
    ("Parse failed: ui may have changed", "selector_parser_failure"), ("No upcoming events", "no_current_events"), ("Search returned no matches", "zero_matching_results"), ("odd", None), ("", None),
    ("socket closed after rate limit", "rate_limit"), ("no results", "zero_matching_results"),
]


def f27_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(m,) for m, _ in FAILURES], "message string")
    return tallied(df, category=rules.failure_category(F.col("message")))


#: (leads, errors, warnings, is signed in), then status and category
HEALTH = [
    ((3, None, None, True), ("healthy", None)), ((3, None, "selector missing", True), ("degraded", "selector_parser_failure")), ((3, None, "slow", True), ("healthy", None)),
    ((0, "rate limit hit", None, True), ("degraded", "rate_limit")), ((0, "login required", None, True), ("auth_required", "auth_required")), ((0, "not configured", None, True), ("unconfigured", "missing_api_key")),
    ((5, "boom", None, True), ("failed", "unknown")), ((0, None, None, True), ("degraded", "zero_matching_results")), ((0, None, "sign in again, session expired", False), ("auth_required", "session_expired")),
    ((0, None, "no upcoming events", True), ("degraded", "no_current_events")), ((0, None, "dns down", True), ("degraded", "network")), ((0, None, "what", True), ("degraded", "zero_matching_results")),
]


def x40_source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of a source from what its scan returned and complained about."""
    df = over_orders(spark, sf_dir, [c[0] for c in HEALTH], "leads int, errors string, warnings string, signed_in boolean")
    health = rules.source_health(F.col("leads"), F.col("errors"), F.col("warnings"), F.col("signed_in"))
    return tallied(df, status=health["status"], category=health["category"])


#: status, actions
ACTIONS = [
    ("NEW", "approve,save,reject"), ("NEEDS_REVIEW", "approve,save,reject"), ("APPROVED", "reject,save,restore"), ("REJECTED", "approve,save,restore"),
    ("SAVED_FOR_LATER", "approve,reject,unsave,restore"), ("EXPIRED", "restore"), ("DUPLICATE", "restore"),
]


def f35_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(s,) for s, _ in ACTIONS], "status string")
    return tallied(df, actions=F.array_join(rules.allowed_actions(F.col("status")), ","))


#: text, then kind=value of every mined date
DATES = [
    ("Registration opens: June 1, 2026", "registration_open=2026-06-01"), ("Registration closes: July 1, 2026", "registration_deadline=2026-07-01"),
    ("Hackathon dates: July 4, 2026", "event_start=2026-07-04"), ("Judging starts: 2026-08-02", "event_start=2026-08-02,judging_start=2026-08-02"),
    ("submissions open Aug 1 2026; submission deadline - Aug 9 2026", "submission_deadline=2026-08-09,submission_open=2026-08-01"),
    ("Hacking period: July 4 - 6, 2026", "event_start=2026-07-04,event_end=2026-07-06"), ("Event date: Aug 30 to Sep 2, 2026", "event_start=2026-08-30,event_end=2026-09-02"),
    ("5 days left to register", "registration_deadline=2026-07-21"), ("5 days left", ""), ("Register by: 3 days left", "registration_deadline=2026-07-19,registration_deadline=2026-07-19"),
    ("Winners announced: Smarch 5, 2026", "result_announcement=smarch 5 2026"), ("On July 4, 2026 we party", ""), (None, ""),
    ("Judging ends Aug 3, 2026. Results announced Aug 4, 2026", "judging_end=2026-08-03,result_announcement=2026-08-04"),
]


def p10_date_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled dates, ranges and days left."""
    df = over_orders(spark, sf_dir, [(t,) for t, _ in DATES], "body string")
    found = F.coalesce(dates.mined(F.col("body"), _today()), F.array().cast("array<struct<kind:string,value:string,confidence:string,source_text:string>>"))
    return tallied(df, found=F.array_join(F.transform(found, lambda x: F.concat(x["kind"], F.lit("="), x["value"])), ","))


#: text, then start, end and deadline
DAYS = [
    ("Starts: 2026-09-01. Apply by: Aug 1, 2026", ("2026-09-01", "2026-09-01", "2026-08-01")), ("Event date: Aug 30 to Sep 2, 2026", ("2026-08-30", "2026-09-02", None)),
    ("Register by Aug 2, 2026, apply by Aug 3, 2026", (None, None, "2026-08-02")), ("nothing", (None, None, None)),
]


def p12_days_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(t,) for t, _ in DAYS], "body string")
    df = held(df, found=dates.mined(F.col("body"), _today()))
    days = dates.parsed_days(F.col("found"))
    return tallied(df, first_day=days["start"], last_day=days["end"], deadline=days["deadline"])


#: shown range, then start and end
RANGES = [
    ("Jul 1 - Aug 15, 2026", ("2026-07-01", "2026-08-15")), ("Dec 30, 2025 – Jan 2, 2026", ("2025-12-30", "2026-01-02")), ("March 3 to 5", ("2026-03-03", "2026-03-05")),
    ("Jul 1, 2027 - Aug 2", ("2027-07-01", "2027-08-02")), ("soon", (None, None)), ("Feb 30 - 31, 2026", (None, None)),
]


def p13_displayed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(t,) for t, _ in RANGES], "body string")
    days = dates.displayed_range(F.col("body"), F.lit(2026))
    return tallied(df, first_day=days["start"], last_day=days["end"])


SEASONS = [
    ("Dec 30th - Jan 2nd", ("2026-12-30", "2027-01-02")), ("Mar 3 - 5", ("2026-03-03", "2026-03-05")), ("October 9th", ("2026-10-09", "2026-10-09")), ("tba", (None, None)),
]


def p14_season_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(t,) for t, _ in SEASONS], "body string")
    days = dates.season_range(F.col("body"), F.lit(2026))
    return tallied(df, first_day=days["start"], last_day=days["end"])


MONTH_DAYS = [("Sept 5 - 7, 2027", ("2027-09-05", "2027-09-07")), ("on Jan. 9", ("2026-01-09", None)), ("May 1–3", ("2026-05-01", "2026-05-03")), ("9 Mai", (None, None))]


def p15_month_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(t,) for t, _ in MONTH_DAYS], "body string")
    days = dates.month_day_range(F.col("body"), F.lit(2026))
    return tallied(df, first_day=days["start"], last_day=days["end"])


#: heading, day (2026-07-16 is a Thursday)
HEADINGS = [
    ("Today", "2026-07-16"), (" tomorrow ", "2026-07-17"), ("This  weekend", "2026-07-18"), ("Thursday", "2026-07-16"), ("wed", "2026-07-22"), ("Sunday", "2026-07-19"),
    ("Jul 20", "2026-07-20"), ("Jul 15", "2026-07-15"), ("Jul 1", "2027-07-01"), ("July 1, 2026", "2026-07-01"), ("Soon", None), (None, None),
]


def p16_heading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(t,) for t, _ in HEADINGS], "body string")
    return tallied(df, found=dates.heading_day(F.col("body"), _today()))


STAMPS = [
    ("1784203200", "2026-07-16 12:00:00"), ("1784203200000", "2026-07-16 12:00:00"), ("on 2026-07-16 or so", "2026-07-16 00:00:00"), ("2026-07-16T09:30:00Z", "2026-07-16 09:30:00"),
    ("July 4, 2026 at noon", "2026-07-04 00:00:00"), ("12", None), ("later", None), (None, None),
]


def p17_dateish(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(t,) for t, _ in STAMPS], "body string")
    return tallied(df, found=F.date_format(dates.dateish(F.col("body")), "yyyy-MM-dd HH:mm:ss"))


PARTS = [("2026-07-16T10:00", "2026-07-16"), ("July 4, 2026", "2026-07-04"), ("Sometime in Fall!", "sometime in fall"), (" -- ", None), (None, None)]


def c10_date_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [(t,) for t, _ in PARTS], "body string")
    return tallied(df, found=dates.date_part(F.col("body")))


#: (location, city, country), zone
ZONES = [
    (("Waterloo ON", None, None), "America/Toronto"), ((None, None, "Canada"), "America/Toronto"), ((None, "Bilaspur", None), "Asia/Kolkata"), ((None, "Rome", "Italy"), "UTC"), ((None, None, None), "UTC"),
]


def x2_time_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [z for z, _ in ZONES], "location string, city string, country string")
    return tallied(df, zone=dates.zone_of(F.col("location"), F.col("city"), F.col("country")))


TEXTS = [
    ("An AI agent for cloud fintech", ("AI,agents,cloud,fintech", None, None)), ("Online and in-person in Toronto", ("", "hybrid", "Toronto|Ontario|Canada")),
    ("Virtual healthcare day", ("healthcare", "online", "Remote||Online")), ("On-site at New York; web3 developer tools", ("web3,developer tools", "in-person", "New York||USA")),
    ("hybrid maid service in Canada", ("", "hybrid", "||Canada")), ("plain", ("", None, None)),
]


def p6_text_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes, mode and place that a text tells, by the tables of words."""
    df = over_orders(spark, sf_dir, [(t,) for t, _ in TEXTS], "body string")
    place = text.place_of(F.col("body"))
    said = F.when(place.isNotNull(), F.concat_ws("|", *[F.coalesce(place[f], F.lit("")) for f in ("city", "region", "country")]))
    return tallied(df, themes=F.array_join(text.themes_of(F.col("body")), ","), mode=text.mode_of(F.col("body")), place=said)


QUERIES = {f.__name__: f for f in (
    f1_eligibility, f7_place_constraint, r3_scores, f13_classify, f15_verify, f16_review_reasons, f17_hard_invalid, f14_outcomes, f30_missing_facts, f27_failures, x40_source_health, f35_actions,
    p10_date_mining, p12_days_from_text, p13_displayed_range, p14_season_range, p15_month_day_range, p16_heading_day, p17_dateish, c10_date_part, x2_time_zone, p6_text_facts,
)}

_TWO = ["first_day", "last_day"]
ORACLES = {
    "f1_eligibility": expected(["eligible", "needs_review", "reasons"], [c[2:] for c in GATES]),
    "f7_place_constraint": expected(["status", "eligible", "needs_review"], [c[2:] for c in CITIES]),
    "r3_scores": expected(["score", "rejected", "why"], [c[2:] for c in SCORES]),
    "f13_classify": expected(["class", "confidence", "signals"], [c[1] for c in PAGES]),
    "f15_verify": expected(["status", "confidence", "reason", "red_flags"], [c[1] for c in CHECKS]),
    "f16_review_reasons": expected(["reasons"], [(c[2],) for c in REVIEWS]),
    "f17_hard_invalid": expected(["hard"], [(c[1],) for c in HARD]),
    "f14_outcomes": expected(["status", "score", "class"], [c[2:] for c in OUTCOMES]),
    "f30_missing_facts": expected(["missing"], [(c[1],) for c in FACTS]),
    "f27_failures": expected(["category"], [(c[1],) for c in FAILURES]),
    "x40_source_health": expected(["status", "category"], [c[1] for c in HEALTH]),
    "f35_actions": expected(["actions"], [(c[1],) for c in ACTIONS]),
    "p10_date_mining": expected(["found"], [(c[1],) for c in DATES]),
    "p12_days_from_text": expected([*_TWO, "deadline"], [c[1] for c in DAYS]),
    "p13_displayed_range": expected(_TWO, [c[1] for c in RANGES]),
    "p14_season_range": expected(_TWO, [c[1] for c in SEASONS]),
    "p15_month_day_range": expected(_TWO, [c[1] for c in MONTH_DAYS]),
    "p16_heading_day": expected(["found"], [(c[1],) for c in HEADINGS]),
    "p17_dateish": expected(["found"], [(c[1],) for c in STAMPS]),
    "c10_date_part": expected(["found"], [(c[1],) for c in PARTS]),
    "x2_time_zone": expected(["zone"], [(c[1],) for c in ZONES]),
    "p6_text_facts": expected(["themes", "mode", "place"], [c[1] for c in TEXTS]),
}
