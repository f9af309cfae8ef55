"""Judging event records: page classes, verification, eligibility, and the score they lead to.

Every rule is a CASE over columns of the record; what the asker wants is a
``Preferences`` value known on the driver, so its tests fold into constants.
Rules stand in order of precedence: the first that holds decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import dates, keys, text, urls
from siftline.functions.stages import held
from siftline.functions.text import normalize_text, word

from .rules import clamp

#: The columns of an event record.
EVENT = (
    "name string, source string, official_url string, apply_url string, social_url string, event_start_date string, event_end_date string, "
    "registration_deadline string, application_deadline string, start_date string, end_date string, deadline string, location string, mode string, "
    "city string, region string, country string, location_mode string, location_text string, prize string, themes array<string>, eligibility string, "
    "description string, evidence array<struct<type:string,url:string,title:string,snippet:string>>"
)
COLUMNS = [f.split()[0] for f in EVENT.split(", ")]


@dataclass(frozen=True)
class Preferences:
    """What is asked for.  constraint: none, event_location or participant_eligibility; remote: include, exclude or only."""

    command: str = ""
    locations: tuple[str, ...] = ()
    themes: tuple[str, ...] = ()
    constraint: str = "none"
    remote: str | None = None
    include_remote: bool = True
    onsite_only: bool = False
    date_from: str | None = None
    date_to: str | None = None
    strict: bool = False
    wanted: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        object.__setattr__(self, "wanted", tuple(_plain(x) for x in self.locations))

    @property
    def remote_policy(self) -> str:
        return self.remote or ("include" if self.include_remote else "exclude")


def _plain(s: str) -> str:
    import re

    return re.sub(r"[^a-z0-9]+", " ", s.lower().replace("https://", "").replace("http://", "").replace("www.", "")).strip()


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _has(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def _list(*items: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(v)) for c, v in items]))


def _first(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = None
    for condition, value in rules:
        out = F.when(_yes(condition), value) if out is None else out.when(_yes(condition), value)
    return otherwise if out is None else out.otherwise(otherwise)


# ---- what a record says

def application_deadline() -> Column:
    return F.coalesce("registration_deadline", "application_deadline", "deadline")


def event_start() -> Column:
    return F.coalesce("event_start_date", "start_date")


def event_end() -> Column:
    return F.coalesce("event_end_date", "end_date", "event_start_date", "start_date")


def prepared(events: DataFrame, now: Column) -> DataFrame:
    """Events with what the rules ask more than once, each worked out once: canonical texts, days, and the state at `now`.

    Every rule below reads these columns, so its own expression stays small.
    """
    evidence = F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["title"], e["snippet"])), " ")
    out = held(
        events,
        __words=normalize_text(F.concat_ws(" ", "location", "city", "region", "country", "mode", "location_text", "location_mode")),
        __place=normalize_text(F.concat_ws(" ", "location", "city", "country", "mode")), __title=normalize_text(F.col("name")), __said=normalize_text(F.concat_ws(" ", "name", "description")),
        __intent=normalize_text(F.concat_ws(" ", "name", "description", F.array_join("themes", " "), evidence)),
        __open_to=normalize_text(F.concat_ws(" ", "eligibility", "description", "location", "country")),
        __themes=F.transform(F.coalesce("themes", F.array().cast("array<string>")), normalize_text),
        __due=dates.day_of(application_deadline()), __start=dates.day_of(event_start()), __end=dates.day_of(F.coalesce(event_end(), event_start())),
        __today=dates.today_in(now, dates.zone_of(F.col("location"), F.col("city"), F.col("country"))),
    )
    years = [F.col(c) for c in ("event_start_date", "event_end_date", "start_date", "end_date", "registration_deadline", "application_deadline", "deadline")]
    said = F.col("__words")
    return held(
        out,
        # the last day belongs to the event
        __status=F.when(F.col("__start").isNull() | F.col("__end").isNull(), "UNKNOWN").when(F.col("__end") < F.col("__today"), "FINISHED").when(F.col("__start") > F.col("__today"), "UPCOMING").otherwise("ONGOING"),
        __closed=_yes(F.col("__due") < F.date_format(now, "yyyy-MM-dd")), __stale=dates.stale_title_year(F.col("name"), years, F.year(now)),
        __remote=_yes(F.col("mode") == "online") | _yes(F.col("location_mode") == "remote") | said.rlike("remote|online|everywhere|worldwide"),
    )


def location_words() -> Column:
    return F.col("__words")


def is_remote() -> Column:
    return F.col("__remote")


def is_in_person() -> Column:
    return _yes(F.col("mode") == "in-person") | _yes(F.col("location_mode") == "in_person")


def in_place(wants: Preferences) -> Column:
    if not wants.locations:
        return F.lit(True)
    said = location_words()
    return text.any_of(*[said.contains(w) for w in wants.wanted if w] or [F.lit(False)])


def theme_matches(wants: Preferences) -> Column:
    """How many wanted themes the record has: either contains the other, or name and description contain it."""
    said = F.col("__said")
    found = [(F.exists("__themes", _either_holds(_plain(t))) | said.contains(_plain(t))).cast("int") for t in wants.themes]
    return sum(found, F.lit(0))


def _either_holds(theme: str):
    return lambda t: t.contains(theme) | F.lit(theme).contains(t)


#: Words of the events looked for, of contests, of building, and titles that are something else.
INTENT = "hackathon|hack day|hack night|buildathon|codeathon|datathon|ideathon|capture the flag|ctf|builders? sprint|build week"
CONTEST = "challenge|competition|contest"
BUILDING = "build|code|project|prototype|developer|engineering|ai|ml|agent|software|app|startup|cyber"
BARE_TITLE = r"^(?:facebook|instagram|linkedin|x|twitter|reddit|\d{4}[\s-]\d{2}[\s-]\d{2})$"
TOP_LIST = r"top\s+\d+\s+hackers?"
LEISURE = "dance party|rooftop party|mahjong|matcha|journal|journaling|fitness|yoga|walk|cafe|coffee chat"
GATHERING = "conference|meetup|workshop|webinar|talk|panel|demo day|build night"
CONTEST_TITLE = "hackathon|buildathon|codeathon|datathon|challenge|competition|contest"


def has_intent() -> Column:
    words = F.col("__intent")
    return words.rlike(word(INTENT)) | (words.rlike(word(CONTEST)) & words.rlike(word(BUILDING)))


def is_something_else() -> Column:
    title = F.col("__title")
    return title.rlike(BARE_TITLE) | title.rlike(word(TOP_LIST)) | title.rlike(word(LEISURE)) | (title.rlike(word(GATHERING)) & ~title.rlike(word(CONTEST_TITLE)))


def participants(wants: Preferences) -> Column:
    """(eligible, needs_review, reason): whether participants from the wanted country are let in."""
    def verdict(eligible, review, reason=None):
        return F.struct(F.lit(eligible).alias("eligible"), F.lit(review).alias("needs_review"), F.lit(reason).cast("string").alias("reason"))

    if wants.constraint != "participant_eligibility":
        return verdict(True, False)
    if "canada" not in wants.wanted and "canad" not in wants.command.lower():
        return verdict(True, True, "Participant eligibility unclear")
    said = F.col("__open_to")
    return _first(
        [
            (said.rlike(word("canada|canadian|global|worldwide|anywhere|open to all")), verdict(True, False)),
            (is_remote(), verdict(True, True, "Remote eligibility for Canada unclear")),
            ((F.col("country") == "Canada") | location_words().rlike(word("canada")), verdict(True, False)),
        ],
        verdict(False, False, "Participant eligibility does not include Canada"),
    )


# ---- explicit cities

#: A city asked for, the places that are it, near it, or too broad, with the status they give.
GTA = "toronto|mississauga|brampton|markham|scarborough|north york|etobicoke|vaughan|richmond hill|oakville|burlington|ajax|pickering|oshawa|greater toronto|gta"
NEAR_TORONTO = "waterloo|kitchener|hamilton|guelph|london|ottawa|ontario"
NEAR_WATERLOO = "kitchener|cambridge|guelph|kw|k-w|waterloo region"
SAN_FRANCISCO = r"san\s+francisco|bay\s+area|sf"
BROAD_US = r"california|united states|usa|u\.s\.a\.|u\.s\."
VIRTUAL = "online|virtual|remote|worldwide|global|anywhere"


def city_asked(command: str) -> str | None:
    """The city that a command names, if any."""
    import re

    if re.search(word("gta|greater toronto"), command):
        return "toronto"
    if re.search(word(r"san\s+francisco|sf\s+bay\s+area|bay\s+area|sf"), command):
        return "san francisco"
    return next((c for c in ("toronto", "waterloo", "mississauga") if re.search(word(c), command)), None)


def city_match(wants: Preferences) -> Column:
    """(status, eligible, needs_review, reason) of a record's place against the city asked for."""
    import re

    def verdict(status, eligible, review, reason):
        return F.struct(F.lit(status).alias("status"), F.lit(eligible).alias("eligible"), F.lit(review).alias("needs_review"), F.lit(reason).alias("reason"))

    city = city_asked(wants.command)
    if city is None:
        return verdict("UNKNOWN", True, False, "No explicit city constraint")
    said = F.col("__place")
    wide = bool(re.search(word("gta|greater toronto"), wants.command))
    unclear = verdict("UNKNOWN", False, True, "Location unclear for explicit city query")
    included = wants.remote == "include"
    rules = [
        (_yes(F.col("mode") == "online") | said.rlike(word(VIRTUAL)), verdict("VIRTUAL", included, False, "Virtual event included by explicit remote policy" if included else "Remote-only event was not requested for this city query")),
        ((said == "") | (said == "unknown") | said.contains("location unclear"), unclear),
    ]
    if city == "toronto":
        rules += [
            (said.rlike(word("toronto")), verdict("EXACT_MATCH", True, False, "Toronto location match")),
            (said.rlike(word(GTA)), verdict("GTA_MATCH", wide, not wide, "Greater Toronto Area location match")),
            (said.rlike(word(NEAR_TORONTO)) | (said.contains("canada") & said.contains("ontario")), verdict("ONTARIO_NEARBY", False, False, "Ontario nearby location for explicit Toronto query")),
        ]
    elif city == "waterloo":
        rules += [
            (said.rlike(word("waterloo")), verdict("EXACT_MATCH", True, False, "Waterloo location match")),
            (said.rlike(word(NEAR_WATERLOO)), verdict("ONTARIO_NEARBY", True, True, "Waterloo-region nearby location for explicit Waterloo query")),
        ]
    elif city == "mississauga":
        rules += [
            (said.rlike(word("mississauga")), verdict("EXACT_MATCH", True, False, "Mississauga location match")),
            (said.rlike(word(GTA)), verdict("GTA_MATCH", True, True, "GTA nearby location for explicit Mississauga query")),
        ]
    else:
        rules += [
            (said.rlike(word(SAN_FRANCISCO)), verdict("EXACT_MATCH", True, False, "San Francisco location match")),
            (said.rlike(word(BROAD_US)), verdict("MISMATCH", False, False, "Broad California/US location is not San Francisco")),
        ]
    concrete = (_has("location") | _has("city") | _has("country")) & ~said.contains("remote") & ~said.contains("online")
    rules.append((concrete, verdict("MISMATCH", False, False, f"Location mismatch for explicit {city} query")))
    return _first(rules, unclear)


# ---- page classes

#: What tells directories, articles, organisations and past events.
DIRECTORY_URL = urls.DIRECTORY + r"|lu\.ma/calendar/?|lu\.ma/discover/?"
DIRECTORY_TITLE = (
    word("hackathons?|events?") + ".*" + word("directory|listing|browse|search|category|categories|platform|upcoming|calendar") + "|" + word(r"events?\s+calendar|search results?|profiles?|portfolio")
    + "|" + word("major league hacking|ai hackathons|machine learning/ai") + "|" + word(r"on\s+devpost") + "|" + word(r"lablab\.ai")
)
MANY_EVENTS = "upcoming hackathons|featured hackathons|all hackathons|browse hackathons|hackathon calendar"
ARTICLE = r"what is a hackathon|how to (?:win|prepare)|tips for|recap|wrap[- ]?up|listicle|best hackathons of|top \d+ hackathons|wikipedia"
ORGANISATION = "about us|our mission|careers|company home|organization homepage"
HISTORICAL = "recap|winners? announced|completed|archives?|past event|previously held"
SOCIAL_TITLE = r"(?i)^(facebook|instagram|linkedin|x|twitter|devpost|luma|lu\.ma)$"
PROFILE_URL = (
    r"(?i)(^|\.)facebook\.com/?$|(^|\.)facebook\.com/(profile\.php|people|groups|pages|events|search)/?|(^|\.)instagram\.com/?$|(^|\.)linkedin\.com/?$"
    r"|(^|\.)linkedin\.com/(in|company|school|feed|search)/?|(^|\.)x\.com/?$|(^|\.)twitter\.com/?$|devpost\.com/[^/?#]+/?$|devpost\.com/software/[^/?#]+/?$"
)


def page_class(url: Column, title: Column, body: Column, dated: Column, place: Column, apply: Column) -> Column:
    """(class, confidence, signals) of a page.

    Directories, profiles, articles, organisations and past events are told first;
    the rest is a vote of six signals: a specific title, a date, a way to apply, a
    place or mode, an address, and a text.
    """
    title, said = F.coalesce(title, F.lit("")), F.concat_ws(" ", title, body)
    at = urls.host_path(url)
    trimmed = F.trim(title)
    specific = (F.length(trimmed) >= 6) & ~trimmed.rlike("(?i)^(hackathons?|events?|ai|ml|home)$") & ~(trimmed.rlike(DIRECTORY_TITLE) & ~trimmed.rlike(word(r"20\d{2}")))
    applies = _yes(apply) | said.rlike(word(r"apply|register|registration|sign\s*up"))
    placed = _yes(place) | F.coalesce(body, F.lit("")).rlike(word("online|remote|toronto|waterloo|canada|in[- ]?person"))
    dated = _yes(dated)
    social = trimmed.rlike(SOCIAL_TITLE) | (at.rlike(PROFILE_URL) & ~dated & ~said.rlike(word("hackathons?|apply|register|deadline")))
    signals = sum((c.cast("int") for c in (dated, applies, placed, F.coalesce(url, F.lit("")) != "", F.coalesce(body, F.lit("")) != "")), specific.cast("int"))

    def verdict(kind, confidence):
        return F.struct(F.lit(kind).alias("class"), F.lit(confidence).alias("confidence"), signals.alias("signals"))

    return _first(
        [
            (at.rlike(DIRECTORY_URL) | title.rlike(DIRECTORY_TITLE) | said.rlike(word(MANY_EVENTS)), verdict("EVENT_DIRECTORY", "high")),
            (social, verdict("UNCERTAIN", "high")),
            (said.rlike(word(ARTICLE)), verdict("ARTICLE", "high")),
            (said.rlike(word(ORGANISATION)) & ~dated, verdict("ORGANIZATION_PAGE", "medium")),
            (said.rlike(word(HISTORICAL)) & ~applies, verdict("HISTORICAL_EVENT", "medium")),
            ((signals >= 4) & specific & dated, verdict("INDIVIDUAL_EVENT", "high")),
            ((signals >= 3) & specific, verdict("INDIVIDUAL_EVENT", "medium")),
        ],
        verdict("UNCERTAIN", "low"),
    )


def event_class() -> Column:
    """The page class of an event record."""
    url = F.coalesce("official_url", "apply_url", "social_url")
    place = F.coalesce(F.col("location"), F.concat_ws(", ", "city", "country")) != ""
    return page_class(url, F.col("name"), F.col("description"), _has("start_date") | _has("end_date") | _has("deadline"), place | _has("mode"), _has("apply_url"))


# ---- verification

def verified() -> Column:
    """(status, confidence, reasons, red_flags) of a prepared record: rejected, needs_review or accepted."""
    status = F.col("__status")
    none = F.array().cast("array<string>")

    def verdict(state, confidence, reasons, flags):
        fixed = lambda x: x if isinstance(x, Column) else F.array(F.lit(x))
        confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(state).alias("status"), confidence.alias("confidence"), fixed(reasons).alias("reasons"), fixed(flags).alias("red_flags"))

    due, start = application_deadline(), event_start()
    flags = _list(
        (status == "UNKNOWN", "Date unclear"), (F.col("__due").isNull(), "Applications close: Unknown"), (F.col("__start").isNull(), "Event date unclear"),
    )
    reasons = _list((_has("official_url"), "Official URL present"), (_has("apply_url"), "Apply URL present"), (_has("city") | _has("country") | _has("mode"), "Location/mode present"))
    sure = F.when(_has("official_url") & _has("apply_url") & ((F.coalesce(due, F.lit("")) != "") | (F.coalesce(start, F.lit("")) != "")), "high").otherwise("medium")
    return _first(
        [
            (F.trim(F.coalesce("name", F.lit(""))) == "", verdict("rejected", "low", "Missing event name", "Missing event name")),
            (F.col("__closed"), verdict("rejected", "high", "Registration deadline has passed", "Registration closed")),
            (status == "FINISHED", verdict("rejected", "high", "Event already ended", "Event already ended")),
            (F.col("__stale"), verdict("rejected", "high", "Title year is in the past without a verified current edition", "Stale title year")),
            (~(_has("official_url") | _has("apply_url") | _has("social_url")), verdict("rejected", "low", "No official, apply, or social URL", "No useful URL")),
            (_has("social_url") & ~_has("official_url") & ~_has("apply_url"), verdict("needs_review", "low", "Social-only lead without official page", "Needs official link")),
        ],
        verdict("accepted", sure, F.coalesce(reasons, none), F.coalesce(flags, none)),
    )


# ---- eligibility and score

def eligibility(wants: Preferences) -> Column:
    """(eligible, needs_review, reasons, rejection) of a prepared record: the hard gates in order."""
    status, part = F.col("__status"), participants(wants)

    def verdict(eligible, review, reasons, rejection=None):
        review = review if isinstance(review, Column) else F.lit(review)
        return F.struct(F.lit(eligible).alias("eligible"), review.alias("needs_review"), reasons.alias("reasons"), (F.lit(None) if rejection is None else rejection).cast("string").alias("rejection"))

    def reject(reason):
        reason = reason if isinstance(reason, Column) else F.lit(reason)
        return verdict(False, False, F.array(reason), reason)

    unclear = [F.when(status == "UNKNOWN", "Event date unclear"), F.when(part["eligible"] & part["needs_review"], part["reason"])]
    rules = [
        (F.col("__closed"), reject("Registration/application deadline has passed")),
        (status == "FINISHED", reject("Event already ended")),
        (F.col("__stale"), reject("Title year is in the past without a verified current edition")),
        (~(_has("official_url") | _has("apply_url")), reject("No useful official or apply URL") if wants.strict else verdict(True, True, F.array(F.lit("No official/apply URL")))),
        (is_something_else() | ~has_intent(), reject("Candidate is not a hackathon or hackathon-like competition")),
    ]
    if wants.themes:
        rules.append((theme_matches(wants) == 0, reject("Theme does not match requested topics")))
    rules.append((~part["eligible"], reject(part["reason"])))
    if wants.onsite_only:
        rules.append((~is_in_person(), reject("Onsite-only query requires a physical event")))
    remote, policy = is_remote(), wants.remote_policy
    if wants.constraint == "event_location":
        allowed = remote if policy == "include" else F.lit(False)
        if policy == "exclude":
            rules.append((remote, reject("Remote-only event was not requested for this city query")))
        if city_asked(wants.command):
            city = city_match(wants)
            # GTA_MATCH may need review without being eligible: eligibility decides first
            rules.append((~city["eligible"] & ~allowed, reject(city["reason"])))
            unclear.append(F.when(city["needs_review"] & ~allowed, city["reason"]))
        else:
            nowhere = ~_has("location") & ~_has("city") & ~_has("country")
            rules.append((~allowed & ~in_place(wants) & ~nowhere, reject("Location does not match requested regions and event is not remote")))
            unclear.append(F.when(~allowed & ~in_place(wants) & nowhere, "Location unclear for requested event-location query"))
    elif policy == "only":
        rules.append((~remote, reject("Remote-only query requires remote participation")))
        if wants.constraint == "none":
            rules += _geography(wants, remote, unclear, verdict, reject)
    elif wants.constraint == "none" and policy == "exclude":
        rules.append((remote, reject("Remote events excluded by onsite-only policy")))
        rules += _geography(wants, remote, unclear, verdict, reject)
    elif wants.constraint != "participant_eligibility":
        rules += _geography(wants, remote, unclear, verdict, reject)
    if wants.date_from or wants.date_to:
        start, end = event_start(), F.coalesce(event_end(), event_start())
        known = (F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != "")
        outside = known & ~((start <= F.lit(wants.date_to or "9999-12-31")) & (end >= F.lit(wants.date_from or "0000-01-01")))
        rules.append((outside, reject("Event date falls outside the requested range")))
        unclear.append(F.when(~known, "Event date unknown after enrichment"))
    reasons = F.concat(F.array_compact(F.array(*unclear)), F.array(F.lit("Passed hard eligibility")))
    review = F.exists(reasons, lambda r: r.rlike("(?i)unclear|unknown|review"))
    return _first(rules, verdict(True, review, reasons))


def _geography(wants: Preferences, remote: Column, unclear: list, verdict, reject) -> list:
    """Regions asked for without a constraint: what lies outside is reviewed, or rejected if strict."""
    if not wants.locations:
        return []
    outside = ~(remote & F.lit(wants.include_remote)) & ~in_place(wants)
    if wants.strict:
        return [(outside, reject("Location does not match requested regions and event is not remote"))]
    so_far = F.array_compact(F.array(*unclear))
    return [(outside, verdict(True, True, F.concat(so_far, F.array(F.lit("Outside requested geography")))))]


def ranked(wants: Preferences) -> Column:
    """(score, why_match, red_flags): what speaks for an eligible record."""
    matches, placed = theme_matches(wants), in_place(wants) if wants.locations else F.lit(False)
    remote = is_remote() & F.lit(wants.include_remote)
    student = _yes(F.col("eligibility").rlike("(?i)student"))
    strong = keys.authority(F.col("source")) >= 70
    near = location_words().rlike("toronto|waterloo")
    no_start = F.coalesce(event_start(), F.lit("")) == ""
    add = lambda c, n: c.cast("int") * n
    score = (
        F.lit(40) + add(placed, 25) + add(remote, 20) + F.least(matches * 10, F.lit(30)) + add(_has("apply_url"), 10) + add(_has("official_url"), 10)
        + add(_has("prize"), 8) + add(student, 8) + add(strong, 8) - add(no_start, 10) + add(near, 5)
    )
    why = F.array_compact(F.array(
        F.lit("Eligible individual event"), F.when(placed, "Matches preferred location"), F.when(remote, "Remote/online event"),
        F.when(matches > 0, F.concat(F.lit("Matches "), matches.cast("string"), F.lit(" preferred theme(s)"))), F.when(_has("apply_url"), "Has apply URL"), F.when(_has("official_url"), "Has official URL"),
        F.when(_has("prize"), "Prize or sponsor listed"), F.when(student, "Student-friendly eligibility"), F.when(strong, "Authoritative source"), F.when(near, "Toronto/Waterloo proximity"),
    ))
    flags = _list((F.coalesce(application_deadline(), F.lit("")) == "", "Applications close: Unknown"), (no_start, "Event date unclear"))
    return F.struct(clamp(score).cast("int").alias("score"), why.alias("why_match"), flags.alias("red_flags"))


def scored(gate: Column, rank: Column) -> Column:
    """(score, why_match, red_flags, rejected, rejection) of a record's eligibility and rank: 0 with the reasons where a gate rejects."""
    kept = F.struct(
        rank["score"].alias("score"), rank["why_match"].alias("why_match"),
        F.when(gate["needs_review"], F.concat(rank["red_flags"], gate["reasons"])).otherwise(rank["red_flags"]).alias("red_flags"),
        F.lit(False).alias("rejected"), F.lit(None).cast("string").alias("rejection"),
    )
    gone = F.struct(
        F.lit(0).alias("score"), gate["reasons"].alias("why_match"), gate["reasons"].alias("red_flags"), F.lit(True).alias("rejected"), gate["rejection"].alias("rejection"),
    )
    return F.when(gate["eligible"], kept).otherwise(gone)


def review_reasons(red_flags: Column) -> Column:
    """Why a broadly reviewed record needs a look; a missing application deadline alone is no reason."""
    more = _list(
        (F.coalesce(event_start(), F.lit("")) == "", "Event date unclear"), (~_has("apply_url"), "Application URL missing or unclear"), (~_has("official_url"), "Official URL missing or unclear"),
    )
    return F.array_distinct(F.concat(F.array_remove(red_flags, "Applications close: Unknown"), more))


def hard_invalid(reason: Column) -> Column:
    return _yes(reason.rlike("(?i)deadline has passed|registration closed|event already ended|stale title year|title year is in the past"))


def judged(events: DataFrame, wants: Preferences, now: Column) -> DataFrame:
    """Each record with its outcome: status (NEW, NEEDS_REVIEW or REJECTED), score, class, reason, red_flags.

    Gates first, then the page class, then verification, then the score; records of
    an uncertain class are queued for review with score 0.
    """
    df = held(prepared(events, now), __gate=eligibility(wants), __class=event_class(), __verified=verified(), __rank=ranked(wants))
    df = held(df, __score=scored(F.col("__gate"), F.col("__rank")))
    gate, kind, check, score = F.col("__gate"), F.col("__class.class"), F.col("__verified"), F.col("__score")
    invalid = (check["status"] == "rejected") & (F.lit(wants.strict) | hard_invalid(check["reasons"][0]))
    review = F.lit(False) if wants.strict else F.size(review_reasons(score["red_flags"])) > 0
    rejected = ~gate["eligible"] | kind.isin("EVENT_DIRECTORY", "ARTICLE", "ORGANIZATION_PAGE", "HISTORICAL_EVENT") | invalid
    status = F.when(rejected, "REJECTED").when(kind == "UNCERTAIN", "NEEDS_REVIEW").when((check["status"] == "needs_review") | review, "NEEDS_REVIEW").otherwise("NEW")
    reason = F.when(~gate["eligible"], gate["rejection"]).when(kind.isin("EVENT_DIRECTORY", "ARTICLE", "ORGANIZATION_PAGE", "HISTORICAL_EVENT"), kind).when(invalid, check["reasons"][0])
    flags = F.when(kind == "UNCERTAIN", check["red_flags"]).otherwise(score["red_flags"])
    out = df.withColumns({"status": status, "score": F.when(status.isin("REJECTED") | (kind == "UNCERTAIN"), 0).otherwise(score["score"]), "class": kind, "reason": reason, "red_flags": flags})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


# ---- missing facts

#: The kinds of facts in the order they are looked for.
FACTS = ["officialUrl", "applyUrl", "deadline", "location", "mode", "eligibility", "prize", "themes"]


def missing_facts(wants: Preferences) -> Column:
    """Array of (kind, priority, required) of facts that a record lacks, most pressing first."""
    due, start = dates.day_of(F.col("deadline")).isNotNull(), dates.day_of(F.col("start_date")).isNotNull()
    needs_place = ~_yes(F.col("mode") == "online") & ~_yes(F.col("city") == "Remote") & F.lit(not wants.include_remote)
    rows = [
        (~_has("official_url"), "officialUrl", 0, True), (~_has("apply_url"), "applyUrl", 0, True), (~due & ~start, "deadline", 0, True), (~due & start, "deadline", 1, False),
        (~_has("location") & ~_has("city") & needs_place, "location", 1, True), (~_has("mode") | _yes(F.col("mode") == "unknown"), "mode", 1, False),
        (~_has("eligibility"), "eligibility", 2, False), (~_has("prize"), "prize", 2, False),
        ((F.coalesce(F.size("themes"), F.lit(0)) <= 0) & F.lit(bool(wants.themes)), "themes", 2, False),
    ]
    found = [F.when(c, F.struct(F.lit(p).alias("p"), F.lit(i).alias("i"), F.lit(k).alias("kind"), F.lit(r).alias("required"))) for i, (c, k, p, r) in enumerate(rows)]
    names = F.array(F.lit("high"), F.lit("medium"), F.lit("low"))
    ordered = F.array_sort(F.array_compact(F.array(*found)))
    return F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), F.element_at(names, x["p"] + 1).alias("priority"), x["required"].alias("required")))
