"""Leads to event records: what a lead's metadata states comes first, what its text tells after that.

A lead is (id, source, title, url, text, links, metadata): metadata is the text of
a JSON object.  Nothing here can raise: what does not parse is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import dates, keys, text, urls
from siftline.functions.text import some, word

LEAD = "id string, source string, title string, url string, text string, links array<string>, metadata string"
_NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NONE)


def _first(links: Column, test) -> Column:
    return F.try_element_at(F.filter(links, test), F.lit(1))


#: Words in an address that make it an official page or a way to apply.
OFFICIAL_LINK, APPLY_LINK = "(?i)official|event|hack|devpost|dorahacks", "(?i)apply|register"
#: Dates a record may state: its column, the metadata fields that give it, and the kind of date mined for it.
DATES = [
    ("event_start_date", ["eventStartDate", "startDate"], "event_start"), ("event_end_date", ["eventEndDate", "endDate"], "event_end"), ("registration_open_date", ["registrationOpenDate"], "registration_open"),
    ("registration_deadline", ["registrationDeadline", "deadline"], "registration_deadline"), ("application_deadline", ["applicationDeadline"], "application_deadline"),
    ("submission_open_date", ["submissionOpenDate"], "submission_open"), ("submission_deadline", ["submissionDeadline"], "submission_deadline"), ("judging_start_date", ["judgingStartDate"], "judging_start"),
    ("judging_end_date", ["judgingEndDate"], "judging_end"), ("result_announcement_date", ["resultAnnouncementDate"], "result_announcement"),
]


def addresses(source: Column, url: Column, body: Column, links: Column, meta: Column) -> Column:
    """(official, apply, social) of a lead; a social post is never its own official page."""
    stated = some(meta["officialUrl"])
    own = F.when(~urls.is_social(stated), stated)
    outbound = F.filter(urls.unique_urls(F.concat(F.array_compact(F.array(own)), links, urls.in_text(F.coalesce(body, F.lit(""))))), lambda u: ~urls.is_social(u))
    usual = F.coalesce(own, _first(links, lambda u: u.rlike(OFFICIAL_LINK) & ~urls.is_social(u)), F.when(~urls.is_social(url), url))
    official = F.when(source == "x", F.coalesce(own, urls.best_official(outbound))).otherwise(usual)
    apply = F.coalesce(some(meta["applyUrl"]), _first(links, lambda u: u.rlike(APPLY_LINK) & ~urls.is_social(u)))
    posted = F.coalesce(F.when(urls.is_social(url), url), _first(links, urls.is_social))
    said = some(meta["socialUrl"])
    social = F.coalesce(F.when((source != "x") | urls.is_social(said), said), posted)
    return F.struct(official.alias("official"), apply.alias("apply"), social.alias("social"))


def evidence_of(lead: dict[str, Column], found: Column, meta: Column) -> Column:
    """At most three typed rows, one per address; without any, the lead itself."""
    def row(kind, url, title, snippet):
        none = F.lit(None).cast("string")
        return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), url.alias("url"), title.alias("title"), (none if snippet is None else snippet).alias("snippet"))

    typed = F.array_compact(F.array(
        F.when(found["official"].isNotNull(), row("official_page", found["official"], lead["title"], lead["text"])),
        F.when(found["apply"].isNotNull(), row("apply_page", found["apply"], F.concat(F.coalesce(lead["title"], lead["name"]), F.lit(" apply")), None)),
        F.when(found["social"].isNotNull(), row("x_post", found["social"], lead["title"], lead["text"])),
    ))
    kind = F.when((lead["source"] == "web") | (meta["evidenceType"] == "search_result"), "search_result").otherwise("source_card")
    fallback = F.when(lead["url"].isNotNull(), F.array(row(kind, lead["url"], lead["title"], F.coalesce(some(meta["snippet"]), lead["text"])))).otherwise(F.filter(typed, lambda x: F.lit(False)))
    return F.when(F.size(typed) > 0, typed).otherwise(fallback)


def extract(leads: DataFrame, today: Column) -> DataFrame:
    """Event records of leads, those without a name left out; columns of judge.EVENT and the further dates, with lead_id."""
    c = F.col
    df = leads.withColumn("__m", F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))).withColumn("links", F.coalesce("links", _empty()))
    meta = c("__m")
    df = df.withColumn("__said", F.concat_ws(" ", "title", "text", "metadata")).withColumn("name", F.coalesce(some(meta["name"]), some(c("title")))).filter("name IS NOT NULL")
    df = df.withColumn("__urls", addresses(c("source"), c("url"), c("text"), c("links"), meta)).withColumn("__place", text.place_of(c("__said"))).withColumn("__dates", dates.mined(c("__said"), today))
    place, mined, found = c("__place"), c("__dates"), c("__urls")
    stated = some(meta["mode"])
    mode = F.coalesce(F.when(stated.isin("online", "in-person", "hybrid", "unknown"), stated), text.mode_of(c("__said")), F.when(place["city"] == "Remote", "online"))
    df = df.withColumn("mode", mode)
    for column, fields, kind in DATES:
        df = df.withColumn(column, F.coalesce(*[some(meta[f]) for f in fields], dates.first_of(mined, kind)))
    known = text.location_mode(c("mode"))
    lead = {n: c(n) for n in ("title", "text", "source", "url", "name")}
    ids = F.when(meta["sourceIds"].isNotNull(), F.transform_values(F.from_json(meta["sourceIds"], "map<string,string>"), lambda k, v: F.coalesce(F.from_json(v, _NONE), F.array(v)))).otherwise(F.create_map("source", F.array("id")))
    return df.select(
        F.col("id").alias("lead_id"), "name", "source", found["official"].alias("official_url"), found["apply"].alias("apply_url"), found["social"].alias("social_url"),
        "event_start_date", F.coalesce("event_end_date", "event_start_date").alias("event_end_date"), *[n for n, _, _ in DATES[2:]], some(meta["displayedDateRange"]).alias("displayed_date_range"),
        c("event_start_date").alias("start_date"), F.coalesce("event_end_date", "event_start_date").alias("end_date"), F.coalesce("registration_deadline", "application_deadline").alias("deadline"),
        F.coalesce(some(meta["location"]), place["location"], some(meta["city"])).alias("location"), "mode",
        *[F.coalesce(some(meta[n]), place[n]).alias(n) for n in ("city", "region", "country")],
        F.when(known != "unknown", known).otherwise(F.coalesce(place["mode"], F.lit("unknown"))).alias("location_mode"), F.coalesce(some(meta["location"]), place["location"], place["raw_text"]).alias("location_text"),
        some(meta["prize"]).alias("prize"), F.array_distinct(F.concat(F.coalesce(F.from_json(meta["themes"], _NONE), _empty()), text.themes_of(c("__said")))).alias("themes"),
        some(meta["eligibility"]).alias("eligibility"), c("text").alias("description"), evidence_of(lead, found, meta).alias("evidence"), ids.alias("source_ids"),
    )


def summary_line(most: int = 280) -> Column:
    """Name, place, up to three themes, the next date, eligibility and prize of a record, cut at a word."""
    c = F.col
    place = F.when((c("mode") == "online") | (c("city") == "Remote"), "online").otherwise(F.coalesce(some(F.concat_ws(", ", some(c("city")), some(c("country")))), some(c("location"))))
    due, start = F.coalesce("registration_deadline", "application_deadline", "deadline"), F.coalesce("event_start_date", "start_date")
    when = F.when(due.isNotNull(), F.concat(F.lit("applications close "), due)).when(start.isNotNull(), F.concat(F.lit("starts "), start))
    themes = F.when(F.size("themes") > 0, F.concat(F.array_join(F.slice("themes", 1, 3), ", "), F.lit(" focus")))
    line = F.trim(F.regexp_replace(F.concat_ws(" - ", c("name"), place, themes, when, some(c("eligibility")), some(c("prize"))), r"\s+", " "))
    head = F.rtrim(F.substring(line, 1, most - 1))
    at_word = F.regexp_replace(head, r" \S*$", "")
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.when(F.length(at_word) > 60, at_word).otherwise(head)), F.lit("...")))


def stored_row(df: DataFrame) -> DataFrame:
    """Judged records as rows to store: fingerprint, defaults for what is missing, one summary line.

    Input: an event record with status, score, why_match and red_flags, any of which may be null.
    """
    c = F.col
    start, due = F.coalesce("event_start_date", "start_date"), F.coalesce("registration_deadline", "application_deadline", "deadline")
    end = F.coalesce("event_end_date", "end_date", "event_start_date", "start_date")
    place = F.concat_ws(" ", some(c("city")), some(c("country")), some(c("mode")))
    print_ = keys.fingerprint(c("official_url"), c("apply_url"), c("social_url"), c("source_ids"), c("name"), place, start, due)
    same = ["location", "mode", "city", "country", "prize", "eligibility", "description"]
    lists = [F.coalesce(n, _empty()).alias(n) for n in ("themes", "why_match", "red_flags")]
    return df.select(
        print_.alias("fingerprint"), "name", "source", F.coalesce("status", F.lit("NEW")).alias("status"), F.coalesce("score", F.lit(0)).alias("score"), "official_url", "apply_url", "social_url",
        start.alias("start_date"), end.alias("end_date"), due.alias("deadline"), *same, summary_line().alias("summary"), *lists, "source_ids",
    )


#: The columns of the exported sheet, in order, and what fills them.
SHEET = {
    "Status": "status", "Score": "score", "Name": "name", "Source": "source", "Official URL": "official_url", "Apply URL": "apply_url", "Social URL": "social_url", "Start Date": "start_date", "End Date": "end_date",
    "Deadline": "deadline", "Location": "location", "Mode": "mode", "City": "city", "Country": "country", "Prize": "prize", "Themes": "themes", "Eligibility": "eligibility", "Summary": "summary",
    "Why Match": "why_match", "Red Flags": "red_flags", "Found At": "found_at", "Last Verified": "last_verified", "Approved At": "approved_at", "Candidate ID": "id",
}


def sheet_row(df: DataFrame) -> DataFrame:
    """Stored records in the sheet's 24 columns as text: lists joined by "; ", days without times, nulls empty."""
    def cell(name):
        if name not in df.columns:
            return F.lit("")
        if name in ("themes", "why_match", "red_flags"):
            return F.coalesce(F.array_join(name, "; "), F.lit(""))
        value = F.col(name).cast("string")
        return F.coalesce(dates.day_of(value), value, F.lit("")) if name.endswith(("_date", "_at", "deadline", "_verified")) else F.coalesce(value, F.lit(""))

    return df.select(*[cell(column).alias(name) for name, column in SHEET.items()])


# ---- what single sources say

def season_mode(notes: Column, place: Column) -> Column:
    said = F.lower(F.concat_ws(" ", F.coalesce(notes, F.lit("")), F.coalesce(place, F.lit(""))))
    return F.when(said.rlike("digital|online|remote|virtual|everywhere"), "online").when(said.rlike("hybrid"), "hybrid").when(said.rlike("physical|in-?person|on-?campus|in person only"), "in-person")


def calendar_mode(place: Column, body: Column, kind: Column) -> Column:
    said = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (place, body, kind)]))
    return (
        F.when(said.rlike("online|remote|virtual|everywhere|location_type.?online"), "online").when(said.rlike("hybrid"), "hybrid")
        .when(said.rlike(r"in\s*person|on-?site|campus|offline"), "in-person")
    )


def tag_mode(tags: Column) -> Column:
    low = F.transform(tags, F.lower)
    has = lambda t: F.array_contains(low, t)
    return F.when(has("both") | (has("online") & has("in-person")), "hybrid").when(has("online"), "online").when(has("in-person"), "in-person")


def card_mode(*said: Column) -> Column:
    one = F.concat_ws(" ", *said)
    return F.when(one.rlike(word("hybrid")), "hybrid").when(one.rlike(word("online|virtual|remote")), "online").when(one.rlike(word("in[- ]?person|onsite|on-site")), "in-person")


#: Words of events, of meetups, of search noise, of announcements and of commentary.
EVENT_HINT = r"hackathon|buildathon|codefest|hack\s*day|hack\s*night|coding\s*competition|builder\s*competition|48[\s-]?hour\s*build|24[\s-]?hour\s*hack"
MEETUP_HINT = r"meetup|coffee|networking|happy\s*hour|casual\s*hang|fireside|panel\s*discussion|book\s*club|walkie|potluck|drink\s*&\s*draw"
SEARCH_NOISE = "what is a hackathon|history of hackathons|wikipedia|how to win|tips for|blog post|opinion"
SEARCH_EVENT = r"hackathon|buildathon|codefest|hack\s*day|registration|apply|applications?\s+open|deadline|prize|devpost|mlh"
POST_EVENT = r"hackathon|buildathon|codefest|hack\s*day"
POST_APPLY = "apply|applications?|registration|deadline|join|building|weekend|prize"
POST_OPEN = r"applications?\s+open|registration\s+open|apply\s+now|still\s+open|deadline|register\s+now"
COMMENTARY = r"what is a hackathon|tips for|wikipedia|how to win|i attended last year|throwback|recap of (?:19|20)\d{2}|history of hackathons"


def likely_event(title: Column, body: Column) -> Column:
    """Whether a calendar entry is an event of the kind looked for: named so, or built for prizes."""
    said = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")))
    named = said.rlike(word(EVENT_HINT))
    built = said.rlike(word(r"builders?|agents?|prize|registration\s+open")) & said.rlike(word("hack|build|code"))
    return named | (~said.rlike(word(MEETUP_HINT)) & built)


def upcoming(start: Column, end: Column, now: Column, hours: int = 6) -> Column:
    """Not over for more than a few hours; unknown times count as upcoming."""
    last = F.coalesce(F.try_to_timestamp(end), F.try_to_timestamp(start))
    return F.coalesce(last >= now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True))


def theme_in_content(said: Column, themes: list[str]) -> Column:
    """Whether a text names any of the themes; short ones as whole words; no themes match nothing."""
    out = F.lit(False)
    for t in (t.strip() for t in themes):
        if t:
            out = out | (said.rlike(word("\\Q" + t + "\\E")) if len(t) <= 3 else F.lower(said).contains(t.lower()))
    return F.coalesce(out, F.lit(False))


def promising_result(title: Column, snippet: Column, url: Column, page_class: Column) -> Column:
    """Whether a search result may be an event: no noise, no directory, article or organisation, and words of events."""
    said = F.concat_ws(" ", title, snippet, url)
    platform = url.rlike(r"(?i)(mlh\.io|mlh\.com|devpost\.com|lu\.ma|luma\.com|eventbrite\.com|unstop\.com)")
    worded = said.rlike(word(SEARCH_EVENT))
    return ~said.rlike(word(SEARCH_NOISE)) & ~page_class.isin("EVENT_DIRECTORY", "ARTICLE", "ORGANIZATION_PAGE") & (worded | (platform & (page_class == "INDIVIDUAL_EVENT")))


def promising_post(body: Column, posted: Column, links: Column, year: int) -> Column:
    """Whether a social post announces an event: no commentary, nothing historical unless open, and a call to apply or a link to an event."""
    said = F.coalesce(body, F.lit(""))
    event, call, open_ = (said.rlike(word(p)) for p in (POST_EVENT, POST_APPLY, POST_OPEN))
    linked = F.exists(links, urls.event_outbound)
    years = F.transform(F.regexp_extract_all(said, F.lit(r"(?<![A-Za-z0-9_])((?:19|20)\d{2})(?![A-Za-z0-9_])"), F.lit(1)), lambda y: y.cast("int"))
    old = F.exists(years, lambda y: y <= year - 2) | F.coalesce(F.substring(posted, 1, 4).try_cast("int") <= year - 2, F.lit(False))
    announced = (event & (call | open_)) | (linked & (event | call | open_))
    return (F.trim(said) != "") & ~said.rlike(word(COMMENTARY)) & (event | linked) & ~(old & ~open_) & announced


def posts(payloads: DataFrame, key: str, column: str) -> DataFrame:
    """Posts of JSON answers, one row each, with their authors' names and all addresses they name.

    The answer is {data: [...], includes: {users: [...]}}; authors are joined by
    id, and a post's addresses are those of its entities and of its text.
    """
    url = "struct<expanded_url:string,url:string,unwound_url:string>"
    post = f"struct<id:string,text:string,created_at:string,author_id:string,username:string,entities:struct<urls:array<{url}>>>"
    kind = f"struct<data:array<{post}>,includes:struct<users:array<struct<id:string,username:string>>>>"
    parsed = payloads.select(key, F.from_json(column, kind).alias("p"))
    one = parsed.select(key, F.posexplode("p.data").alias("position", "t")).filter("t.id IS NOT NULL")
    users = parsed.select(key, F.explode("p.includes.users").alias("u")).groupBy(key, F.col("u.id").alias("author_id")).agg(F.first("u.username").alias("author"))
    entity = F.flatten(F.transform(F.coalesce(F.col("t.entities.urls"), F.array().cast(f"array<{url}>")), lambda e: F.array_compact(F.array(e["expanded_url"], e["url"], e["unwound_url"]))))
    links = urls.unique_urls(F.concat(entity, urls.in_text(F.coalesce("t.text", F.lit("")))))
    out = one.withColumn("author_id", F.col("t.author_id")).join(users, [key, "author_id"], "left")
    name = F.regexp_replace(F.coalesce("t.username", "author"), "^@", "")
    return out.select(key, "position", F.col("t.id").alias("id"), F.col("t.text").alias("text"), F.col("t.created_at").alias("created_at"), name.alias("username"), links.alias("links"))


def post_lead(df: DataFrame, query: str) -> DataFrame:
    """Posts as leads: the post's address, its first outbound event as official page, a title of 120 characters."""
    social = F.concat(F.lit("https://x.com/"), F.coalesce("username", F.lit("i/web")), F.lit("/status/"), "id")
    links = urls.unique_urls(F.concat("links", F.array(social)))
    title = F.coalesce(F.nullif(F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 120), F.lit("")), F.concat(F.lit("X post "), "id"))
    meta = F.to_json(F.struct(social.alias("socialUrl"), F.col("username"), F.col("id").alias("postId"), F.lit(query).alias("query"), F.lit("x_post").alias("evidenceType"), _first(links, urls.event_outbound).alias("officialUrl")))
    return df.select(F.concat(F.lit("x-"), "id").alias("id"), F.lit("x").alias("source"), title.alias("title"), social.alias("url"), F.col("text"), links.alias("links"), meta.alias("metadata"))


def detail_over_card(card: DataFrame, detail: DataFrame, key: str, texts: list[str], lists: list[str]) -> DataFrame:
    """Cards with their detail pages: the detail's texts win where it has them, lists are united."""
    d = detail.select(key, *[F.col(c).alias(f"__{c}") for c in [*texts, *lists]])
    both = card.join(d, key, "left")
    united = [F.array_distinct(F.concat(F.coalesce(c, _empty()), F.coalesce(f"__{c}", _empty()))).alias(c) for c in lists]
    return both.select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in texts], *united)


def enriched(leads: DataFrame, pages: DataFrame, most: int = 15) -> DataFrame:
    """Leads of open sources with what their pages say: one page per address, however many leads point at it.

    leads: ordinal, id, source, title, url, text; pages: url, title, description.  At
    most `most` leads, in order, are enriched, a parameter of the operator; the rest and those without a page stay as they are.
    """
    target = F.when(leads.source.isin("web", "luma", "x") & leads.url.isNotNull(), urls.identity_url(leads.url))
    keyed = leads.withColumn("__t", target)
    chosen = keyed.filter("__t IS NOT NULL").orderBy("ordinal").limit(most).select("id", F.lit(True).alias("__in"))
    once = pages.withColumn("__t", urls.identity_url(F.col("url"))).groupBy("__t").agg(F.min_by(F.struct("title", "description"), "url").alias("__p"))
    both = keyed.join(chosen, "id", "left").join(once, "__t", "left")
    use = F.coalesce(F.col("__in"), F.lit(False)) & F.col("__p").isNotNull()
    title = F.when(use, F.coalesce(F.nullif(F.col("__p.title"), F.lit("")), F.col("title"))).otherwise(F.col("title"))
    body = F.when(use, F.concat_ws(" — ", "text", "__p.description")).otherwise(F.col("text"))
    return both.select("ordinal", "id", "source", title.alias("title"), "url", body.alias("text"), use.alias("enriched"))


def _meta(html: Column, name: str) -> Column:
    """The content of a page's meta element of this name or property."""
    first = rf"""(?is)<meta[^>]*(?:property|name)=["']{name}["'][^>]*content=["']([^"']*)["']"""
    last = rf"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*(?:property|name)=["']{name}["']"""
    return F.coalesce(some(F.regexp_extract(html, first, 1)), some(F.regexp_extract(html, last, 1)))


def _element(html: Column, tag: str) -> Column:
    """The text of a page's first element of this tag."""
    return text.flattened(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), "<[^>]+>", " "))


def page_fields(html: Column, url: Column) -> Column:
    """(title, description, date_text, mode, apply_url, deadline_text, eligibility) of a fetched page.

    The title is that of its preview, else its own, else its first heading; the way to
    apply is the first link that says so in its text or address.
    """
    body = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style|head)[^>]*>.*?</\\1>", " "), "<[^>]+>", " "), r"\s+", " ")), 1, 4000)
    mode = F.when(body.rlike(word("online|remote|virtual")), "online").when(body.rlike(word("hybrid")), "hybrid").when(body.rlike(word("in[- ]?person")), "in-person")
    link = r"""(?is)<a[^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("said"))
    apply = F.try_element_at(F.filter(pairs, lambda x: x["said"].rlike(r"(?i)apply|register|sign\s*up|registration") | x["href"].rlike("(?i)apply|register")), F.lit(1))["href"]
    due = some(F.regexp_extract(body, rf"(?i)(?<![A-Za-z0-9_])(?:deadline|apply by|registration closes)\s*[:\-]?\s*(20\d{{2}}-\d{{2}}-\d{{2}}|[A-Za-z]+\s+\d{{1,2}},?\s+20\d{{2}})", 1))
    when = F.coalesce(some(F.regexp_extract(html, r"""(?is)<time[^>]*datetime=["']([^"']*)["']""", 1)), _element(html, "time"))
    return F.struct(
        F.coalesce(_meta(html, "og:title"), _element(html, "title"), _element(html, "h1")).alias("title"),
        F.coalesce(_meta(html, "og:description"), _meta(html, "description"), F.substring(_element(html, "p"), 1, 500)).alias("description"),
        when.alias("date_text"), mode.alias("mode"), urls.resolve(apply, url).alias("apply_url"), due.alias("deadline_text"),
        F.when(body.rlike(word("eligibility")), "See page for eligibility").alias("eligibility"),
    )


# ---- support by evidence

def fact_supported(value: Column, said: Column, kind: str = "text") -> Column:
    """Whether evidence, as one text, supports a value: an address or a day as such, other values by all words of over two letters."""
    low, v = F.lower(said), F.lower(F.trim(value))
    if kind == "date":
        return F.coalesce(low.contains(F.coalesce(dates.day_of(value), v)) | low.contains(v), F.lit(False)) & (v != "")
    if kind == "url":
        return F.coalesce(low.contains(v), F.lit(False)) & (v != "")
    words = F.filter(F.split(v, r"\s+"), lambda w: F.length(w) > 2)
    return F.coalesce(F.forall(words, lambda w: low.contains(w)) & (v != ""), F.lit(False))


def claim_supported(claim: Column, said: Column) -> Column:
    """Whether any word of over three letters of a claim is in the evidence; a claim without such words is."""
    words = F.filter(F.split(text.normalize_text(claim), " "), lambda w: F.length(w) > 3)
    have = text.normalize_text(said)
    return F.coalesce((F.trim(claim) != "") & ((F.size(words) == 0) | F.exists(words, lambda w: have.contains(w))), F.lit(False))


def filled(old: Column, new: Column, said: Column, kind: str = "text") -> Column:
    """An empty field takes a new value if the evidence supports it."""
    return F.when(F.coalesce(old, F.lit("")) != "", old).when(fact_supported(new, said, kind), new).otherwise(old)


# ---- questions, failures, labels

DECIDING = (
    r"should i|should we|worth(?: my| the)? time|is it worth|recommend|advice|advise|fit(?:s)? (?:me|my)|good (?:fit|idea)|portfolio|career|risks?|trade[- ]?offs?|go for it|pass on|skip (?:this|it)|commit to"
    r"|invest (?:in|time)|priorit[yz]e|compare.*(?:hack|event)|decide|decision|advisory"
)


def question_kind(question: Column) -> Column:
    """decision or factual; asking for advice wins."""
    low = F.lower(F.trim(question))
    opened = low.rlike(r"^(?:should|would you|do you think|is this (?:a )?(?:good|bad)|worth)(?![a-z0-9_])")
    return F.when(low.rlike(word(DECIDING)) | opened, "decision").otherwise("factual")


def blocked_state(html: Column) -> Column:
    """stale_or_missing_route, human_verification or blocked: a page that says so and hardly anything of events; else null."""
    said = F.substring(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " ")), 1, 2000)
    quiet = F.regexp_count(said, F.lit("(?i)hackathon|challenge|event|deadline|register|apply|prize|build")) < 3
    return (
        F.when(quiet & said.rlike(word("404|page not found|not found|route not found|couldn't find|cannot find")), "stale_or_missing_route")
        .when(quiet & said.rlike("(?i)confirm you are human|security check before continuing|captcha|cf-challenge|awswaf"), "human_verification")
        .when(quiet & said.rlike("(?i)access denied|temporarily blocked|unusual traffic|forbidden"), "blocked")
    )


def store_error(code: Column, status: Column, message: Column) -> Column:
    """schema_unavailable, unique_conflict, authorization, temporary or unknown."""
    low = F.lower(F.coalesce(message, F.lit("")))
    is_ = lambda *values: F.coalesce(code.isin(*values), F.lit(False))
    return (
        F.when(is_("42P01", "42703", "42883", "PGRST202", "PGRST204") | low.rlike("relation .* does not exist|column .* does not exist|function .* does not exist|could not find .*function|schema cache"), "schema_unavailable")
        .when(is_("23505") | low.rlike("duplicate key value violates unique constraint"), "unique_conflict")
        .when(is_("42501") | F.coalesce(status.isin(401, 403), F.lit(False)) | low.rlike("row-level security|permission denied|not authorized|unauthorized|forbidden|jwt"), "authorization")
        .when(low.rlike("fetch failed|network|econnreset|econnrefused|enotfound|etimedout|timeout|temporarily unavailable"), "temporary")
        .otherwise("unknown")
    )


NAVIGATION = "(?i)^(learn more|hackathons?|blog|the garden|host a hackathon|consultancy|about|home|login|sign in|menu|open|past|upcoming)$"


def navigation_share(titles: DataFrame, by: str, title: str) -> DataFrame:
    """Per listing the share of titles that are navigation, and whether that makes it noise."""
    share = F.avg(F.trim(F.col(title)).rlike(NAVIGATION).cast("int"))
    return titles.groupBy(by).agg(F.round(share, 4).alias("share"), (share >= 0.4).alias("noise"))


def worth_capturing(method: Column, status: Column, kind: Column, allowed: Column) -> Column:
    """Whether a network answer may hold data: a good GET of an allowed origin with a JSON-like type."""
    return (F.upper(method) == "GET") & (status < 400) & allowed & F.coalesce(kind.rlike(r"(?i)json|graphql|text/plain|application/octet-stream"), F.lit(False))


def shown_day(c: Column) -> Column:
    """"Jul 4, 2026" of an ISO day or stamp; what is none stands for itself."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "MMM d, yyyy"), c)


def shown_range(start: Column, end: Column) -> Column:
    return (
        F.when(start.isNull() & end.isNull(), "Date unclear").when(start.isNotNull() & end.isNotNull() & (start != end), F.concat(shown_day(start), F.lit(" – "), shown_day(end)))
        .otherwise(shown_day(F.coalesce(start, end)))
    )


#: How sources are called, where a capital letter is not enough.
LABELS = {"hacklist": "HackList", "mlh": "MLH", "x": "X", "twitter": "X", "custom:hackathonmap": "Hackathon Map", "custom:hackathonradar": "Hackathon Radar"}


def source_label(source: Column) -> Column:
    low, out = F.lower(source), None
    for name, label in LABELS.items():
        out = F.when(low == name, label) if out is None else out.when(low == name, label)
    return out.otherwise(F.initcap(F.trim(F.regexp_replace(F.regexp_replace(source, "^custom:", ""), r"[-_\s]+", " "))))
