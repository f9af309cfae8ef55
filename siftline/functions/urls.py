"""URL identities.  Three notions differ on purpose: identity, evidence and dedupe keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"

#: Parameters that say where a visitor came from.
IDENTITY_PREFIXES = ["utm_", "fbclid", "gclid", "mc_", "ref"]
EVIDENCE_NAMES = ["fbclid", "gclid", "mc_cid", "mc_eid", "msclkid", "ref", "ref_src", "s", "si"]


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(c), URL, group)


def is_url(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike(URL), F.lit(False))


def host(c: Column, port: bool = False) -> Column:
    """Lower-case host without www., with its port if asked for and given."""
    authority = F.regexp_replace(F.lower(_part(c, 2)), "^[^@]*@", "")
    if not port:
        authority = F.regexp_replace(authority, ":[0-9]*$", "")
    return F.regexp_replace(authority, r"^www\.", "")


def path(c: Column) -> Column:
    return _part(c, 3)


def hostname(c: Column) -> Column:
    """Lower-case host as it stands, without user or port; null if this is no URL."""
    return F.when(is_url(c), F.regexp_replace(F.regexp_replace(F.lower(_part(c, 2)), "^[^@]*@", ""), ":[0-9]*$", ""))


def pathname(c: Column) -> Column:
    """The path, / where it is empty; null if this is no URL."""
    return F.when(is_url(c), F.when(path(c) == "", "/").otherwise(path(c)))


def _query(c: Column, dropped, by_value: bool) -> Column:
    """The query without dropped parameters, with its ? unless empty.

    Sorted by name; parameters of one name keep their order, or go by value.
    """
    pairs = F.filter(F.split(F.regexp_replace(_part(c, 4), r"^\?", ""), "&"), lambda p: (p != "") & ~dropped(F.lower(F.substring_index(p, "=", 1))))
    keyed = F.transform(pairs, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), (F.substring(p, F.locate("=", p) + 1, 1 << 20) if by_value else i).alias("o"), p.alias("p")))
    joined = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined))


def identity_url(c: Column) -> Column:
    """No fragment, tracking parameters, www., port or last slash; parameters sorted by name.

    Null and empty are null; what is no URL becomes its canonical text.
    """
    tracked = "^(" + "|".join(IDENTITY_PREFIXES) + ")"
    whole = F.concat(F.lower(_part(c, 1)), F.lit("://"), host(c), F.regexp_replace(path(c), "/$", ""), _query(c, lambda k: k.rlike(tracked), False))
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(is_url(c), whole).otherwise(normalize_text(c))


def evidence_key(c: Column) -> Column:
    """Like the identity, but keeps ports, drops all last slashes, has / as root and sorts by name and value."""
    dropped = lambda k: k.startswith("utm_") | k.isin(EVIDENCE_NAMES)
    bare = F.regexp_replace(path(c), "/+$", "")
    scheme = F.lower(_part(c, 1))
    usual = F.when(scheme == "https", ":443$").when(scheme == "http", ":80$").otherwise("$^")
    whole = F.concat(scheme, F.lit("://"), F.regexp_replace(host(c, port=True), usual, F.lit("")), F.when(bare == "", F.lit("/")).otherwise(bare), _query(c, dropped, True))
    loose = F.regexp_replace(F.lower(F.trim(c)), "/+$", "")
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit("")).when(is_url(c), whole).otherwise(loose)


def provisional_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/+$", ""))


def dedupe_key(c: Column) -> Column:
    """Scheme, host and path only."""
    bare = F.regexp_replace(path(c), "/+$", "")
    whole = F.concat(F.lower(_part(c, 1)), F.lit("://"), host(c, port=True), F.when(bare == "", F.lit("/")).otherwise(bare))
    return F.when(is_url(c), whole).otherwise(F.lower(F.trim(c)))


def unique_urls(links: Column) -> Column:
    """http(s) addresses of an array without fragments, the first of each dedupe key, in order."""
    web = F.transform(F.filter(links, lambda u: F.lower(u).rlike("^https?://")), lambda u, i: F.struct(dedupe_key(u).alias("k"), i.alias("i"), F.regexp_replace(u, "#.*$", "").alias("u")))
    # equal keys lie side by side once sorted; the outer transform binds the sorted array, which is then made once
    first = F.transform(F.array(F.array_sort(web)), lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["k"] != x["k"])))
    in_order = F.array_sort(F.transform(F.element_at(first, 1), lambda x: F.struct(x["i"].alias("i"), x["u"].alias("u"))))
    return F.transform(in_order, lambda x: x["u"])


def resolve(c: Column, base: Column) -> Column:
    """An address as a page at base would link to it, without fragment; null if there is none.

    Absolute, scheme-relative, root-relative, query-only and relative references;
    dot segments are taken out.
    """
    ref = F.regexp_replace(F.trim(c), "#.*$", "")
    origin = F.concat(F.lower(_part(base, 1)), F.lit("://"), F.lower(_part(base, 2)))
    folder = F.regexp_replace(pathname(base), "[^/]*$", "")
    bare, query = F.regexp_replace(ref, r"\?.*$", ""), F.regexp_extract(ref, r"\?.*$", 0)
    target = F.when(bare == "", pathname(base)).when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))
    steps = F.aggregate(
        F.split(F.regexp_replace(target, "^/", ""), "/"), F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    ends = F.when(target.rlike(r"(^|/)[.][.]?$") & (F.size(steps) > 0), "/").otherwise("")
    relative = F.concat(origin, F.lit("/"), F.array_join(steps, "/"), ends, F.when(bare == "", F.coalesce(F.nullif(query, F.lit("")), _part(base, 4))).otherwise(query))
    absolute = F.concat(F.lower(_part(ref, 1)), F.lit("://"), F.lower(_part(ref, 2)), pathname(ref), _part(ref, 4))
    joined = F.concat(F.lower(_part(base, 1)), F.lit(":"), ref)
    return (
        F.when(F.coalesce(ref, F.lit("")) == "", F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.regexp_replace(base, "#.*$", "")))
        .when(is_url(ref), absolute)
        .when(ref.startswith("//"), F.concat(F.lower(_part(joined, 1)), F.lit("://"), F.lower(_part(joined, 2)), pathname(joined), _part(joined, 4)))
        .when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(is_url(base), relative)
    )


def is_http(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike("^https?://[^/?#]+"), F.lit(False))


def looks_like_url(c: Column) -> Column:
    """An address with a scheme or host, or a path from the root."""
    return F.coalesce(c.rlike(r"(?i)^(?:https?:)?//") | c.rlike(r"^/\S+$"), F.lit(False))


def origin(c: Column) -> Column:
    """Scheme, host and a port that is not the scheme's own; null if this is no URL."""
    scheme, at = F.lower(_part(c, 1)), F.regexp_replace(F.lower(_part(c, 2)), "^[^@]*@", "")
    usual = F.when(scheme == "https", ":443$").when(scheme == "http", ":80$").otherwise("$^")
    return F.when(is_url(c), F.concat(scheme, F.lit("://"), F.regexp_replace(at, usual, F.lit(""))))


def origin_variants(c: Column) -> Column:
    """The origin with and without www., itself first."""
    o = origin(c)
    other = F.when(o.rlike("://www[.]"), F.regexp_replace(o, "://www[.]", "://")).otherwise(F.regexp_replace(o, "://", "://www."))
    return F.when(o.isNull(), F.array().cast("array<string>")).otherwise(F.array(o, other))


def origin_allowed(c: Column, allowed: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(origin_variants(c), F.array(*[F.lit(a) for a in allowed])), F.lit(False))


#: Hosts of social posts, of event platforms, and how their paths tell what a page is.
SOCIAL_HOST = r"^(?:www\.)?(?:x\.com|twitter\.com|t\.co|mobile\.twitter\.com)$"
PREFERRED_HOST = r"(?:^|\.)(devpost\.com|mlh\.io|mlh\.com|lu\.ma|luma\.com|dorahacks\.io|hackclub\.com|eventbrite\.com|unstop\.com)$"
EVENT_HOST = r"(?:^|\.)(mlh\.io|mlh\.com|devpost\.com|lu\.ma|luma\.com|eventbrite\.com|unstop\.com)$"
APPLY_PATH = r"(?i)/(apply|register|registration|signup|sign-up)"
EVENT_PATH = r"(?i)/(event|hack|hackathon|challenge)"
DIRECTORY = (
    r"(?i)mlh\.(io|com)/?(seasons|events)?/?$|mlh\.(io|com)/seasons/\d+/events/?$|devpost\.com/hackathons|devpost\.com/hackathons/search"
    r"|lablab\.ai/(ai-hackathons|events)/?$|eventbrite\.[^/]+/d/|eventbrite\.[^/]+/.*/hackathon|unstop\.com/hackathons|hackathon\.com/?$"
)


def is_social(c: Column) -> Column:
    """Whether the address is a social post's, as far as the host tells."""
    return F.coalesce(F.when(is_url(c), host(c).rlike(SOCIAL_HOST)).otherwise(c.rlike(r"(?i)(?:x\.com|twitter\.com|t\.co)")), F.lit(False))


def host_path(c: Column) -> Column:
    """Host and path in lower case; what is no URL stands for itself."""
    return F.when(is_url(c), F.lower(F.concat(hostname(c), pathname(c)))).otherwise(F.lower(F.coalesce(c, F.lit(""))))


def is_directory(c: Column) -> Column:
    return host_path(c).rlike(DIRECTORY)


def official_worth(c: Column) -> Column:
    """How likely an address is a record's own page; directories fall far below zero."""
    h, p = F.coalesce(host(c), F.lit("")), F.lower(F.coalesce(pathname(c), F.lit("")))
    add = lambda cond, n: F.coalesce(cond, F.lit(False)).cast("int") * n
    return (
        F.lit(1) - add(is_directory(c), 8) + add(h.rlike(PREFERRED_HOST), 6) + add(h.rlike(r"\.edu$"), 5) + add(p.rlike(APPLY_PATH) | c.rlike(APPLY_PATH), 4)
        + add(p.rlike(EVENT_PATH) | c.rlike(EVENT_PATH), 3) + add(F.regexp_replace(h, "[.]", " ").rlike(r"\b(hack|devpost|mlh|luma|event)\b"), 2)
    )


def best_official(links: Column) -> Column:
    """Of the addresses that are no social posts the worthiest, the first of equals."""
    ranked = F.transform(F.filter(links, lambda u: ~is_social(u)), lambda u, i: F.struct((-official_worth(u)).alias("w"), i.alias("i"), u.alias("u")))
    return F.array_min(ranked)["u"]


def in_text(text: Column, most: int = 8000) -> Column:
    """http(s) addresses named in the first `most` characters, last punctuation cut, each once."""
    found = F.regexp_extract_all(F.substring(text, 1, most), F.lit(r"""(?i)https?://[^\s<>"')\]]+"""), F.lit(0))
    return unique_urls(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}>]+$", "")))


def event_outbound(c: Column) -> Column:
    """Whether an address outside social hosts looks like an event's page."""
    h = host(c)
    named = h.rlike(EVENT_HOST) | F.regexp_replace(h, "[.]", " ").rlike(r"\b(hack|devpost|mlh|luma|eventbrite|unstop)\b")
    return F.coalesce(is_url(c) & ~is_social(c) & (named | c.rlike("(?i)/(event|hack|apply|register|challenge)")), F.lit(False))


def host_authority(c: Column) -> Column:
    """How far an address's host is trusted: own sites before platforms before search and social hosts."""
    h = hostname(c)
    return (
        F.when(h.isNull(), 0).when(h.rlike(r"(mlh\.io|mlh\.com|devpost\.com)$"), 75).when(h.rlike(r"(lu\.ma|luma\.com)$"), 65)
        .when(h.rlike("(hacklist|hakku)"), 45).when(~h.rlike(r"(google\.|bing\.|facebook\.|twitter\.|x\.com)"), 90).otherwise(20)
    )


#: Hosts of a platform that carry no events, and its paths that are not event pages.
NO_EVENT_HOSTS = ["info.devpost.com", "help.devpost.com", "secure.devpost.com", "support.devpost.com", "api.devpost.com"]
NO_EVENT_PATH = "^(/$|/hackathons$|/hackathons/|/software|/portfolio|/settings|/users|/follows|/notifications|/challenges/search)"


def challenge_rejected(c: Column) -> Column:
    """Whether a challenge platform's address is no event page; what is no URL is rejected too."""
    h, p = hostname(c), F.lower(pathname(c))
    top = h.isin("devpost.com", "www.devpost.com")
    return F.coalesce(h.isin(NO_EVENT_HOSTS) | (top & (p.rlike(NO_EVENT_PATH) | p.rlike("^/[^/.]+/?$"))), F.lit(True))


def challenge_page(c: Column) -> Column:
    """Whether an address is an event's own page on the challenge platform."""
    h = hostname(c)
    top = h.isin("devpost.com", "www.devpost.com")
    return F.coalesce(h.endswith("devpost.com") & ~challenge_rejected(c) & (~top | pathname(c).rlike("^/[^/]+/?$")), F.lit(False))


def calendar_page_kind(c: Column) -> Column:
    """discover, calendar, profile or unknown: what a calendar platform's address points at."""
    h, p = hostname(c), F.coalesce(F.nullif(F.regexp_replace(pathname(c), "/+$", ""), F.lit("")), F.lit("/"))
    own = h.contains("lu.ma") | h.contains("luma.com")
    return (
        F.when(~F.coalesce(own, F.lit(False)), "unknown")
        .when(p.rlike("^/discover(/|$)"), "discover")
        .when(p.contains("/calendar"), "calendar")
        .when(p.rlike("^/(home(/|$)|user/|u/|signin$|login$)"), "profile")
        .otherwise("unknown")
    )


def page_kind(c: Column) -> Column:
    """A coarse class of what an address points at, by path and host."""
    p = F.lower(path(c))
    return (
        F.when(~is_url(c), "invalid")
        .when(F.regexp_replace(p, "/+$", "") == "", "root")
        .when(p.rlike("(^|/)(tag|tags|category|calendar|explore|discover|search)(/|$)"), "directory")
        .when(p.rlike("(^|/)(u|user|users|profile|people)/"), "profile")
        .when(p.rlike("[.]html?$"), "document")
        .when(p.rlike("/[0-9]+/?$"), "record")
        .otherwise("page")
    )


def private_host(c: Column) -> Column:
    """Whether an address must not be fetched: no http(s), or a local or private host (any IPv6 literal is)."""
    h = host(c)
    local = h.rlike(r"^(localhost|.*[.]localhost|.*[.]local|.*[.]internal|0[.].*|10[.].*|127[.].*|169[.]254[.].*|192[.]168[.].*|172[.](1[6-9]|2[0-9]|3[01])[.].*|\[.*)$")
    return ~F.coalesce(F.lower(_part(c, 1)).isin("http", "https"), F.lit(False)) | F.coalesce(local, F.lit(True))
