"""Addresses: keys, resolving, official pages, page kinds, trust, safety; and texts to be shown or stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import keys, text, urls

from .scenario import expected, over_orders, tallied


def _one(spark: SparkSession, sf_dir: str, cases: list[tuple]) -> DataFrame:
    return over_orders(spark, sf_dir, [(c[0],) for c in cases], "given string")


_G = "given"
#: address, then identity, evidence key and dedupe key
URL_KEYS = [
    ("https://www.Example.org/A/?utm_source=x&b=2&a=1#top", ("https://example.org/A?a=1&b=2", "https://example.org/A?a=1&b=2", "https://example.org/A")),
    ("https://e.org/p?a=2&a=1&a-b=3", ("https://e.org/p?a=2&a=1&a-b=3", "https://e.org/p?a=1&a=2&a-b=3", "https://e.org/p")),
    ("http://e.org:8080/", ("http://e.org", "http://e.org:8080/", "http://e.org:8080/")), ("https://e.org/x//?ref=1", ("https://e.org/x/", "https://e.org/x", "https://e.org/x")),
    ("https://e.org/p?referrer=z&q=1", ("https://e.org/p?q=1", "https://e.org/p?q=1&referrer=z", "https://e.org/p")), ("Not a URL", ("not a url", "not a url", "not a url")),
    ("https://e.org/?b&a=&A=1", ("https://e.org?A=1&a=&b", "https://e.org/?A=1&a=&b", "https://e.org/")), ("", (None, "", "")),
]


def c2_url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three notions of an address's identity that differ on purpose."""
    return tallied(_one(spark, sf_dir, URL_KEYS), identity=urls.identity_url(F.col(_G)), evidence=urls.evidence_key(F.col(_G)), dedupe=urls.dedupe_key(F.col(_G)))


#: reference, resolved against https://e.org/a/b?x=1
RESOLVED = [
    ("https://F.org/p?q#z", "https://f.org/p?q"), ("//g.org/p", "https://g.org/p"), ("/root", "https://e.org/root"), ("c", "https://e.org/a/c"), ("../up", "https://e.org/up"),
    ("./d/./e/../f", "https://e.org/a/d/f"), ("?y=2", "https://e.org/a/b?y=2"), ("#frag", "https://e.org/a/b?x=1"), ("mailto:a@b.c", "mailto:a@b.c"), ("..", "https://e.org/"), ("", None), (None, None),
]


def c6_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(_one(spark, sf_dir, RESOLVED), resolved=urls.resolve(F.col(_G), F.lit("https://e.org/a/b?x=1")))


#: addresses, separated by spaces, and those kept
UNIQUE = [
    ("https://a.org/x#1 ftp://a.org https://www.a.org/x/ http://b.org", "https://a.org/x http://b.org"), ("https://a.org/x?q=1 https://a.org/x?q=2", "https://a.org/x?q=1"), ("no", ""),
]


def c7_unique_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(_one(spark, sf_dir, UNIQUE), kept=F.array_join(urls.unique_urls(F.split(_G, " ")), " "))


#: text and the addresses it names
NAMED = [
    ("See https://a.org/x, and (http://b.org/y). Also https://www.a.org/x!", "https://a.org/x http://b.org/y"), ("nothing here", ""), ("<a href='https://c.org/q?z=1'>", "https://c.org/q?z=1"), (None, ""),
]


def p23_outbound_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """http(s) addresses in the first 8,000 characters of a text."""
    return tallied(_one(spark, sf_dir, NAMED), named=F.coalesce(F.array_join(urls.in_text(F.col(_G)), " "), F.lit("")))


#: addresses of a post, the best and its worth
OFFICIAL = [
    ("https://x.com/a/status/1 https://blog.example/post", ("https://blog.example/post", 1)), ("https://blog.example/hackathon https://jam.devpost.com/", ("https://jam.devpost.com/", 9)),
    ("https://devpost.com/hackathons https://a.edu/apply", ("https://a.edu/apply", 10)), ("https://twitter.com/q", (None, None)), ("https://a.example/event/1 https://b.example/event/2", ("https://a.example/event/1", 4)),
]


def p24_official_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = urls.best_official(F.split(_G, " "))
    return tallied(_one(spark, sf_dir, OFFICIAL), best=best, worth=F.when(best.isNotNull(), urls.official_worth(best)))


#: address, then whether social, directory, outbound event, challenge page; calendar kind
KINDS = [
    ("https://x.com/a/status/1", (True, False, False, False, "unknown")), ("https://devpost.com/hackathons", (False, True, True, False, "unknown")), ("https://jam.devpost.com/", (False, False, True, True, "unknown")),
    ("https://help.devpost.com/x", (False, False, True, False, "unknown")), ("https://lu.ma/discover/tech", (False, False, True, False, "discover")), ("https://lu.ma/calendar/x", (False, False, True, False, "calendar")),
    ("https://lu.ma/u/someone", (False, False, True, False, "profile")), ("https://lu.ma/abc123", (False, False, True, False, "unknown")), ("https://mlh.io/seasons/2026/events", (False, True, True, False, "unknown")),
    ("https://blog.example/post", (False, False, False, False, "unknown")), ("https://blog.example/apply", (False, False, True, False, "unknown")), ("see t.co", (True, False, False, False, "unknown")),
]


def f22_url_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col(_G)
    return tallied(
        _one(spark, sf_dir, KINDS), social=urls.is_social(g), directory=urls.is_directory(g), outbound=urls.event_outbound(g), challenge=urls.challenge_page(g), calendar=urls.calendar_page_kind(g),
    )


#: address, source, then trust of the host and of the source
TRUST = [
    (("https://mlh.io/x", "mlh"), (75, 80)), (("https://jam.devpost.com", "devpost"), (75, 78)), (("https://lu.ma/x", "luma"), (65, 70)), (("https://hacklist.example/", "hacklist"), (45, 55)),
    (("https://own.example/", "custom:my-board"), (90, 60)), (("https://www.google.com/q", "custom:a--b"), (20, 30)), (("https://x.com/a", "x"), (20, 20)), (("no", "custom:a-"), (0, 30)), ((None, "web"), (0, 40)),
]


def m2_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [t for t, _ in TRUST], "url string, source string")
    return tallied(df, host=urls.host_authority(F.col("url")), source=keys.authority(F.col("source")))


#: address and whether it must not be fetched
UNSAFE = [
    ("https://example.org/", False), ("file:///etc/passwd", True), ("http://localhost:3000/", True), ("http://127.0.0.1/", True), ("http://10.1.2.3/", True), ("http://172.16.0.1/", True),
    ("http://172.32.0.1/", False), ("http://192.168.0.9/", True), ("http://169.254.169.254/latest", True), ("http://[::1]/", True), ("http://[fd00::1]/x", True), ("http://printer.local/", True), ("nonsense", True),
]


def f24_unsafe_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(_one(spark, sf_dir, UNSAFE), unsafe=urls.private_host(F.col(_G)))


#: address, then its origin and whether it is allowed
ORIGINS = [
    ("https://www.e.org/a", ("https://www.e.org", True)), ("https://e.org:443/a", ("https://e.org", True)), ("http://e.org/a", ("http://e.org", False)), ("https://sub.e.org/", ("https://sub.e.org", False)), ("x", (None, False)),
]


def f26_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins on an allow-list, with or without www."""
    return tallied(_one(spark, sf_dir, ORIGINS), origin=urls.origin(F.col(_G)), allowed=urls.origin_allowed(F.col(_G), ["https://e.org"]))


#: text, then the sentences that are complete and the cut of it
SAID = [
    ("One fine sentence here. Another one follows it. A third is here too. And a fourth.", ("3", "One fine sentence here. Another one follows it. A third is here too.")),
    ("Short. Yes it is so.", ("0", "Short. Yes it is so.")), ("No end to this text", ("0", "No end to this text")), ("It ends in a vs. Then more words come here.", ("1", "It ends in a vs. Then more words come here.")),
]


def p30_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = text.sentences(F.col(_G))
    return tallied(_one(spark, sf_dir, SAID), complete=F.size(F.filter(said, text.complete_sentence)).cast("string"), cut=text.cut_to_sentences(F.col(_G)))


#: fields of a log entry, what may be stored of it, and of evidence
FIELDS = [
    (("token", "abc"), ("", "token=abc")), (("api_key", "abc"), ("", "")), (("note", "Bearer abc.def"), ("note=Bearer abc.def", "note=[redacted]")), (("cookie", "c"), ("", "cookie=c")), (("query", "q"), ("query=q", "query=q")),
]


def t17_safe_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [f for f, _ in FIELDS], "k string, v string")
    m = F.create_map("k", "v")
    said = lambda x: F.array_join(F.transform(F.map_entries(x), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return tallied(df, logged=said(text.safe_metadata(m)), evidence=said(text.safe_evidence(m)))


#: text of an answer and the JSON object in it
ANSWERS = [
    ('Sure: {"a": 1}', '{"a": 1}'), ('```json\n{"b": [1, 2]}\n```', '{"b": [1, 2]}'), ("none", None), ("{broken", None), ('x {"a": {"b": 2}} y', '{"a": {"b": 2}}'),
]


def x46_json_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(_one(spark, sf_dir, ANSWERS), found=text.json_object(F.col(_G)))


#: value and ratio
RATIOS = [("0.12345", "0.123"), ("7", "1.0"), ("-3", "0.0"), (None, "0.0"), ("NaN", "0.0")]


def x51_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(_one(spark, sf_dir, RATIOS), ratio=text.ratio(F.col(_G).cast("double")).cast("string"))


#: map of ids in canonical form
IDS = [(("b", "2,1"), "source-id:b:1,2"), (("x", "Post 9!,"), "source-id:x:post 9"), (("x", ""), None)]


def c11_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [i for i, _ in IDS], "k string, v string")
    return tallied(df, identity=keys.source_id_identity(F.create_map("k", F.split("v", ","))))


QUERIES = {f.__name__: f for f in (
    c2_url_keys, c6_resolve, c7_unique_urls, p23_outbound_urls, p24_official_url, f22_url_kinds, m2_trust, f24_unsafe_address, f26_origins, p30_sentences, t17_safe_metadata, x46_json_in_text, x51_ratio, c11_source_ids,
)}

ORACLES = {
    "c2_url_keys": expected(["identity", "evidence", "dedupe"], [c[1] for c in URL_KEYS]),
    "c6_resolve": expected(["resolved"], [(c[1],) for c in RESOLVED]),
    "c7_unique_urls": expected(["kept"], [(c[1],) for c in UNIQUE]),
    "p23_outbound_urls": expected(["named"], [(c[1],) for c in NAMED]),
    "p24_official_url": expected(["best", "worth"], [c[1] for c in OFFICIAL]),
    "f22_url_kinds": expected(["social", "directory", "outbound", "challenge", "calendar"], [c[1] for c in KINDS]),
    "m2_trust": expected(["host", "source"], [c[1] for c in TRUST]),
    "f24_unsafe_address": expected(["unsafe"], [(c[1],) for c in UNSAFE]),
    "f26_origins": expected(["origin", "allowed"], [c[1] for c in ORIGINS]),
    "p30_sentences": expected(["complete", "cut"], [c[1] for c in SAID]),
    "t17_safe_metadata": expected(["logged", "evidence"], [c[1] for c in FIELDS]),
    "x46_json_in_text": expected(["found"], [(c[1],) for c in ANSWERS]),
    "x51_ratio": expected(["ratio"], [(c[1],) for c in RATIOS]),
    "c11_source_ids": expected(["identity"], [(c[1],) for c in IDS]),
}
