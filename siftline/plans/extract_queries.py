"""Leads to records, single sources' rules, posts, enrichment, support by evidence, labels, and the sheet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text
from siftline.operators import extract, judge
from siftline.sources import tables

from .judge_queries import event
from .scenario import expected, over_orders, tallied


def _today():
    return F.lit("2026-07-16")


def _lead(source="web", title="Good Jam", url="https://jam.example/", body="words", links=(), **meta) -> tuple:
    return "id1", source, title, url, body, list(links), json.dumps(meta) if meta else None


_FIELDS = ["name", "official_url", "apply_url", "social_url", "start_date", "deadline", "city", "mode", "themes", "evidence"]
#: lead, then the fields above
LEADS = [
    (_lead(), ("Good Jam", "https://jam.example/", None, None, None, None, None, None, "", "official_page")),
    (_lead(body="Apply by Aug 1, 2026. Starts: 2026-09-01 in Toronto, AI agents", links=["https://jam.example/register"]),
     ("Good Jam", "https://jam.example/", "https://jam.example/register", None, "2026-09-01", "2026-08-01", "Toronto", None, "AI,agents", "official_page,apply_page")),
    (_lead(name="Named", officialUrl="https://own.example/", startDate="2026-10-01", deadline="2026-09-01", mode="hybrid", city="Rome", themes=["x"]),
     ("Named", "https://own.example/", None, None, "2026-10-01", "2026-09-01", "Rome", "hybrid", "x", "official_page")),
    (_lead("x", "Post", "https://x.com/a/status/1", "see https://jam.devpost.com/ online"), ("Post", "https://jam.devpost.com/", None, "https://x.com/a/status/1", None, None, "Remote", "online", "", "official_page,x_post")),
    (_lead("x", "Post", "https://x.com/a/status/1", "no link"), ("Post", None, None, "https://x.com/a/status/1", None, None, None, None, "", "x_post")),
    (_lead(url="https://twitter.com/b", links=["https://hack.example/a"]), ("Good Jam", "https://hack.example/a", None, "https://twitter.com/b", None, None, None, None, "", "official_page,x_post")),
    (_lead(title="  ", url=None), None),
    (_lead(url=None, body="in-person and virtual"), ("Good Jam", None, None, None, None, None, "Remote", "hybrid", "", "")),
]


def p1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads to records: stated fields first, then what the text tells; leads without a name are left out."""
    df = over_orders(spark, sf_dir, [x for x, _ in LEADS], extract.LEAD).withColumn("id", F.col("case_no").cast("string"))
    out = extract.extract(df, _today()).withColumn("case_no", F.col("lead_id").cast("int"))
    shown = {n: F.col(n) for n in _FIELDS[:-2]}
    return tallied(out, **shown, themes=F.array_join("themes", ","), evidence=F.array_join(F.transform("evidence", lambda e: e["type"]), ","))


#: record with status and score, then fingerprint, status, score and summary
_RECORDS = [
    (event(official_url=None, apply_url=None, mode="online"), None, None, ("event:toronto ai hackathon:toronto canada online:2026-09-05", "NEW", 0, "Toronto AI Hackathon - online - AI focus - applications close 2026-08-20")),
    (event(prize="$5", eligibility="all", deadline=None), "NEEDS_REVIEW", 7, ("official:https://hack.example.org", "NEEDS_REVIEW", 7, "Toronto AI Hackathon - Toronto, Canada - AI focus - starts 2026-09-05 - all - $5")),
    (event(name="word " * 80, themes=[], deadline=None, start_date=None, event_start_date=None, city=None, country=None), "NEW", 1, ("official:https://hack.example.org", "NEW", 1, ("word " * 55).strip() + "...")),
]


def p25_stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged records as rows to store."""
    df = over_orders(spark, sf_dir, [(*r, s, n) for r, s, n, _ in _RECORDS], judge.EVENT + ", status string, score int")
    none = F.lit(None).cast("array<string>")
    df = df.withColumns({"why_match": none, "red_flags": none, "source_ids": F.lit(None).cast("map<string,array<string>>")})
    rows = extract.stored_row(df.withColumn("description", F.col("case_no").cast("string"))).withColumn("case_no", F.col("description").cast("int"))
    return tallied(rows, fingerprint=F.col("fingerprint"), status=F.col("status"), score=F.col("score"), summary=F.col("summary"))


def k9_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in the sheet's 24 columns: each row as one text."""
    c = tables.candidates(spark, sf_dir)
    c = c.withColumns({"themes": F.array(F.lit("a"), F.lit("b")), "deadline": F.when(F.col("id") % 2 == 0, "July 4, 2026").otherwise("soon"), "city": F.lit(None).cast("string")})
    row = extract.sheet_row(c)
    return row.select(F.col("Candidate ID").alias("id"), F.concat_ws("|", *[F.col(f"`{x}`") for x in row.columns]).alias("row"))


#: notes, place, then mode by season, calendar and card rules
MODES = [
    (("Digital", "Everywhere"), ("online", "online", None)), (("Hybrid online", "x"), ("online", "online", "hybrid")), (("in person only", "Rome"), ("in-person", "in-person", "in-person")), (("physical", "x"), ("in-person", None, None)),
    (("on-site campus", "x"), (None, "in-person", "in-person")), (("plain", "x"), (None, None, None)), (("hybrid", "y"), ("hybrid", "hybrid", "hybrid")),
]


def p18_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes as different sources tell them: precedence differs on purpose."""
    df = over_orders(spark, sf_dir, [m for m, _ in MODES], "notes string, place string")
    n, p = F.col("notes"), F.col("place")
    return tallied(df, season=extract.season_mode(n, p), calendar=extract.calendar_mode(p, n, F.lit("")), card=extract.card_mode(n, p))


TAGS = [("Online,Both", "hybrid"), ("online,in-person", "hybrid"), ("ONLINE", "online"), ("in-person,AI", "in-person"), ("AI", None)]


def s19_tag_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(over_orders(spark, sf_dir, [(t,) for t, _ in TAGS], "tags string"), mode=extract.tag_mode(F.split("tags", ",")))


#: title, text, likely event
ENTRIES = [
    (("AI Hack Night", ""), True), (("Coffee chat", "with builders who code"), False), (("Builders for prizes", "code all day"), True), (("Prize gala", "dinner"), False), (("Meetup", "a 24 hour hack"), True), (("Yoga", None), False),
]


def f20_likely_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [e for e, _ in ENTRIES], "title string, body string")
    return tallied(df, likely=extract.likely_event(F.col("title"), F.col("body")))


#: start, end, upcoming at 2026-07-16 12:00
TIMES = [(("2026-07-16 05:00:00", None), False), (("2026-07-16 06:00:00", None), True), (("2026-07-01 00:00:00", "2026-07-17 00:00:00"), True), ((None, None), True), (("odd", None), True), (("2026-07-17", "2026-07-15"), False)]


def f20_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [t for t, _ in TIMES], "start string, finish string")
    return tallied(df, upcoming=extract.upcoming(F.col("start"), F.col("finish"), F.lit("2026-07-16 12:00:00").cast("timestamp")))


#: text, whether it names AI or robotics
CONTENT = [("An AI day", True), ("PAIRS of luma_ai", False), ("Big Robotics event", True), ("plain", False), (None, False)]


def f21_content_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(over_orders(spark, sf_dir, [(c,) for c, _ in CONTENT], "said string"), named=extract.theme_in_content(F.col("said"), ["AI", "robotics"]))


#: title, snippet, url, promising
RESULTS = [
    (("Acme Hackathon 2026", "Apply now", "https://acme.example/hack"), True), (("What is a hackathon", "hackathon tips", "https://blog.example/"), False), (("Hackathon directory", "browse", "https://a.example/"), False),
    (("Some page", "nothing of note", "https://a.example/"), False), (("Acme Summit Day", "fun for all", "https://lu.ma/acme"), True),
]


def f18_promising_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [r for r, _ in RESULTS], "title string, snippet string, url string")
    no = F.lit(False)
    kind = judge.page_class(F.col("url"), F.col("title"), F.col("snippet"), no, no, no)["class"]
    return tallied(df, promising=extract.promising_result(F.col("title"), F.col("snippet"), F.col("url"), kind))


#: text, posted, links, promising
POSTS = [
    (("Our hackathon is open, apply now", "2026-07-01", ""), True), (("Our hackathon was fun", "2026-07-01", ""), False), (("Hackathon of 2023, join us", "2026-07-01", ""), False), (("Hackathon of 2023, registration open", "2026-07-01", ""), True),
    (("Join!", "2026-07-01", "https://jam.devpost.com/"), True), (("Hackathon tips for all, apply", "2026-07-01", ""), False), (("Hackathon, apply", "2023-07-01", ""), False), ((" ", "2026-07-01", "https://jam.devpost.com/"), False),
    (("Look at this", "2026-07-01", "https://jam.devpost.com/"), False),
]


def f19_promising_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [p for p, _ in POSTS], "body string, posted string, link string")
    links = F.filter(F.array("link"), lambda x: x != "")
    return tallied(df, promising=extract.promising_post(F.col("body"), F.col("posted"), links, 2026))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer of the social search per customer: two posts, their users beside them."""
    answer = (
        '{"data": [{"id": "%d", "text": "Hackathon! apply https://jam%d.devpost.com/.", "author_id": "u1", "entities": {"urls": [{"expanded_url": "https://e.example/%d", "url": "https://t.co/x"}]}},'
        ' {"id": "p%d", "text": "plain", "author_id": "u9"}, {"text": "no id"}], "includes": {"users": [{"id": "u1", "username": "@ann"}, {"id": "u2", "username": "bob"}]}}'
    )
    c = tables.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", F.format_string(answer, k, k, k, k).alias("j"))


def s24_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of nested answers with their authors joined by id and their addresses expanded."""
    out = extract.posts(_answers(spark, sf_dir), "c_custkey", "j")
    return out.select("id", "position", "username", F.array_join("links", " ").alias("links"))


def s25_post_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract.post_lead(extract.posts(_answers(spark, sf_dir), "c_custkey", "j").filter("username IS NOT NULL"), "q")
    return out.select("id", "title", "url", F.get_json_object("metadata", "$.officialUrl").alias("official"))


def s21_detail_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of customers under details of every other one: the detail's texts win, lists are united."""
    c = tables.table(spark, sf_dir, "customer")
    card = c.select("c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("kind"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    detail = c.filter("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("Detail "), "c_custkey").alias("title"), F.lit(None).cast("string").alias("kind"), F.array(F.lit("b"), F.lit("c")).alias("tags"))
    return extract.detail_over_card(card, detail, "c_custkey", ["title", "kind"], ["tags"]).select("c_custkey", "title", "kind", F.array_join("tags", ",").alias("tags"))


def p22_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen leads of open sources with their pages' titles; leads of one page share it."""
    leads = tables.leads(spark, sf_dir)
    given = leads.select(F.col("page_id").alias("ordinal"), F.col("page_id").cast("string").alias("id"), "source", F.lit("lead").alias("title"), "url", F.lit("text").alias("text"))
    pages = leads.filter("page_id % 2 = 0").select("url", F.concat(F.lit("page "), "source").alias("title"), F.lit("more").alias("description"))
    out = extract.enriched(given, pages)
    return out.groupBy("enriched", "text").agg(F.count(F.lit(1)).alias("n"))


#: value, evidence, kind, supported
SUPPORT = [
    (("2026-07-04", "starts july", "date"), False), (("July 4, 2026", "on 2026-07-04 we start", "date"), True), (("Great Hall", "In the great big hall", "text"), True), (("Great Hall", "hall", "text"), False),
    (("https://a.example/x", "see HTTPS://A.example/x now", "url"), True), (("", "x", "text"), False), ((None, "x", "text"), False),
]


def f31_fact_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [s for s, _ in SUPPORT], "value string, said string, kind string")
    by_kind = F.lit(None).cast("boolean")
    for kind in ("date", "text", "url"):
        by_kind = F.when(F.col("kind") == kind, extract.fact_supported(F.col("value"), F.col("said"), kind)).otherwise(by_kind)
    return tallied(df, supported=by_kind)


#: stored, new, evidence, kept
FILLS = [(("old", "Great Hall", "great hall"), "old"), (("", "Great Hall", "the great hall"), "Great Hall"), ((None, "Great Hall", "nothing"), None), ((None, None, "x"), None)]


def m17_supported_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [f for f, _ in FILLS], "old string, new string, said string")
    return tallied(df, kept=extract.filled(F.col("old"), F.col("new"), F.col("said")))


#: claim, evidence, supported
CLAIMS = [(("Prizes of gold", "Gold prizes!"), True), (("Held in Rome", "paris"), False), (("a b c", "x"), True), ((" ", "x"), False)]


def f31_claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [c for c, _ in CLAIMS], "claim string, said string")
    return tallied(df, supported=extract.claim_supported(F.col("claim"), F.col("said")))


QUESTIONS = [("When does it start?", "factual"), ("Should I go?", "decision"), ("Is it worth my time?", "decision"), ("What are the risks and dates?", "decision"), ("worth it?", "decision"), ("", "factual"), ("How do I prioritize this?", "factual")]


def f32_question_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(over_orders(spark, sf_dir, [(q,) for q, _ in QUESTIONS], "question string"), kind=extract.question_kind(F.col("question")))


PAGES = [
    ("<h1>404</h1> page not found", "stale_or_missing_route"), ("<p>Please confirm you are human</p>", "human_verification"), ("Access denied", "blocked"), ("<p>event hackathon register</p> access denied", None), ("<p>fine</p>", None),
]


def f25_blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(over_orders(spark, sf_dir, [(p,) for p, _ in PAGES], "html string"), state=extract.blocked_state(F.col("html")))


ERRORS = [
    (("42P01", None, None), "schema_unavailable"), ((None, None, "relation x does not exist"), "schema_unavailable"), (("23505", None, None), "unique_conflict"), ((None, 403, None), "authorization"),
    ((None, 500, "fetch failed"), "temporary"), ((None, None, "JWT expired"), "authorization"), ((None, None, None), "unknown"),
]


def f28_store_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [e for e, _ in ERRORS], "code string, status int, message string")
    return tallied(df, kind=extract.store_error(F.col("code"), F.col("status"), F.col("message")))


def f40_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers' parts look like navigation, every fourth part being called Home."""
    li = tables.table(spark, sf_dir, "lineitem")
    title = F.when(F.col("l_partkey") % 4 == 0, " Home ").otherwise("Good Jam")
    return extract.navigation_share(li.select("l_suppkey", title.alias("title")), "l_suppkey", "title")


#: start, end, shown
SHOWN = [(("2026-07-04", "2026-07-06"), "Jul 4, 2026 – Jul 6, 2026"), (("2026-07-04", "2026-07-04"), "Jul 4, 2026"), ((None, "2026-07-04"), "Jul 4, 2026"), ((None, None), "Date unclear"), (("soon", None), "soon")]


def p32_shown_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [s for s, _ in SHOWN], "start string, finish string")
    return tallied(df, shown=extract.shown_range(F.col("start"), F.col("finish")))


SOURCES = [("mlh", "MLH"), ("hacklist", "HackList"), ("devpost", "Devpost"), ("custom:my-board", "My Board"), ("custom:hackathonmap", "Hackathon Map"), ("x", "X"), ("some_new site", "Some New Site")]


def p32_source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallied(over_orders(spark, sf_dir, [(s,) for s, _ in SOURCES], "source string"), label=extract.source_label(F.col("source")))


#: method, status, type, allowed; captured
ANSWERS = [(("GET", 200, "application/json", True), True), (("POST", 200, "application/json", True), False), (("get", 404, "application/json", True), False), (("GET", 200, "text/html", True), False), (("GET", 200, "text/plain", False), False), (("GET", 200, None, True), False)]


def s34_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = over_orders(spark, sf_dir, [a for a, _ in ANSWERS], "method string, status int, kind string, allowed boolean")
    return tallied(df, captured=extract.worth_capturing(F.col("method"), F.col("status"), F.col("kind"), F.col("allowed")))


#: page, then title, description, date, mode, way to apply, deadline
FETCHED = [
    ('<head><title>Own</title><meta property="og:title" content="Preview"></head><h1>H</h1><p>First <b>one</b></p><a href="/x">About</a><a href="join">Sign up</a> online. Apply by: Aug 1, 2026',
     ("Preview", "First one", None, "online", "https://e.org/a/join", "Aug 1, 2026")),
    ('<title> Own  title </title><meta content="Said" name="description"><time datetime="2026-09-01">Sep</time><a href="https://f.org/register">go</a> Deadline 2026-08-01 hybrid',
     ("Own title", "Said", "2026-09-01", "hybrid", "https://f.org/register", "2026-08-01")),
    ("<h1>Only <i>this</i></h1><time>soon</time>", ("Only this", None, "soon", None, None, None)), (None, (None,) * 6),
]


def p20_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of fetched pages."""
    df = over_orders(spark, sf_dir, [(h,) for h, _ in FETCHED], "html string")
    found = extract.page_fields(F.col("html"), F.lit("https://e.org/a/b"))
    return tallied(df, **{n: found[n] for n in ("title", "description", "date_text", "mode", "apply_url", "deadline_text")})


def p3_theme_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents the table of themes tags with what."""
    d = tables.table(spark, sf_dir, "documents")
    return d.groupBy(F.array_join(text.themes_of(F.col("text")), ",").alias("themes")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    p1_extract, p25_stored_rows, k9_sheet, p18_modes, s19_tag_modes, f20_likely_event, f20_upcoming, f21_content_theme, f18_promising_result, f19_promising_post, s24_posts, s25_post_leads, s21_detail_merge, p22_enriched,
    f31_fact_support, m17_supported_fill, f31_claim_support, f32_question_kind, f25_blocked_pages, f28_store_errors, f40_navigation, p32_shown_ranges, p32_source_labels, s34_capture, p20_page_fields, p3_theme_table,
)}

_KEPT = [(i, x[1]) for i, x in enumerate(LEADS) if x[1]]


def _leads_sql() -> str:
    """expected() for the leads that have a name: case numbers stay those of the whole table."""
    lit = lambda v: "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {', '.join(lit(v) for v in r)})" for i, r in _KEPT)
    return f"SELECT v.*, count(*) AS n FROM (VALUES {values}) v(case_no, {', '.join(_FIELDS)}) JOIN orders ON o_orderkey % {len(LEADS)} = case_no GROUP BY ALL"


_SRC = "CASE page_id % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(tables.SOURCES)) + " END"
_THEME = [(n, p) for n, p in text.THEMES.items()]
ORACLES = {
    "p1_extract": _leads_sql(),
    "p25_stored_rows": expected(["fingerprint", "status", "score", "summary"], [r[3] for r in _RECORDS]),
    "k9_sheet": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'READY_FOR_REVIEW' ELSE 'NEEDS_REVIEW' END || '|' || CAST(floor(o_totalprice) AS BIGINT) % 101 || '|record ' || o_custkey || '|' ||
               lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) || '||||||' || CASE WHEN o_orderkey % 2 = 0 THEN '2026-07-04' ELSE 'soon' END || '||||||a; b|||||' || strftime(o_orderdate, '%Y-%m-%d') || '|||' || o_orderkey AS row
        FROM orders
    """,
    "p18_modes": expected(["season", "calendar", "card"], [m[1] for m in MODES]),
    "s19_tag_modes": expected(["mode"], [(t[1],) for t in TAGS]),
    "f20_likely_event": expected(["likely"], [(e[1],) for e in ENTRIES]),
    "f20_upcoming": expected(["upcoming"], [(t[1],) for t in TIMES]),
    "f21_content_theme": expected(["named"], [(c[1],) for c in CONTENT]),
    "f18_promising_result": expected(["promising"], [(r[1],) for r in RESULTS]),
    "f19_promising_post": expected(["promising"], [(p[1],) for p in POSTS]),
    "s24_posts": """
        SELECT CAST(c_custkey AS VARCHAR) AS id, 0 AS position, 'ann' AS username, 'https://e.example/' || c_custkey || ' https://t.co/x https://jam' || c_custkey || '.devpost.com/' AS links FROM customer
        UNION ALL SELECT 'p' || c_custkey, 1, NULL, '' FROM customer
    """,
    "s25_post_leads": """
        SELECT 'x-' || c_custkey AS id, 'Hackathon! apply https://jam' || c_custkey || '.devpost.com/.' AS title, 'https://x.com/ann/status/' || c_custkey AS url, 'https://jam' || c_custkey || '.devpost.com/' AS official FROM customer
    """,
    "s21_detail_merge": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Detail ' || c_custkey ELSE c_name END AS title, c_mktsegment AS kind, CASE WHEN c_custkey % 2 = 0 THEN 'a,b,c' ELSE 'a,b' END AS tags FROM customer",
    "p22_enriched": None,
    "f31_fact_support": expected(["supported"], [(s[1],) for s in SUPPORT]),
    "m17_supported_fill": expected(["kept"], [(f[1],) for f in FILLS]),
    "f31_claim_support": expected(["supported"], [(c[1],) for c in CLAIMS]),
    "f32_question_kind": expected(["kind"], [(q[1],) for q in QUESTIONS]),
    "f25_blocked_pages": expected(["state"], [(p[1],) for p in PAGES]),
    "f28_store_errors": expected(["kind"], [(e[1],) for e in ERRORS]),
    "f40_navigation": "SELECT l_suppkey, round(avg(CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END), 4) AS share, avg(CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END) >= 0.4 AS noise FROM lineitem GROUP BY 1",
    "p32_shown_ranges": expected(["shown"], [(s[1],) for s in SHOWN]),
    "p32_source_labels": expected(["label"], [(s[1],) for s in SOURCES]),
    "s34_capture": expected(["captured"], [(a[1],) for a in ANSWERS]),
    "p20_page_fields": expected(["title", "description", "date_text", "mode", "apply_url", "deadline_text"], [f[1] for f in FETCHED]),
    "p3_theme_table": "SELECT themes, count(*) AS n FROM (SELECT array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])({p})([^A-Za-z0-9_]|$)') THEN '{n}' END" for n, p in _THEME) + "], lambda x: x IS NOT NULL), ',') AS themes FROM documents) GROUP BY 1",
}
ORACLES["p22_enriched"] = f"""
    WITH parts AS (SELECT page_id, {_SRC} AS source, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), ':[0-9]*$', ''), '^www\\.', '') AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/$', '') AS path,
                   regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
                   list_transform(list_sort(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_|fbclid|gclid|mc_|ref)')), lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': p}})), lambda x: x.p) AS kept FROM pages),
         ids AS (SELECT *, scheme || host || path || array_to_string(kept, '&') AS k FROM parts),
         chosen AS (SELECT page_id FROM ids WHERE source IN ('web', 'luma', 'x') ORDER BY page_id LIMIT 15)
    SELECT e AS enriched, CASE WHEN e THEN 'text — more' ELSE 'text' END AS text, count(*) AS n
    FROM (SELECT page_id IN (SELECT page_id FROM chosen) AND k IN (SELECT k FROM ids WHERE page_id % 2 = 0) AS e FROM ids) GROUP BY 1, 2
"""
