"""Structure of pages: units, tables, leads, kindred sets, fingerprints, schedules, labels."""

import itertools

from pyspark.sql import functions as F
from siftline.functions import dates, urls
from siftline.operators import layout
from siftline.sources import html, structure

BASE = "https://list.example/all"


def pages(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string")


def card(name, link="", extra=""):
    return f'<div class="card x{len(name)}"><h2>{name}</h2>{link}{extra}</div>'


def test_units_align_by_path_with_optional_and_reordered_parts(spark):
    body = card("Alpha Hackathon", '<a href="/a">go</a>', '<i class="d1">2026-09-05</i>') + '<div class="card x7"><i class="d22">2026-10-01</i><h2>Beta Jam</h2></div>' + card("Gamma Cup", '<a href="/g">go</a>')
    units = structure.units(pages(spark, f"<main>{body}</main>", None, "", "<p>one</p>"))
    assert {(r.shape, r.unit) for r in units.collect()} == {("div.card.xn", i) for i in range(3)}
    table = {r.unit: r.fields for r in layout.unit_table(units).collect()}
    assert table == {0: {"h2": "Alpha Hackathon", "a": "go", "i.dn": "2026-09-05"}, 1: {"h2": "Beta Jam", "i.dn": "2026-10-01"}, 2: {"h2": "Gamma Cup", "a": "go"}}
    assert {r.path: r.present for r in layout.columns(units).collect()} == {"h2": 3, "a": 2, "i.dn": 2}


def test_leads_of_units(spark):
    body = "".join([
        card("Registration closed", '<a href="mailto:x@y.z">m</a><a href="/all/">me</a><a href="/big-city-hack">go</a>', "<b>Registration closes: 2026-08-01</b>"),
        card("Paper Cup", "", "<b>Registration start: 2026-01-01</b><b>2026-09-01</b>"),
        card("Upcoming", '<a href="/one">x</a>', "<b>Tiny challenge | Berlin, Germany</b><b>Deadline: 2026-05-05</b><b>2026-06-06</b>"),
        card("Online Summit", '<a href="/one">x</a>', "<b>Registration open</b>"), card("Online Summit", '<a href="/one">x</a>', "<b>Registration open</b>"), card("Home"),
    ])
    units = structure.units(pages(spark, body))
    got = {r.title: r for r in layout.unit_leads(units, F.lit(BASE)).filter("tag = 'div'").collect()}
    assert set(got) == {"Big City Hack", "Paper Cup", "Tiny challenge", "Online Summit"} and got["Paper Cup"].start_day is None
    assert got["Big City Hack"].deadline_day == "2026-08-01" and got["Big City Hack"].start_day is None and got["Big City Hack"].status == "closed"
    tiny = got["Tiny challenge"]
    assert (tiny.start_day, tiny.deadline_day, tiny.place, tiny.url) == ("2026-06-06", "2026-05-05", "Berlin, Germany", "https://list.example/one")
    assert got["Online Summit"].mode.lower() == "online" and got["Online Summit"].status == "open"
    judged = {r.shape: r for r in layout.judged_sets(units, layout.unit_leads(units, F.lit(BASE))).collect()}
    assert judged["div.card.xn"].titled == round(4 / 6, 3) and judged["div.card.xn"].reasons == []


def test_titles(spark):
    texts = [["2026-01-01", "Open", "Global AI Hackathon"], ["Starts: 2026", "closed"], ["Alpha meetup · Oslo", "Alpha meetup Oslo"], [], ["https://x.example", "About"]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t array<string>")
    assert [r.x for r in df.select("i", layout.best_title(F.col("t")).alias("x")).orderBy("i").collect()] == ["Global AI Hackathon", None, "Alpha meetup", None, None]


def test_kindred_sets_equal_brute_force(spark):
    body = ""
    for n, (extra, tag) in enumerate(itertools.product(["", " hot", " hot big", " hot big new wide"], ["li", "div"])):
        unit = f'<{tag} class="card{extra}"><b>T</b><a href="/x">y</a></{tag}>'
        body += f"<section class='s{n}'>{unit * 2}</section>"
    units = structure.units(pages(spark, body))
    sets = layout.unit_sets(units)
    paths = {}
    for r in layout.columns(units).collect():
        paths.setdefault((r.parent_id, r.shape), set()).add("/" + r.path)
    tokens = {k: p | set(k[1].split(".")) for k, p in paths.items()}
    group = {k: k for k in tokens}
    for _ in tokens:
        for a, b in itertools.permutations(tokens, 2):
            if len(tokens[a] & tokens[b]) >= 0.6 * len(tokens[a] | tokens[b]):
                group[a] = group[b] = min(group[a], group[b])
    got = {(r.parent_id, r.shape): (r.group_parent, r.group_shape) for r in layout.kindred_sets(sets, units, 0.6).collect()}
    assert got == group and len(set(got.values())) > 1


def test_tree_fingerprints(spark):
    item = '<li class="r{}"><b>x</b></li>'
    lists = ["<ul>" + "".join(item.format(i) for i in range(n)) + "</ul>" for n in (2, 9)]
    menu = "<nav><a>h</a></nav><div><p>t</p><p>u</p></div>"
    rows = [lists[0] + menu, lists[1] + menu, menu + lists[0], lists[0] + "<table></table>" + menu, "", None]
    got = {r.page_id: r for r in structure.fingerprints(pages(spark, *rows)).collect()}
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint and got[3].fingerprint not in (got[0].fingerprint, got[2].fingerprint)
    assert got[4].fingerprint == got[5].fingerprint and got[4].nodes == 0 and got[1].nodes == 24
    pair = spark.createDataFrame([(got[0].sketch, got[2].sketch, got[4].sketch)], "a array<long>, b array<long>, c array<long>")
    same, none = pair.select(structure.likeness(F.col("a"), F.col("b")), structure.likeness(F.col("a"), F.col("c"))).first()
    assert same == 1.0 and none == 0.0  # what has moved is still there


def test_schedules(spark):
    body = "<li>Submissions open Sep 1 at 10:00 am EST and close: Sep 9, 2027</li><li>short</li><li>Event Sep 12 - Sep 14</li><li>Event begins Oct 1, 2026</li><li>Results posted Nov 2</li>"
    segments = html.cards(pages(spark, body, "<p>none</p>"), layout.SEGMENTS, {"text": layout.SEGMENTS})
    got = {r.kind: r.day for r in layout.schedule_days(segments, 2026).collect()}
    assert got == {"submission_open": "2026-09-01", "event_start": "2026-09-12", "event_end": "2026-09-14", "result_announcement": "2026-11-02"} | {"submission_deadline": got["submission_deadline"]}
    assert got["submission_deadline"] == "2027-09-09"


def test_dates_go_under_the_nearest_label(spark):
    rows = [(1, 1, None, "d0"), (1, 2, "a", None), (1, 3, None, "d1"), (1, 4, "b", None), (1, 9, None, "d2"), (1, 40, None, "d3"), (2, 1, "c", "d4"), (2, 2, None, None)]
    df = spark.createDataFrame(rows, "page long, at long, label string, day string")
    got = sorted(tuple(r) for r in layout.labelled_dates(df, "page", "at", "label", "day", 10).collect())
    assert got == [(1, 3, "d1", "a", 1), (1, 9, "d2", "b", 5), (2, 1, "d4", "c", 0)]
    assert layout.labelled_dates(df, "page", "at", "label", "day").count() == 4
    plan = layout.labelled_dates(df, "page", "at", "label", "day")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Join" not in plan


def _resolutions(df):
    """How often the plan takes dot segments out of an address."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(split(")


def test_addresses_are_resolved_once_for_all_that_reads_them(spark):
    units = structure.units(spark.createDataFrame([], "page_id long, html string"))
    href = F.explode(F.array_compact(F.col("parts.href"))).alias("h")
    once = _resolutions(units.select(href).select(urls.resolve(F.col("h"), F.lit(BASE)).alias("u")))
    assert 0 < once == _resolutions(layout.unit_leads(units, F.lit(BASE)))


def test_texts_that_may_be_dates_are_all_that_are(spark):
    texts = ["2026-07-01", " 1780000000\n", "1780000000123.5", "Sep 5,  2026", "on 2026-07-01T10:00Z", "Oslo", "Order 12 Hackathon", "5 Sep", "go", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.maybe_dateish(F.col("t")).alias("may"), dates.dateish(F.col("t")).isNotNull().alias("does")).collect()
    assert all(r.may or not r.does for r in rows) and sum(r.may for r in rows) == 5


def test_shared_paths_are_counted_without_texts(spark):
    part = lambda path, text="x": {"path": path, "tag": "b", "text": text, "href": None}
    rows = [(1, 0, "li", u, [part(p, f"{p}{u}") for p in paths]) for u, paths in enumerate([["h3", "a"], ["a", "h3"], ["h3"], []])] + [(1, 5, "p", 0, []), (1, 5, "p", 1, None)]
    units = spark.createDataFrame(rows, "page_id long, parent_id int, shape string, unit int, parts array<struct<path:string,tag:string,text:string,href:string>>")
    got = lambda least: {r.parent_id: (r.units, sorted(r.paths)) for r in layout.shared_paths(units, least).collect()}
    assert got(0.5) == {0: (4, ["a", "h3"]), 5: (2, [])}
    assert got(0.75) == {0: (4, ["h3"]), 5: (2, [])}
    found = {(r.parent_id, r.unit): r.fields for r in layout.unit_table(units, 0.75).collect()}
    assert found == {(0, 0): {"h3": "h30"}, (0, 1): {"h3": "h31"}, (0, 2): {"h3": "h32"}, (0, 3): {}}


def test_kindred_sets_read_units_once(spark):
    body = "".join(f"<section class='s{n}'>{'<p class=a><b>T</b></p>' * 2}</section>" for n in range(3))
    units = structure.units(pages(spark, body))
    out = layout.kindred_sets(layout.unit_sets(units), units)
    assert "MapInArrow" in units._jdf.queryExecution().toString()
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
