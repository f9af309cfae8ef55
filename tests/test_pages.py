"""HTML node tables, JSON walks, and sinks."""

import pytest
from pyspark.sql import functions as F
from siftline.operators import sinks
from siftline.sources import html, tables


def test_node_table(spark):
    page = '<div class="b a"><p>one<br>two</p><p>x &amp; y</p><script>var a = "<p>";</script></div><ul><li><a href="/u">L</a></ul>'
    rows = html.nodes(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")).orderBy("node_id").collect()
    assert [(r.tag, r.parent_id, r.depth) for r in rows] == [("div", -1, 0), ("p", 0, 1), ("br", 1, 2), ("p", 0, 1), ("script", 0, 1), ("ul", -1, 0), ("li", 5, 1), ("a", 6, 2)]
    assert rows[0].shape == "div.a.b" and rows[1].text == "onetwo" and rows[3].text == "x & y" and rows[4].text == "" and rows[7].href == "/u"
    units = html.repeated_units(html.nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))).collect()
    assert [(u.shape, u.units, u.distinct_texts) for u in units] == [("p", 2, 2)]


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 1}, {"b": true}], "c": null}'), (2, "no"), (3, None)], "id long, j string")
    assert [(r.id, r.path, r.value) for r in html.walk_json(df, "id", "j").collect()] == [(1, "$.a[].b", "1"), (1, "$.a[].b", "true")]
    text = '<script id="app" type="application/json">{"k": 1}</script>'
    assert spark.range(1).select(html.embedded_json(F.lit(text), 'id="app"').alias("x")).first().x == '{"k": 1}'


def test_snapshot_and_appends(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    for n in (3, 5):
        sinks.write_snapshot(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    # a snapshot may be made from the table that it replaces
    sinks.write_snapshot(spark.read.parquet(path).filter("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]

    log_path = f"file://{tmp_path}/log"
    entries = spark.createDataFrame([(1, 7, 10), (2, 7, 11), (3, 8, 5)], "event_id long, job_id long, ts long")
    sinks.append_entries(None, entries, log_path)
    sinks.append_entries(spark.read.parquet(log_path), entries.withColumn("event_id", F.col("event_id") + 10), log_path)
    got = sorted((r.job_id, r.sequence) for r in spark.read.parquet(log_path).collect())
    assert got == [(7, 1), (7, 2), (7, 3), (7, 4), (8, 1), (8, 2)]


def test_sources_that_fail_are_left_out_and_named(spark):
    good = lambda: spark.createDataFrame([(1, "a")], "id long, title string")
    other = lambda: spark.createDataFrame([(2,)], "id long")
    missing = lambda: spark.read.parquet("file:///no/such/table")
    df, failed = tables.scan_sources({"a": good, "b": missing, "c": other}, ["c", "b", "a", "c"])
    assert sorted((r.source, r.id, r.title) for r in df.collect()) == [("a", 1, "a"), ("c", 2, None)]
    assert list(failed) == ["b"] and "PATH_NOT_FOUND" in failed["b"]
    assert tables.scan_sources({"b": missing})[0] is None
    with pytest.raises(ValueError):
        tables.scan_sources({"a": good}, ["z"])


def test_skipped_tags_do_not_close_outer_ones(spark):
    page = "<div><section><div><p>deep</p></div>after</section><b>x</b></div><p>end</p>"
    rows = html.nodes(spark.createDataFrame([(1, page)], "page_id long, html string"), most_depth=2).orderBy("node_id").collect()
    assert [(r.tag, r.parent_id, r.text) for r in rows] == [("div", -1, ""), ("section", 0, "deepafter"), ("b", 0, "x"), ("p", -1, "end")]
    whole = html.nodes(spark.createDataFrame([(1, "<i>" * 5000 + "x")], "page_id long, html string"))
    assert whole.count() == 5000 and whole.agg(F.max("depth")).first()[0] == 4999


def test_sheet_is_idempotent(spark):
    c = tables.candidates(spark, "/root/testdata/sf0.001")
    sheet = sinks.sheet_rows(c.limit(0))
    first = sinks.sheet_rows(sinks.pending(c, sheet))
    assert first.count() == c.filter("status = 'APPROVED'").count() and sinks.pending(c, first).count() == 0
    sinks.check_header(first.columns)
    with pytest.raises(ValueError):
        sinks.check_header(["id"])


def test_plain_markup_and_the_standard_parser_give_the_same_nodes():
    from html.parser import HTMLParser

    odd = [
        "<p class='b a'>x<br>y<br/>z &amp; &lt;b&gt;</p>tail", "a < b <p>c</p> d & e", "<div><p>one<p>two</div>three</p>", "<a href=x>q</a>", '<a href="?a=1&amp;b=2">q</a>', "<a disabled href='x' href='y'>q</a>",
        '<script>var t="</p>";</script><p>in</p>', "<script>a</SCRIPT ><b>c</b>", "<style>p{}</style>t<style/><p>u</p>", "<script>never closed <p>x", "<!-- a - b --><p>c</p><!-- <p> -->d", "<!DOCTYPE html><HTML><Body CLASS=\"K\">t</BODY>",
        "<title>a &amp; b</title><title>x<b>y</b></title>", "<textarea><p>q</p></textarea>", "<svg><path d='1'/></svg>", "<p", "<p>x</", "text only", "text & more", "<div/>after<br />x<p/>y", "<a\tb='1'\n c=\"2\" >x</a>", "</p><b></i>x</b>", "<![CDATA[x]]><b>y</b>", "<?pi ?><b>y</b>", "",
        "<ul><li>1<li>2</ul>&nbsp;&#65;&bogus; <i>&copy</i>", "<a-b>c</a-b>", "<p>é<b x=\"é\">中</b></p>",
    ]
    for html_ in [*odd, *[a + b for a in odd for b in odd]]:
        for most in ((None, None), (2, None), (None, 1)):
            plain, slow = html._Tree(*most), html._Tree(*most)
            plain.feed(html_)
            HTMLParser.feed(slow, html_)
            assert (plain.rows, plain.attrs, plain.open, plain.kept, plain.rawdata) == (slow.rows, slow.attrs, slow.open, slow.kept, slow.rawdata), html_


def test_plain_markup_never_reaches_the_standard_parser(monkeypatch):
    from html.parser import HTMLParser

    monkeypatch.setattr(HTMLParser, "feed", None)
    tree = html._Tree()
    tree.feed('<!DOCTYPE html><html><title>t</title><div class="b a"><a href="/x">q &amp; r</a><br><!-- c --></div><script>if ("</p>") {}</script></html>')
    assert [r[4] for r in tree.rows] == ["html", "title", "div.a.b", "a", "br", "script"] and tree.rows[3][5:] == ["/x", "q & r"]


def test_tasks_hold_few_rows_of_a_batch():
    import pyarrow as pa

    class Pages:
        def select(self, *_):
            return self

        def mapInArrow(self, scan, schema):  # noqa: N802
            return scan

    batch = pa.RecordBatch.from_pydict({"page_id": list(range(100)), "html": ["<ul>" + "<li>x</li>" * 500 + "</ul>"] * 100})
    sizes = [b.num_rows for b in html.nodes(Pages())(iter([batch]))]
    assert sum(sizes) == 50_100 and max(sizes) <= html.ROWS_AT_ONCE + 501


def test_units_counted_in_the_parse_equal_those_of_the_node_table(spark):
    pages = spark.createDataFrame([(1, "<ul><li> a </li><li>a</li><li><a href='/x'>q</a></li></ul><p>\tb</p><p></p><a href='/y'></a><a href='/y'>z</a><a>w</a>"), (2, None), (3, "<b>x</b>" * 12)], "page_id long, html string")
    counted, grouped = html.page_units(pages), html.repeated_units(html.nodes(pages))
    assert counted.dtypes == grouped.dtypes
    assert sorted(counted.collect()) == sorted(grouped.collect()) and counted.count() > 3
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
