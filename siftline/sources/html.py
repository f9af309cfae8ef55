"""Raw pages to rows: a node table, listing cards by selectors, tables, and embedded JSON.

HTML needs a parser, so this is one of the few Python boundaries: pages are
parsed once, in mapInArrow, into rows; everything after that is SQL.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

NODES = "page_id long, node_id int, parent_id int, tag string, depth int, shape string, href string, text string"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Rows that a task gathers before it passes them on, and pages that it takes from a batch at once.
ROWS_AT_ONCE, PAGES_AT_ONCE = 10_000, 64

#: A text and the plain tag, comment or doctype behind it: attributes in quotation marks, without references.
_PLAIN = re.compile(r"""([^<]*+)<(?:(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\n]+[A-Za-z_][A-Za-z0-9_.:-]*=(?:"[^"&<>]*"|'[^'&<>]*'))*)[ \t\n]*(/?)>|!--[^<>-]*-->|!DOCTYPE [^<>\[&]*>)""")
_ATTRIBUTE = re.compile(r"""([^\s=]+)=(?:"([^"]*)"|'([^']*)')""")
#: Elements whose contents are no markup; how those end is left to the parser unless it is plain.
_RAW = {tag: re.compile(rf"(?i)</\s*{tag}>?|<!--") for tag in ("script", "style")}
_ODD = {"title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}


def _shape(tag: str, found: dict) -> str:
    return ".".join([tag, *sorted((found.get("class") or "").split())])


@lru_cache(4096)
def _tag_of(name: str, attributes: str) -> tuple[str, dict, str]:
    """Tag, attributes and shape of a plain start tag; the same few occur again and again."""
    found = {n.lower(): a or b for n, a, b in _ATTRIBUTE.findall(attributes)}
    return name.lower(), found, _shape(name.lower(), found)


class _Tree(HTMLParser):
    """Collects nodes in document order; the text of a node is what stands directly in it.

    A node beyond a bound is skipped: its text belongs to the nearest node that is
    kept, and its end tag closes it and nothing else.

    Plain markup is read by one pattern, a match to a tag; from the first thing that
    is not plain on, the standard parser reads the page.
    """

    def __init__(self, most_nodes: int | None = None, most_depth: int | None = None):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[int, str]] = []  # row, or -1 if skipped, and tag
        self.kept: list[int] = []
        self.attrs: list[dict] = []
        self.most_nodes, self.most_depth = most_nodes, most_depth

    def feed(self, data):
        at = 0 if self.rawdata or self.cdata_elem else self._plain(data)
        if at < len(data):
            super().feed(data[at:])

    def _plain(self, html: str) -> int:
        """Reads plain markup and says where it ends."""
        at, match, rows, kept, open_ = 0, _PLAIN.match, self.rows, self.kept, self.open
        while m := match(html, at):
            text, closing, name, attributes, empty = m.groups()
            after = m.end()
            if closing:
                if attributes or empty:
                    return at
            elif name:
                tag, found, shape = _tag_of(name, attributes)
                if tag in _RAW:
                    last = _RAW[tag].search(html, after)
                    if empty or not last or last.group() != f"</{tag}>":
                        return at
                    after = last.end()
                elif tag in _ODD and not (tag == "title" and html.startswith("</title>", html.find("<", after))):
                    return at
            if text and kept:
                rows[kept[-1]][6] += unescape(text) if "&" in text else text
            if closing:
                name = name.lower()
                if open_ and open_[-1][1] == name:
                    if open_.pop()[0] >= 0:
                        kept.pop()
                else:
                    self.handle_endtag(name)
            elif name:
                self._start(tag, found, shape)
                if tag in _RAW or empty and tag not in VOID:
                    self.handle_endtag(tag)
            at = after
        return at

    def handle_starttag(self, tag, attrs):
        found = dict(attrs)
        self._start(tag, found, _shape(tag, found))

    def _start(self, tag, found, shape):
        beyond = (self.most_nodes is not None and len(self.rows) >= self.most_nodes) or (self.most_depth is not None and len(self.kept) >= self.most_depth)
        at = -1 if beyond else len(self.rows)
        if not beyond:
            self.rows.append([at, self.kept[-1] if self.kept else -1, tag, len(self.kept), shape, found.get("href"), ""])
            self.attrs.append(found)
        if tag not in VOID:
            self.open.append((at, tag))
            if at >= 0:
                self.kept.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][1] == tag:
                for at, _ in self.open[i:]:
                    if at >= 0:
                        self.kept.pop()
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open and self.open[-1][1] in ("script", "style"):
            return
        if self.kept:
            self.rows[self.kept[-1]][6] += data


def scanned(pages: DataFrame, schema: str, rows_of: Callable[[int, str], Iterable[tuple]]) -> DataFrame:
    """The rows that rows_of makes of each page (page_id, html), each page parsed once.

    A task holds few pages and few rows at a time, however many a batch has.
    """

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def scan(batches):
        import pyarrow as pa

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], arrow.names)

        rows: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, PAGES_AT_ONCE):
                part = batch.slice(start, PAGES_AT_ONCE)
                for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows.extend(rows_of(page, html or ""))
                    if len(rows) >= ROWS_AT_ONCE:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    return pages.select("page_id", "html").mapInArrow(scan, schema)


def nodes(pages: DataFrame, most_nodes: int | None = None, most_depth: int | None = None) -> DataFrame:
    """The node table of page_id, html; null pages have no nodes.

    Whole pages are read unless most_nodes or most_depth bound what a page may
    yield; then the text of what is left out is part of its nearest kept ancestor's.
    """

    def rows_of(page, html):
        tree = _Tree(most_nodes, most_depth)
        tree.feed(html)
        return [(page, *row) for row in tree.rows]

    return scanned(pages, NODES, rows_of)


def children(pages: DataFrame) -> DataFrame:
    """The node table with how many children each node has and the shapes of those, in order."""

    def rows_of(page, html):
        tree = _Tree()
        tree.feed(html)
        shapes: list[list[str]] = [[] for _ in tree.rows]
        for row in tree.rows:
            if row[1] >= 0:
                shapes[row[1]].append(row[4])
        return [(page, *row, len(s), " ".join(s) if s else None) for row, s in zip(tree.rows, shapes)]

    return scanned(pages, NODES + ", child_count int, child_shapes string", rows_of)


@lru_cache(4096)
def _fits(wanted: tuple, tag: str, shape: str) -> bool:
    """Whether a node of this tag and shape is what one of the selector's alternatives wants."""
    own = frozenset(shape.split(".")[1:])
    return any((not kind or kind == tag) and names <= own for kind, names in wanted)


def _parsed_selector(selector: str) -> tuple[tuple[str, frozenset], ...]:
    """"a.tile, .card" as (tag or nothing, classes) alternatives."""
    out = []
    for part in selector.split(","):
        tag, *classes = part.strip().split(".")
        out.append((tag, frozenset(classes)))
    return tuple(out)


class _Cards(_Tree):
    """A page's nodes with what a selector needs: each node's subtree as a range of rows, each selector's matches in order."""

    def __init__(self, html: str):
        super().__init__()
        self.feed(html)
        self.close()
        self.end = list(range(1, len(self.rows) + 1))
        for i in range(len(self.rows) - 1, -1, -1):
            if (up := self.rows[i][1]) >= 0:
                self.end[up] = max(self.end[up], self.end[i])

    def matches(self, wanted) -> list[int]:
        """The rows that match, in document order."""
        return [i for i, row in enumerate(self.rows) if _fits(wanted, row[2], row[4])]

    def text(self, i: int) -> str:
        return " ".join(" ".join(r[6] for r in self.rows[i : self.end[i]]).split())

    def first(self, i: int, found: list[int]) -> int | None:
        """The first of the found rows in the subtree of row i."""
        at = bisect_left(found, i)
        return found[at] if at < len(found) and found[at] < self.end[i] else None


def cards(pages: DataFrame, card: str, fields: dict[str, str]) -> DataFrame:
    """One row per card: page_id, position, shape and the fields of pages (page_id, html).

    ``card`` and the fields are selectors (tag, .class, tag.class, several by commas);
    a field is the text of the first match in the card, or an attribute of it if
    the selector ends in @name.  Cards within cards are cards of their own.
    """
    names = list(fields)
    outer = _parsed_selector(card)
    inner = [(_parsed_selector(s.partition("@")[0]), s.partition("@")[2] or None) for s in fields.values()]

    def rows_of(page, html):
        tree = _Cards(html)
        fields = [(tree.matches(wanted), attribute) for wanted, attribute in inner]
        for position, i in enumerate(tree.matches(outer)):
            row = [page, position, tree.rows[i][4]]
            for matched, attribute in fields:
                j = tree.first(i, matched)
                row.append(None if j is None else tree.attrs[j].get(attribute) if attribute else tree.text(j) or None)
            yield row

    return scanned(pages, "page_id long, position int, shape string" + "".join(f", {n} string" for n in names), rows_of)


def table_rows(pages: DataFrame) -> DataFrame:
    """Rows of the tables of pages (page_id, html): page_id, row_no, header (texts of th cells, of the table's first row that has any), cells."""

    def rows_of(page, html):
        tree, header, table = _Cards(html), [], None
        number = 0
        for i, row in enumerate(tree.rows):
            if row[2] == "table":
                header, table = [], i
            if row[2] != "tr" or table is None or i >= tree.end[table]:
                continue
            inside = range(i + 1, tree.end[i])
            heads = [tree.text(j) for j in inside if tree.rows[j][2] == "th"]
            found = [tree.text(j) for j in inside if tree.rows[j][2] == "td"]
            if heads and not found:
                header = header or heads
            elif found:
                yield page, number, header, found
                number += 1

    return scanned(pages, "page_id long, row_no int, header array<string>, cells array<string>", rows_of)


def column_of(header: Column, aliases: list[str], named: str | None = None) -> Column:
    """The place (from 0) of the column called `named`, else of the first that an alias names or is part of; -1 if none."""
    plain = F.transform(header, lambda h: F.trim(F.regexp_replace(F.lower(h), "[^a-z0-9]+", " ")))
    like = F.transform(plain, _any_alias(aliases))
    by_alias = F.array_position(like, True) - 1
    if named is None:
        return by_alias.cast("int")
    exact = F.array_position(F.transform(header, lambda h: F.lower(F.trim(h))), named.strip().lower()) - 1
    return F.when(exact >= 0, exact).otherwise(by_alias).cast("int")


def _any_alias(aliases: list[str]):
    def named(h):
        out = F.lit(False)
        for a in aliases:
            out = out | h.contains(a)
        return out

    return named


def json_scripts(html: Column) -> Column:
    """The contents of all JSON-LD scripts of a page, in order."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.filter(F.transform(found, F.trim), lambda x: x != "")


def repeated_units(table: DataFrame, least: int = 2) -> DataFrame:
    """Siblings of one shape under one parent in a node table: how many, how alike their texts and links are, and how sure that makes them a listing."""
    text = F.nullif(F.trim("text"), F.lit(""))
    out = table.groupBy("page_id", "parent_id", "shape").agg(
        F.count(F.lit(1)).alias("units"), F.count(text).alias("with_text"), F.countDistinct(text).alias("distinct_texts"), F.count("href").alias("with_href"), F.countDistinct("href").alias("distinct_hrefs")
    )
    return _sure(out.filter(F.col("units") >= least))


def page_units(pages: DataFrame, least: int = 2) -> DataFrame:
    """What repeated_units() says of nodes(pages); siblings are counted where their page is parsed, and no node is moved."""

    def rows_of(page, html):
        tree = _Tree()
        tree.feed(html)
        groups: dict[tuple, list[list]] = {}
        for row in tree.rows:
            groups.setdefault((row[1], row[4]), []).append(row)
        for (up, shape), found in groups.items():
            if len(found) >= least:
                texts, hrefs = [t for r in found if (t := r[6].strip(" "))], [r[5] for r in found if r[5] is not None]
                yield page, up, shape, len(found), len(texts), len(set(texts)), len(hrefs), len(set(hrefs))

    schema = "page_id long, parent_id int, shape string, units long, with_text long, distinct_texts long, with_href long, distinct_hrefs long"
    return _sure(scanned(pages, schema, rows_of))


def _sure(units: DataFrame) -> DataFrame:
    """Append confidence: 0.3 for distinct texts, 0.25 for distinct links, 0.2 for links at all and 0.25 for many units, each by its share."""
    sure = 0.3 * F.col("distinct_texts") / F.col("units") + 0.25 * F.col("distinct_hrefs") / F.col("units") + 0.2 * F.col("with_href") / F.col("units") + 0.25 * F.least(F.col("units") / 10, F.lit(1.0))
    return units.withColumn("confidence", F.round(sure, 4))


def embedded_json(html: Column, marker: str) -> Column:
    """The JSON text of the first script whose tag holds the marker."""
    return F.nullif(F.regexp_extract(html, rf"(?s)<script[^>]*{marker}[^>]*>(.*?)</script>", 1), F.lit(""))


def walk_json(df: DataFrame, key: str, column: str, depth: int = 12) -> DataFrame:
    """Every scalar of a JSON column as (key, path, value); what does not parse yields nothing."""
    kind = dict(df.dtypes)[key]

    def walk(value, path, left):
        if isinstance(value, dict) and left:
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}", left - 1)
        elif isinstance(value, list) and left:
            for v in value:
                yield from walk(v, f"{path}[]", left - 1)
        elif value is not None:
            yield path, json.dumps(value) if isinstance(value, (dict, list, bool)) else str(value)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, paths, values = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    parsed = json.loads(text) if text else None
                except ValueError:
                    continue
                for path, value in walk(parsed, "$", depth):
                    keys.append(k), paths.append(path), values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(paths, pa.string()), pa.array(values, pa.string())], [key, "path", "value"])

    return df.select(key, column).mapInArrow(run, f"{key} {kind}, path string, value string")


def api_page(payload: Column, item: str) -> Column:
    """The items of a paged JSON answer {items: [...], meta: {total_count}}; null if it is none."""
    return F.from_json(payload, f"items array<struct<{item}>>, meta struct<total_count:long>")
