"""The structure of pages: repeated units with the paths of their parts, and fingerprints of whole trees.

Both come from one parse per page; what is computed from them is SQL.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html import _Cards, scanned

UNITS = (
    "page_id long, parent_id int, parent_shape string, tag string, shape string, unit int, node_id int, depth int, text string, "
    "parts array<struct<path:string,tag:string,text:string,href:string>>"
)
PRINTS = "page_id long, nodes int, depth int, fingerprint string, sketch array<long>"


@lru_cache(65_536)
def folded(shape: str) -> str:
    """A shape with hexadecimal runs and digits folded, so that generated class names agree."""
    tag, dot, classes = shape.partition(".")
    return tag + dot + re.sub(r"\d+", "n", re.sub(r"[a-f0-9]{6,}", "#", classes))


def _own_path(tree: _Cards, node: int, unit: int) -> str:
    steps = []
    while node != unit:
        steps.append(folded(tree.rows[node][4]))
        node = tree.rows[node][1]
    return "/".join(reversed(steps))


def units(pages: DataFrame, least: int = 2, most_parts: int = 80) -> DataFrame:
    """Siblings of one shape: one row per unit with its parts in document order, each by its path below the unit.

    A part is a node with text of its own or an address; of a unit the first
    `most_parts` nodes count.  A path that occurs again in a unit gets a number.
    """

    def rows_of(page, html):
        tree = _Cards(html)
        groups: dict[tuple, list[int]] = {}
        for i, row in enumerate(tree.rows):
            groups.setdefault((row[1], folded(row[4])), []).append(i)
        for (up, shape), found in groups.items():
            if len(found) < least:
                continue
            for number, i in enumerate(found):
                parts, seen = [], {}
                for j in range(i, min(tree.end[i], i + most_parts)):
                    text, href = " ".join(tree.rows[j][6].split()) or None, tree.rows[j][5]
                    if text or href:
                        path = _own_path(tree, j, i) or "."
                        seen[path] = seen.get(path, 0) + 1
                        parts.append({"path": path if seen[path] == 1 else f"{path}:{seen[path]}", "tag": tree.rows[j][2], "text": text, "href": href})
                parent = tree.rows[up][4] if up >= 0 else ""
                yield page, up, folded(parent), tree.rows[i][2], shape, number, i, tree.rows[i][3], tree.text(i), parts

    return scanned(pages, UNITS, rows_of)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def fingerprints(pages: DataFrame, slots: int = 16) -> DataFrame:
    """A hash of each page's tree, bottom up, and a min-wise sketch of its subtrees.

    A node's hash is of its folded shape and its children's hashes, neighbours that
    are equal counted once: lists of other lengths agree, moved sections do not.
    """

    def rows_of(page, html):
        rows = _Cards(html).rows
        below: list[list[int]] = [[] for _ in rows]
        roots, seen = [], set()
        for i in range(len(rows) - 1, -1, -1):
            kids = below[i][::-1]
            kept = [k for n, k in enumerate(kids) if n == 0 or k != kids[n - 1]]
            digest = _digest(f"{folded(rows[i][4])}({','.join(map(str, kept))})")
            seen.add(digest)
            (below[rows[i][1]] if rows[i][1] >= 0 else roots).append(digest)
        tops = [k for n, k in enumerate(roots[::-1]) if n == 0 or k != roots[::-1][n - 1]]
        sketch = [min(_digest(f"{slot}:{d}") for d in seen) for slot in range(slots)] if seen else []
        whole = hashlib.sha256(",".join(map(str, tops)).encode()).hexdigest()[:24]
        yield page, len(rows), max((r[3] for r in rows), default=-1) + 1, whole, sketch

    return scanned(pages, PRINTS, rows_of)


def likeness(a: Column, b: Column) -> Column:
    """The share of two sketches' slots that agree, an estimate of how many subtrees the pages share."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.greatest(F.size(a), F.lit(1))


def page_fingerprint(html: Column, length: int = 12_000) -> Column:
    """A page's text with single blanks, its first characters hashed."""
    return F.substring(F.sha2(F.substring(F.regexp_replace(html, r"\s+", " "), 1, length), 256), 1, 16)


def shape_signature(mechanism: Column, tag: Column, units: Column, titles: Column) -> Column:
    """A listing's shape hashed: how it was read, its units' tag and number, its first three titles."""
    sample = F.array_join(F.slice(F.coalesce(titles, F.array().cast("array<string>")), 1, 3), "|")
    raw = F.concat(mechanism, F.lit("|"), F.coalesce(tag, F.lit("?")), F.lit("|"), F.coalesce(units, F.lit(0)).cast("string"), F.lit("|"), sample)
    return F.substring(F.sha2(raw, 256), 1, 24)
