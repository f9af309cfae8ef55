"""JSON of any shape rewritten inside the engine, as VARIANT values: canonical text, deep redaction, call keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that hold secrets, and what a token looks like in a text.
SECRET_KEYS = "(?i)bearer|authorization|api[_-]?key|access[_-]?token|secret|password|credential"
BEARER = r"(?i)bearer\s+[a-z0-9._~+/=-]+"

DEPTH = 12


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _rewritten(v: Column, keep: Callable[[Column], Column] | None, scalar: Callable[[Column], Column], depth: int) -> Column:
    """The JSON text of a variant, its members told apart once per level; below `depth` it stays as it is."""
    if depth == 0:
        return F.to_json(v)
    members = F.when(_is(v, "OBJECT"), F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))).when(
        _is(v, "ARRAY"), F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("value")))
    )
    if keep is not None:
        members = F.filter(members, lambda m: m["key"].isNull() | keep(m["key"]))
    quoted = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r"^\{\"k\":(.*)\}$", 1)
    text = F.transform(members, lambda m: F.concat(F.when(m["key"].isNotNull(), F.concat(quoted(m["key"]), F.lit(":"))).otherwise(""), F.coalesce(_rewritten(m["value"], keep, scalar, depth - 1), F.lit("null"))))
    # the members stand in the expression once, so that it grows with the depth and not with two to its power
    opening, closing = (F.when(_is(v, "OBJECT"), a).otherwise(b) for a, b in ("{[", "}]"))
    return F.coalesce(F.concat(opening, F.array_join(text, ","), closing), scalar(v))


def canonical(json: Column, depth: int = DEPTH) -> Column:
    """The JSON text with sorted keys and no blanks; null for what does not parse.  Variants sort keys at every depth."""
    return F.to_json(F.try_parse_json(json))


def redacted(json: Column, depth: int = DEPTH) -> Column:
    """Canonical JSON without the members whose keys hold secrets, at any depth and inside lists, and with token texts masked.

    `depth` is how many levels are searched; what lies deeper stays as it is.
    """
    scalar = lambda v: F.when(_is(v, "STRING") & F.try_variant_get(v, "$", "string").rlike(BEARER), F.lit('"[redacted]"')).otherwise(F.to_json(v))
    return _rewritten(F.try_parse_json(json), lambda k: ~k.rlike(SECRET_KEYS), scalar, depth)


def call_key(name: Column, arguments: Column) -> Column:
    """A call's name with its canonical arguments: calls that differ in the order of keys are one."""
    return F.concat(name, F.lit(":"), F.coalesce(canonical(arguments), F.lit("null")))
