"""Text expressions: canonical forms, slugs, whole-word tests, hashes, summaries."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(c: Column) -> Column:
    """Lower case, without schemes and www., other runs than a-z and 0-9 as one space."""
    low = F.lower(F.coalesce(c, F.lit("")))
    for pattern, to in ((r"https?://", ""), (r"www\.", ""), (r"[^a-z0-9]+", " ")):
        low = F.regexp_replace(low, pattern, to)
    return F.trim(low)


def slugify(c: Column, limit: int = 80) -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, limit)


def has_word(c: Column, pattern: str) -> Column:
    """Whether pattern occurs as a whole ASCII word, in any case (null: no)."""
    return F.coalesce(F.lower(c).rlike(f"(^|[^a-z0-9_])({pattern})([^a-z0-9_]|$)"), F.lit(False))


def stable_key(*parts: Column) -> Column:
    """Non-empty parts joined by |, in lower case, white space collapsed."""
    kept = [F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts]
    return F.lower(F.regexp_replace(F.concat_ws("|", *kept), r"\s+", " "))


def identity_hash(*parts: Column) -> Column:
    """The first 16 hex digits of SHA-256 over parts joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def fnv1a_base36(c: Column) -> Column:
    """FNV-1a over the text's characters in 32 bits, in base 36."""
    codes = F.transform(F.split(c, ""), lambda x: F.when(x == "", F.lit(None)).otherwise(F.ascii(x)).cast("long"))
    folded = F.aggregate(
        F.filter(codes, lambda x: x.isNotNull()), F.lit(2166136261).cast("long"),
        lambda h, x: h.bitwiseXOR(x) * F.lit(16777619).cast("long") % F.lit(4294967296).cast("long"),
    )
    return F.lower(F.conv(folded.cast("string"), 10, 36))


def canonical_map(m: Column) -> Column:
    """A map as k:v pairs joined by |, in key order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), "|")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def tags(c: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that occur as whole words, in the table's order.

    Patterns that are plain words are looked up among the text's words, which are cut
    once; others take a pass over the text each.
    """
    plain = {name: p.split("|") for name, p in patterns.items() if re.fullmatch("[a-z0-9_|]+", p)}
    wanted = F.array(*[F.lit(w) for w in sorted({w for words in plain.values() for w in words})]) if plain else F.array().cast("array<string>")
    # the few words looked for, in place of the text's own, are what every pattern then goes through
    said = F.array_intersect(wanted, F.split(F.lower(c), "[^a-z0-9_]+"))

    def named(said):
        def hit(name):
            if name in plain:
                return F.coalesce(F.arrays_overlap(said, F.array(*[F.lit(w) for w in plain[name]])), F.lit(False))
            return has_word(c, patterns[name])

        return F.array_compact(F.array(*[F.when(hit(n), F.lit(n)) for n in patterns]))

    # the element of an array of one is worked out once, not at each use
    return F.element_at(F.transform(F.array(said), named), 1)


def word_cut(c: Column, limit: int) -> Column:
    """At most limit characters, cut back to a word's end, with an ellipsis if cut."""
    cut = F.regexp_replace(F.substring(c, 1, limit - 1), r"\s+\S*$", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("…")))


def tokens(c: Column) -> Column:
    """Distinct tokens of the canonical form, in order of appearance."""
    return F.array_distinct(F.filter(F.split(normalize_text(c), " "), lambda x: x != ""))


def support(claim: Column, evidence: Column, least: int = 4) -> Column:
    """Share of the claim's tokens of at least `least` letters that the evidence holds."""
    wanted = F.filter(tokens(claim), lambda x: F.length(x) >= least)
    return F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, tokens(evidence))) / F.size(wanted))


def word(pattern: str) -> str:
    """A pattern as a whole ASCII word, in any case."""
    return rf"(?i)(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


_WORD, _ANY_BORDER = "[A-Za-z0-9_]", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _groups(pattern: str) -> dict[int, tuple[int, list[str]]]:
    """Where each closed group of a pattern opens: its end and its alternatives; escapes and classes are passed over."""
    out, open_, i, in_class = {}, [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            start = i + 3 if pattern.startswith("(?:", i) else i + 1
            open_.append((i, [start]))
        elif c == "|" and open_:
            open_[-1][1].append(i + 1)
        elif c == ")" and open_:
            at, starts = open_.pop()
            out[at] = (i, [pattern[x : y - 1] for x, y in zip(starts, [*starts[1:], i + 1])])
        i += 1
    return out


def _first(rest: str) -> str | None:
    """The characters, for a class, that what follows begins with, if those are word characters for certain."""
    if rest.startswith("("):
        end, branches = _groups(rest).get(0, (None, []))
        if end is None or (rest[1] == "?" and rest[2] != ":") or re.match(r"[?*{]", rest[end + 1 :]):
            return None
        found = [_first(b) for b in branches]
        return None if None in found else "".join(sorted(set("".join(found).replace("0-9", "0123456789"))))
    if re.match(r"[A-Za-z0-9_](?![?*{])", rest):
        return rest[0]
    return "0-9" if re.match(r"\\d(?![?*{])|\\d\{[1-9]", rest) else None


def _ends_in_word(before: str) -> bool:
    """Whether a pattern's last character is a word character for certain."""
    if before.endswith(")"):
        for at, (end, branches) in _groups(before).items():
            if end == len(before) - 1:
                return not re.match(r"\(\?[^:]", before[at:]) and all(_ends_in_word(b) for b in branches)
        return False
    if re.search(r"(?<!\\)[A-Za-z0-9_]\?$", before):
        return _ends_in_word(before[:-2])
    return bool(re.search(r"(?<!\\)[A-Za-z0-9_]$|\\d(\{[1-9]\d*(,\d*)?\}|\+)?$", before))


def borders(pattern: str) -> str:
    """A pattern whose word borders are those of ASCII words: the engine's own also know other letters.

    Where a word surely follows, the border is one look back, taken only at the
    characters that it can begin with; where one surely ends, one look ahead.
    """
    parts, out = pattern.split(r"\b"), ""
    for n, part in enumerate(parts):
        if n:
            before, rest = r"\b".join(parts[:n]), r"\b".join(parts[n:])
            if (first := _first(rest)) is not None:
                out += f"(?=[{first}])(?<!{_WORD})"
            else:
                out += f"(?!{_WORD})" if _ends_in_word(before) else _ANY_BORDER
        out += part
    return out


def some(c: Column) -> Column:
    """Trimmed text, null if empty."""
    return F.nullif(F.trim(c), F.lit(""))


def flattened(c: Column) -> Column:
    """White space collapsed and trimmed, null if empty."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


#: Themes and the words that tell them, in order.
THEMES = {
    "AI": "ai", "agents": "agents?", "cloud": "cloud", "web3": "web3", "fintech": "fintech", "healthcare": "healthcare",
    "cybersecurity": "cybersecurity", "developer tools": "developer tools",
}
#: Place words in order of precedence, with city and country.
PLACES = [
    ("toronto", "Toronto", "Canada"), ("waterloo", "Waterloo", "Canada"), ("mississauga", "Mississauga", "Canada"), ("canada", None, "Canada"),
    ("san francisco", "San Francisco", "USA"), ("new york", "New York", "USA"), ("berkeley", "Berkeley", "USA"),
]
ONLINE = "online|remote|virtual|worldwide"
IN_PERSON = "in[- ]?person|on[- ]?site|in person"


def themes_of(c: Column) -> Column:
    """Themes that a text names; most name none, which one pass tells."""
    found = F.array_compact(F.array(*[F.when(c.rlike(word(p)), F.lit(name)) for name, p in THEMES.items()]))
    return F.when(c.rlike(word("|".join(THEMES.values()))), found).otherwise(F.array().cast("array<string>"))


def mode_of(c: Column) -> Column:
    """online, in-person or hybrid; both kinds of words make hybrid; null if neither is there."""
    online, local = c.rlike(word(ONLINE)), c.rlike(word(IN_PERSON))
    return F.when(c.rlike(word("hybrid|both")) | (online & local), "hybrid").when(online, "online").when(local, "in-person")


def location_mode(mode: Column) -> Column:
    return F.when(mode == "online", "remote").when(mode == "in-person", "in_person").when(mode == "hybrid", "hybrid").otherwise("unknown")


def place_of(c: Column) -> Column:
    """(city, region, country, location, mode, raw_text, confidence) of the first place word, else of an online word; null if neither."""
    kind = "struct<city:string,region:string,country:string,location:string,mode:string,raw_text:string,confidence:string>"

    def place(city, region, country, location, mode, raw, confidence):
        values = (city, region, country, location, mode, raw, confidence)
        names = ("city", "region", "country", "location", "mode", "raw_text", "confidence")
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, values)]).cast(kind)

    out = F.when(c.isNull(), F.lit(None).cast(kind))
    for words, city, country in PLACES:
        region = "Ontario" if city and country == "Canada" else None
        said = ", ".join(x for x in (city, country) if x)
        out = out.when(c.rlike(word(words)), place(city, region, country, said, "in_person", F.substring(c, 1, 250), "high" if city else "medium"))
    return out.when(c.rlike(word(ONLINE)), place("Remote", None, "Online", "Online", "remote", "Online", "high"))


#: Names of JSON fields that hold secrets, and values that look like one.
SECRET_KEY = "(?i)bearer|authorization|api[_-]?key|access[_-]?token|secret|password|credential"
SECRET_VALUE = r"(?i)bearer\s+[a-z0-9._~+/=-]+"


def clip(c: Column, most: int = 500, kept: int = 200) -> Column:
    """Texts of over `most` characters cut to `kept` and an ellipsis."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, kept), F.lit("…"))).otherwise(c)


#: Names of metadata fields that a log must not hold.
PRIVATE_KEY = "(?i)(api[_-]?key|token|secret|password|cookie|authorization|bearer|service[_-]?account|profile[_-]?path|rawHtml|prompt|chainOfThought|cot)"


def safe_metadata(m: Column) -> Column:
    """A map of texts without private fields; values of over 500 characters keep 200."""
    return F.transform_values(F.map_filter(m, lambda k, v: ~k.rlike(PRIVATE_KEY)), lambda k, v: clip(v))


def safe_evidence(m: Column) -> Column:
    """A map of texts without secret fields; a value that looks like a token is redacted."""
    return F.transform_values(F.map_filter(m, lambda k, v: ~k.rlike(SECRET_KEY)), lambda k, v: F.when(v.rlike(SECRET_VALUE), "[redacted]").otherwise(v))


def folded(c: Column) -> Column:
    """Hexadecimal runs of eight or more as #, numbers as n: what differs from one render to the next."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[a-f0-9]{8,}", "#"), "[0-9]+", "n")


def ratio(c: Column) -> Column:
    """A share within 0 and 1, to three places; null and NaN are 0."""
    known = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), known)), 3)


def json_object(c: Column) -> Column:
    """The JSON object in a text that may surround it with prose or a code fence; null if there is none."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(fenced), valid(bare))


def redacted(c: Column) -> Column:
    """A diagnostic message without tokens, keys, e-mail addresses and user folders."""
    for pattern, to in (
        (r"(?i)bearer\s+[a-z0-9._~+/=-]+", "Bearer [redacted]"), (r"(?i)(api[_-]?key|token|secret|password)\s*[=:]\s*\S+", "$1=[redacted]"),
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[email]"), (r"(/home/|/Users/)[^/\s]+", "$1[user]"), (r"\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def sentences(c: Column) -> Column:
    """Sentences of a text: cut after . ! or ? before a capital, a digit or a quote."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.filter(F.transform(F.split(flat, '(?<=[.!?])\\s+(?=[A-Z0-9“"])'), F.trim), lambda s: s != "")


def complete_sentence(c: Column) -> Column:
    """Whether a sentence has twelve characters, ends as one, and its last word is longer than two letters."""
    last = F.regexp_replace(F.regexp_extract(F.regexp_replace(F.trim(c), "[.!?\"')\\]]+$", ""), r"\S+$", 0), "[^A-Za-z]", "")
    return (F.length(F.trim(c)) >= 12) & F.trim(c).rlike("[.!?]$") & ~F.length(last).between(1, 2)


def cut_to_sentences(c: Column, least: int = 2, most: int = 3, limit: int = 420) -> Column:
    """Whole sentences: at least `least`, at most `most`, within the limit beyond the least; a long first one is cut at a word."""
    parts = sentences(c)
    first = F.try_element_at(parts, F.lit(1))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(done, s):
        joined = F.when(done["text"] == "", s).otherwise(F.concat(done["text"], F.lit(" "), s))
        fits = done["open"] & (done["n"] < most) & ~((done["n"] >= least) & (F.length(joined) > limit))
        return F.when(fits, F.struct(joined.alias("text"), (done["n"] + 1).alias("n"), F.lit(True).alias("open"))).otherwise(
            F.struct(done["text"].alias("text"), done["n"].alias("n"), F.lit(False).alias("open")))

    cut = F.concat(F.regexp_replace(F.substring(F.concat(first, F.lit(" ")), 1, limit), r"\s+\S*$", ""), F.lit("…"))
    return F.when(F.length(first) > limit, cut).otherwise(F.coalesce(F.aggregate(parts, start, step)["text"], F.lit("")))


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines; a text of one block with more than three sentences is cut after every third."""
    tidy = F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"[ \t]{2,}", " "))
    blocks = F.filter(F.transform(F.split(tidy, r"\n{2,}"), lambda b: F.trim(F.regexp_replace(b, "\n", " "))), lambda b: b != "")
    said = sentences(tidy)
    thirds = F.transform(F.sequence(F.lit(0), F.floor((F.size(said) - 1) / 3).cast("int")), lambda i: F.array_join(F.slice(said, i * 3 + 1, F.lit(3)), " "))
    return F.when(F.size(blocks) > 1, blocks).when(F.size(said) <= 3, F.array(tidy)).otherwise(thirds)


ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'"}


def display_text(c: Column) -> Column:
    """Text fit to be shown: no markup, entities, markdown, bullets or repeated white space."""
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>"):
        c = F.regexp_replace(c, pattern, " ")
    for entity, plain in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(plain))
    for pattern, to in ((r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"[*_`]{1,3}([^*_`]+)[*_`]{1,3}", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*•]\s+", ""), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def usable(c: Column, least: int = 24) -> Column:
    """Whether a text has enough letters and digits to be worth showing."""
    return F.coalesce(F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", "")) >= least, F.lit(False))


def display_source(*texts: Column) -> Column:
    """The first of the texts that is usable once cleaned; null if none is."""
    cleaned = [display_text(t) for t in texts]
    return F.coalesce(*[F.when(usable(t), t) for t in cleaned])
