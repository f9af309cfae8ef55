"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pieces by the tokenizer's own pattern.  Within a piece the
symbols form a doubly linked list and every adjacent pair that has a merge rule
sits in a heap by rank; the lowest rank is popped and merged until no rule is
left.  The count is initial symbols minus merges: no identifiers are emitted.
Pieces repeat, so each Python worker remembers the counts of short ones in a
table of bounded size.

Defined results: a null text counts as empty; empty has 0 tokens; a special
token's string inside a text counts as one token, as the library does by
default.  Texts of any length are counted whole, repeated rows each for itself,
an empty table gives no rows, and other columns pass through; an input column
with an output's name is replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, unclash


def _byte_symbols() -> list[str]:
    """The printable stand-in character of each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class PieceSplitter:
    """Cuts texts by the byte-level pattern, with the library's idea of letters.

    The regex module may know another Unicode version than the tokenizers.  The
    class of a code point that Python's own tables do not list is asked of the
    library, and a stand-in of that class takes its place while matching.
    """

    def __init__(self, pattern: str):
        import regex
        from tokenizers import pre_tokenizers

        self._find = regex.compile(pattern).findall
        self._iter = regex.compile(pattern).finditer
        self._late = regex.compile(r"[\u0558-\U0010FFFF]").search
        self._split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self._stand_in: dict[str, str] = {}

    def _class_of(self, c: str) -> str:
        found = self._stand_in.get(c)
        if found is None:
            found = c
            if unicodedata.category(c) == "Cn":
                letter, number = len(self._split("a" + c)) == 1, len(self._split("1" + c)) == 1
                found = "\u00e9" if letter else "\u0661" if number else "\ue000"
            self._stand_in[c] = found
        return found

    def __call__(self, text: str) -> list[str]:
        if text.isascii() or not self._late(text):
            return self._find(text)
        swapped = self._swapped(text)
        if swapped == text:
            return self._find(text)
        return [text[m.start() : m.end()] for m in self._iter(swapped)]

    def _swapped(self, text: str) -> str:
        return "".join(self._class_of(c) if c > "\u0557" else c for c in text)

    def spans(self, text: str, start: int = 0):
        """(start, end) of each piece from a piece's start on, lazily."""
        late = not text.isascii() and self._late(text, start)
        for m in self._iter(self._swapped(text) if late else text, start):
            yield m.span()


class MergeCounter(Recent):
    """piece -> number of tokens, by merging; a bounded memory of short pieces."""

    LIMIT, LONG = 800_000, 48

    def __init__(self, path: str):
        super().__init__(self.LIMIT)
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self._start = [vocab[s] for s in _byte_symbols()]
        self._rules: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            # one integer holds both the rank and the new symbol
            self._rules.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        self._special = [t["content"] for t in spec["added_tokens"]]
        self._pieces = PieceSplitter(public_tokenizers.PATTERN)

    def make(self, piece: str) -> int:
        return self.merged(piece.encode("utf-8", "surrogatepass"))

    def worth(self, piece: str) -> bool:
        return len(piece) <= self.LONG

    def merged(self, piece: bytes) -> int:
        """Symbols left of one piece: initial symbols minus merges."""
        symbol = list(map(self._start.__getitem__, piece))
        n = len(symbol)
        rules = self._rules
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rule = rules.get(symbol[i] << 32 | symbol[i + 1])
            if rule is not None:
                heap.append((rule >> 32) << 40 | i)
        heapq.heapify(heap)
        push, pop, merges = heapq.heappush, heapq.heappop, 0
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFFFF
            if symbol[i] < 0 or (j := after[i]) >= n:
                continue
            rule = rules.get(symbol[i] << 32 | symbol[j])
            if rule is None or rule >> 32 != entry >> 40:
                continue  # the pair has changed since it was pushed
            symbol[i], symbol[j] = rule & 0xFFFFFFFF, -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rule := rules.get(symbol[i] << 32 | symbol[k])) is not None:
                    push(heap, (rule >> 32) << 40 | i)
            if (h := before[i]) >= 0 and (rule := rules.get(symbol[h] << 32 | symbol[i])) is not None:
                push(heap, (rule >> 32) << 40 | h)
        return n - merges

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts, total = [text], 0
        for special in self._special:
            if special in text:
                cut = [p.split(special) for p in parts]
                total += sum(len(c) - 1 for c in cut)
                parts = [p for c in cut for p in c]
        get = self.__getitem__
        for part in parts:
            total += sum(map(get, self._pieces(part)))
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def count_tokens(
    df: DataFrame, path: str, limit: int = 1024, text_col: str = "text",
    n_bytes: str = "n_bytes", n_tokens: str = "n_tokens", over_limit: str = "over_limit",
) -> DataFrame:
    """Append byte and token counts of text_col under the vocabulary file at path.

    A narrow map: no shuffle, and only the text crosses to Python.
    """

    @F.arrow_udf("long")
    def tokens(texts):
        import pyarrow as pa

        one = counter(path).count
        return pa.array([one(t) for t in texts.to_pylist()], pa.int64())

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        unclash(df.withColumn("__n", tokens(text)).withColumn("__b", F.octet_length(text).cast("long")), n_bytes, n_tokens, over_limit)
        .withColumnsRenamed({"__n": n_tokens, "__b": n_bytes})
        .withColumn(over_limit, F.col(n_tokens) > limit)
    )
