"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can come last
in the prefix's encoding: the token t of length k for which the encoding of the
prefix without its last k bytes ends in a token s such that s followed by t
stays as it is when merged.  Storing that token for every prefix gives the
encoding by walking back from the end.  An automaton of the vocabulary names the
tokens that end at each byte, longest first, so only those are tried.

Bytes can be appended exactly.  An edit recomputes prefixes from the place of
the edit until as many entries in a row as the longest token has bytes are what
they were: from there on nothing can differ.  ``TextTable`` does the same for a
text of many pieces: pieces that end well before the edit stay, and from the
first boundary after the edit that is an old boundary all others stay too.

Defined results: a null text is empty; empty encodes to no ids and decodes to
nothing; ids decode to the very bytes that were encoded; null ids decode to null.
Texts of any length are encoded whole, repeated rows each for itself, an empty
table gives no rows, and input columns with an output's name are replaced.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, unclash
from .token_count import PieceSplitter

_NONE = 1 << 40


class _Pairs(Recent):
    """s << 32 | t, both as entries -> whether s then t stays s then t when their bytes are merged together."""

    def __init__(self, ranks: "Ranks"):
        super().__init__(600_000)
        self.ranks = ranks

    def make(self, key: int) -> bool:
        """Both sides merge as they would alone until a pair across the border comes first, if one does."""
        rank = self.ranks.rank.get
        lows_a, _, lasts = self.ranks.history(key >> 32 + self.ranks.bits)
        lows_b, firsts, _ = self.ranks.history((key & 0xFFFFFFFF) >> self.ranks.bits)
        i = j = 0
        x, y = lasts[0], firsts[0]
        across = rank(x + y, _NONE)
        while True:
            a, b = lows_a[i], lows_b[j]
            if across < a and across <= b:
                return False
            if a <= b:
                if a == _NONE:
                    return True
                i += 1
                if lasts[i] != x:
                    x = lasts[i]
                    across = rank(x + y, _NONE)
            else:
                j += 1
                if firsts[j] != y:
                    y = firsts[j]
                    across = rank(x + y, _NONE)


class Ranks:
    """A vocabulary file of ranks, with the pairs found valid so far.

    An entry is a token's rank and, in the lowest bits, its length.
    """

    def __init__(self, path: str):
        import ahocorasick

        self.rank: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token)] = int(rank)
        self.token = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.bits = self.longest.bit_length()
        ends = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in self.rank.items():
            ends.add_word(t.decode("latin-1"), r << self.bits | len(t))
        ends.make_automaton()
        self.ends = ends.iter
        self.follows = _Pairs(self)
        self._history: dict[int, tuple] = {}

    def history(self, r: int) -> tuple[list[int], list[bytes], list[bytes]]:
        """Merging the token's bytes, lowest rank first: each merge's rank, the first and the last part before it."""
        found = self._history.get(r)
        if found is None:
            rank, piece = self.rank, self.token[r]
            parts = [piece[i : i + 1] for i in range(len(piece))]
            pairs = [rank.get(a + b, _NONE) for a, b in zip(parts, parts[1:])]
            lows, firsts, lasts = [], [parts[0]], [parts[-1]]
            while pairs and (best := min(pairs)) != _NONE:
                i = pairs.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = rank.get(parts[i - 1] + parts[i], _NONE)
                if i < len(pairs):
                    pairs[i] = rank.get(parts[i] + parts[i + 1], _NONE)
                lows.append(best), firsts.append(parts[0]), lasts.append(parts[-1])
            found = self._history[r] = ([*lows, _NONE], firsts, lasts)
        return found

    def alone(self, entry: int) -> bool:
        """Whether the token's own bytes encode to the token."""
        r = entry >> self.bits
        return self.history(r)[2][-1] == self.token[r]

    def extend(self, data: bytes, last: list[int], most: int | None = None) -> None:
        """Append to last the last token's entry for each further prefix of data, of `most` at most."""
        done, follows, size = len(last) - 1, self.follows, (1 << self.bits) - 1
        goal = len(data) if most is None else min(len(data), done + most)
        low = max(0, done - self.longest + 1)
        text, after = data[low:goal].decode("latin-1"), low + 1
        done -= low
        for at, t in self.ends(text):
            if at < done:
                continue
            start = at + after - (t & size)
            if follows[last[start] << 32 | t] if start else self.alone(t):
                done += 1
                last.append(t)
        if len(last) <= goal:
            raise ValueError("the vocabulary lacks a byte")

    def walked(self, last: list[int]) -> list[int]:
        """The ids that a table of last tokens stands for, from the end back."""
        out, end, bits, size = [], len(last) - 1, self.bits, (1 << self.bits) - 1
        while end:
            t = last[end]
            out.append(t >> bits)
            end -= t & size
        out.reverse()
        return out


class PrefixTable:
    """The last token of each byte prefix; grows by append, exact at every length."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, data, [-1]
        ranks.extend(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.ranks.extend(self.data, self.last)

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace bytes; how many entries were computed anew.

        Prefixes up to the edit keep their tokens.  After it, entries depend on the
        ``longest`` entries and bytes before them alone: once so many agree with the
        old ones in a row, all the rest are the old ones.
        """
        was, longest = self.last, self.ranks.longest
        self.data = self.data[:at] + inserted + self.data[at + removed :]
        now, shift = was[: at + 1], len(inserted) - removed
        first = at + len(inserted)  # from here on the bytes are the old ones
        while len(now) <= len(self.data):
            self.ranks.extend(self.data, now, longest)
            end = len(now) - 1
            if end - longest >= first and now[end - longest :] == was[end - longest - shift : end - shift + 1]:
                now += was[end - shift + 1 :]
                self.last = now
                return end - at
        self.last = now
        return len(self.data) - at

    def ids(self) -> list[int]:
        return self.ranks.walked(self.last)


class TextTable:
    """A whole text's pieces with their prefix tables; edits and appends redo what is near them."""

    #: How many characters after a piece the pattern may look at.
    AHEAD = 2

    def __init__(self, one: "Codec", text: str = ""):
        self.codec, self.text = one, ""
        self.starts: list[int] = []
        self.tables: list[PrefixTable] = []
        self.edit(0, 0, text)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), 0, more)

    def edit(self, at: int, removed: int, inserted: str) -> int:
        """Replace characters; how many entries were computed anew."""
        from bisect import bisect_left, bisect_right

        old, starts, tables, shift = self.text, self.starts, self.tables, len(inserted) - removed
        self.text = old[:at] + inserted + old[at + removed :]
        ends = [*starts[1:], len(old)] if starts else []
        keep = bisect_right(ends, at - self.AHEAD)  # these pieces end before anything that changes
        begin = ends[keep - 1] if keep else 0
        new_starts, new_tables, computed, spare = starts[:keep], tables[:keep], 0, keep
        for start, end in self.codec.pieces.spans(self.text, begin):
            if start >= at + len(inserted):
                i = bisect_left(starts, start - shift)
                if i < len(starts) and starts[i] == start - shift:
                    new_starts += [s + shift for s in starts[i:]]
                    new_tables += tables[i:]
                    break
            piece = self.text[start:end].encode("utf-8", "surrogatepass")
            if start < at and spare < len(starts) and starts[spare] == start:
                table, spare = tables[spare], spare + 1
                a, b, n = table.data, piece, 0
                most = min(len(a), len(b))
                while n < most and a[n] == b[n]:
                    n += 1
                m = 0
                while m < most - n and a[-1 - m] == b[-1 - m]:
                    m += 1
                computed += table.edit(n, len(a) - n - m, b[n : len(b) - m])
            else:
                table = PrefixTable(self.codec.ranks, piece)
                computed += len(piece)
            new_starts.append(start)
            new_tables.append(table)
        self.starts, self.tables = new_starts, new_tables
        return computed

    def ids(self) -> list[int]:
        return [t for table in self.tables for t in table.ids()]


class Codec(Recent):
    """piece -> its ids as 32-bit numbers, remembered for short pieces up to a bound."""

    LIMIT, LONG = 700_000, 48

    def __init__(self, path: str, pattern: str):
        super().__init__(self.LIMIT)
        self.ranks = Ranks(path)
        self.pieces = PieceSplitter(pattern)
        self._text = {r: str(r) for r in self.ranks.token}

    def make(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.rank.get(data)
        if whole is not None:
            return array("i", (whole,)).tobytes()
        last = [-1]
        self.ranks.extend(data, last)
        return array("i", self.ranks.walked(last)).tobytes()

    def worth(self, piece: str) -> bool:
        return len(piece) <= self.LONG

    def encode(self, text: str | None) -> array:
        return array("i", b"".join(map(self.__getitem__, self.pieces(text))) if text else b"")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.ranks.token.__getitem__, ids))

    def listed(self, ids) -> str:
        return ",".join(map(self._text.__getitem__, ids))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Append the token ids of text_col as an array of ints: a narrow map."""

    @F.arrow_udf("array<int>")
    def ids(texts):
        import pyarrow as pa

        one = codec(path, pattern)
        return pa.array([one.encode(t).tolist() for t in texts.to_pylist()], pa.list_(pa.int32()))

    df = df.withColumn("__ids", ids(F.coalesce(F.col(text_col), F.lit(""))))
    return unclash(df, out).withColumnRenamed("__ids", out)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Append the bytes that ids_col stands for; null ids decode to null."""

    @F.arrow_udf("binary")
    def data(ids):
        import pyarrow as pa

        one = codec(path, pattern)
        return pa.array([None if x is None else one.decode(x) for x in ids.to_pylist()], pa.binary())

    df = df.withColumn("__data", data(F.col(ids_col)))
    return unclash(df, out).withColumnRenamed("__data", out)


def digests(df: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Append n_tokens, ids_sha256 and decoded_sha256: encode, then decode the ids.

    Both directions run in one pass over each batch, so ids need not travel
    unless they are asked for, as column ids.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    def both(texts):
        import pyarrow as pa

        one, counts, ids_hex, data_hex, kept = codec(path, pattern), [], [], [], []
        for text in texts.to_pylist():
            ids = one.encode(text)
            counts.append(len(ids))
            ids_hex.append(sha256(one.listed(ids).encode()).hexdigest())
            data_hex.append(sha256(one.decode(ids)).hexdigest())
            if with_ids:
                kept.append(ids.tobytes())
        columns = [pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(data_hex, pa.string())]
        if with_ids:
            offsets = pa.array([0, *accumulate(counts)], pa.int32())
            columns.append(pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int32(), sum(counts), [None, pa.py_buffer(b"".join(kept))])))
        return pa.StructArray.from_arrays(columns, names)

    df = df.withColumn("__x", both(F.coalesce(F.col(text_col), F.lit(""))))
    return unclash(df, *names).select("*", "__x.*").drop("__x")
