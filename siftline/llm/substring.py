"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words.  Each window is governed by one of its
``phrase``-word phrases, the one with the smallest hash, so equal windows are
governed by equal phrases, and a window can recur only if its phrase does.

1. Every document yields its governing phrases' hashes and places; those that
   occur more than once in the corpus are confirmed by counting.
2. Documents are dealt into shards of about ``shard_words`` words, and the
   confirmed phrases with them: each goes, as the place of one occurrence, to the
   shards that hold it.  A shard's phrases are compiled, from their words, into
   Aho-Corasick automata whose letters are words, and all its documents are
   streamed through them.  The automata alone locate occurrences.
3. The windows governed by a located phrase are compared: within the shard word
   for word, then across shards by the smallest document that has them, under a
   128-bit digest.  A window that also starts earlier is marked, and marked
   windows' words are removed.

Texts travel to the shards compressed.  Documents with the same word sequence as
an earlier one (by SHA-256) need no search: every window of theirs starts earlier.

Defined results: null, empty and white-space texts have no words; texts shorter
than a window keep all words; a null identifier comes after all others; rows
that repeat an identifier are documents of their own, in an arbitrary but fixed
order (that of their texts' hashes).  Documents are dealt by identifier and text, so
that any number of null identifiers spreads over the shards; what has fewer words than a
window goes to none.  Texts of any length are searched whole (a very long one fills a shard of
its own); an empty table gives no rows; other columns are not returned, so their
names cannot clash.
"""

from __future__ import annotations

import re
from hashlib import sha256
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gram_hashes, materialize, word_hashes, words_of

_LAST = 2**63 - 1


_STRETCH = 1 << 20


def governors(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` phrases, the position of its smallest hash (the rightmost of equals).

    Hashes carry their place in their lowest 20 bits, so a running minimum, built up
    from minima of 2, 4, 8, ... phrases, names the place too; equal windows have
    equal hashes at equal distances, and so the same governor.
    """
    n, out = len(g) - width + 1, []
    for low in range(0, max(n, 0), _STRETCH - width + 1):
        part = g[low : low + _STRETCH]
        place = np.arange(_STRETCH - 1, _STRETCH - 1 - len(part), -1, np.int64).astype(np.uint64)
        least, size, m = part & np.uint64(2**64 - _STRETCH) | place, 1, len(part) - width + 1
        while size * 2 <= width:
            least, size = np.minimum(least[: len(least) - size], least[size:]), size * 2
        least = np.minimum(least[:m], least[width - size : width - size + m])
        out.append(low + _STRETCH - 1 - (least & np.uint64(_STRETCH - 1)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _first_pass(window: int, phrase: int):
    @F.arrow_udf("n_words int, digest binary, phrases array<long>, places array<int>, again array<long>")
    def scanned(texts):
        import pyarrow as pa

        n, digest, phrases, places, again = [], [], [], [], []
        for text in texts.to_pylist():
            words = words_of(text)
            joined = b" ".join(words)
            g = gram_hashes(word_hashes(words), phrase) if len(words) >= window else np.zeros(0, np.uint64)
            n.append(len(words))
            digest.append(sha256(joined).digest())
            at = np.unique(governors(g, window - phrase + 1))
            found, first, times = np.unique(g[at].view(np.int64), return_index=True, return_counts=True)
            phrases.append(found)
            places.append(at[first].astype(np.int32))
            again.append(found[times > 1])
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(phrases, longs), pa.array(places, pa.list_(pa.int32())), pa.array(again, longs)],
            ["n_words", "digest", "phrases", "places", "again"],
        )

    return scanned


def _key():
    """What tells rows of one identifier apart: ten bits of the text's digest, since every window carries it."""
    return F.pmod(F.xxhash64("digest"), F.lit(1024))


def _packing(window: int):
    @F.arrow_udf("n_words int, digest binary, packed binary")
    def packed(texts):
        import pyarrow as pa
        import zstandard

        zip_, n, digest, out = zstandard.ZstdCompressor(level=1), [], [], []
        for text in texts:  # one text's words at a time
            words = words_of(text.as_py())
            joined = b" ".join(words)
            n.append(len(words))
            digest.append(sha256(joined).digest())
            out.append(zip_.compress(joined) if len(words) >= window else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(out, pa.binary())], ["n_words", "digest", "packed"])

    return packed


#: How many words one automaton may know: a word is two letters of at most _BASE kinds each.
WORDS = 1 << 20
_BASE = 1 << 10


class Automata:
    """Aho-Corasick automata over words.

    Each word of the patterns is two letters, so that no node has many children to
    search; all other words are two zeros, and only stretches without zeros that are
    as long as a phrase go through the automaton.
    """

    def __init__(self, patterns, phrase: int):
        import ahocorasick

        self.phrase, self._parts = phrase, []
        self._stretch = re.compile("[^\\0]{%d,}" % (2 * phrase)).finditer
        letters: dict[bytes, str] = {}
        part = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for pattern in patterns:
            if len(letters) + phrase > WORDS:
                self._parts.append((part, letters))
                part, letters = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), {}
            for w in pattern:
                if w not in letters:
                    i = len(letters)
                    letters[w] = chr(1 + i % _BASE) + chr(0x1000 + i // _BASE)
            part.add_word("".join(map(letters.__getitem__, pattern)))
        self._parts.append((part, letters))
        for part, _ in self._parts:
            part.make_automaton()

    def located(self, words: list[bytes]) -> np.ndarray:
        """Whether a pattern starts at each word."""
        at = np.zeros(len(words), bool)
        for part, letters in self._parts:
            if len(part):
                text = "".join(map(letters.get, words, repeat("\0\0")))
                for m in self._stretch(text):
                    ends = [end for end, _ in part.iter(text, m.start(), m.end())]
                    at[(np.array(ends, np.int64) + 1) // 2 - self.phrase] = True
        return at


def verified(p: np.ndarray, d1: np.ndarray, p1: np.ndarray, words: list[bytes], others: list[list[bytes]], window: int) -> np.ndarray:
    """Which windows at p are, word for word, the window at p1 of document d1.

    Windows in a row that stand against windows in a row are compared as one stretch.
    """
    ok = np.ones(len(p), bool)
    cuts = np.flatnonzero((np.diff(p) != 1) | (np.diff(p1) != 1) | (np.diff(d1) != 0)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(p)]):
        if a < b and words[p[a] : p[b - 1] + window] != others[d1[a]][p1[a] : p1[b - 1] + window]:
            for i in range(a, b):
                ok[i] = words[p[i] : p[i] + window] == others[d1[i]][p1[i] : p1[i] + window]
    return ok


_FOUND = "id long, key long, tie int, n_words int, n_removed int, digest binary, packed binary, marked binary, w array<long>, v array<long>, p array<int>"


def _located(window: int, phrase: int):
    """One shard: its documents, the places of its confirmed phrases (kind 0) and its copies (kind 1, with their digests)."""

    def locate(docs, marks):
        import pyarrow as pa
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        kinds, ids, keys = marks["kind"].to_numpy(), marks["id"].to_numpy(), marks["key"].to_numpy()
        # identifiers repeat and are null: only the text tells which of their rows is the copy
        copies = set(zip(ids[kinds == 1].tolist(), marks["digest"].filter(pa.array(kinds == 1)).to_pylist()))
        copied = {id_ for id_, _ in copies}
        places: dict[tuple[int, int], list[int]] = {}
        for id_, key, at in zip(ids[kinds == 0].tolist(), keys[kinds == 0].tolist(), marks["place"].filter(pa.array(kinds == 0)).to_pylist()):
            places.setdefault((id_, key), []).append(at)
        rows = sorted(zip(docs["id"].to_pylist(), docs["key"].to_pylist(), docs["packed"].to_pylist()), key=lambda r: r[:2])
        types = {
            "id": pa.int64(), "key": pa.int64(), "tie": pa.int32(), "n_words": pa.int32(), "n_removed": pa.int32(), "digest": pa.binary(), "packed": pa.binary(),
            "marked": pa.binary(), "w": pa.list_(pa.int64()), "v": pa.list_(pa.int64()), "p": pa.list_(pa.int32()),
        }
        out: dict[str, list] = {name: [] for name in types}

        def emit(*values):
            for column, v in zip(out.values(), values):
                column.append(v)

        def whole(id_, key, tie, words):
            emit(id_, key, tie, len(words), 0, sha256(b" ".join(words)).digest(), None, None, (), (), ())

        streamed, patterns, tie = [], {}, 0
        for i, (id_, key, packed) in enumerate(rows):
            tie = tie + 1 if i and rows[i - 1][:2] == (id_, key) else 0
            joined = unzip.decompress(packed)
            words = joined.split()
            for at in places.get((id_, key), ()):
                if at + phrase <= len(words):
                    patterns.setdefault(tuple(words[at : at + phrase]))
            if id_ in copied and len(words) >= window and (id_, sha256(joined).digest()) in copies:
                emit(id_, key, tie, len(words), len(words), sha256(b"").digest(), None, None, (), (), ())
            elif len(words) < window:
                whole(id_, key, tie, words)
            else:
                streamed.append((id_, key, tie, packed, words))

        automata, held = Automata(patterns, phrase), []
        all_w, all_v, all_d, all_p = [], [], [], []
        for id_, key, tie, packed, words in streamed:
            at = automata.located(words)
            p = ()
            if at.any():
                h = word_hashes(words)
                p = np.flatnonzero(at[governors(gram_hashes(h, phrase), window - phrase + 1)])
            if not len(p):
                whole(id_, key, tie, words)
                continue
            all_w.append(gram_hashes(h, window, seed=1)[p].view(np.int64))
            all_v.append(gram_hashes(h, window, seed=2)[p].view(np.int64))
            all_d.append(np.full(len(p), len(held)))
            all_p.append(p)
            held.append((id_, key, tie, packed, words))
        if held:
            w, v, d, p = map(np.concatenate, (all_w, all_v, all_d, all_p))
            _, first, of = np.unique(w, return_index=True, return_inverse=True)  # the first of equals in document order
            earlier = first[of]
            texts = [words for *_, words in held]
            cuts = np.searchsorted(d, np.arange(len(held) + 1))
            for k, (id_, key, tie, packed, words) in enumerate(held):
                at = np.arange(cuts[k], cuts[k + 1])
                again = at[earlier[at] != at]
                again = again[verified(p[again], d[earlier[again]], p[earlier[again]], words, texts, window)]
                new = np.setdiff1d(at, again, assume_unique=True)
                emit(id_, key, tie, len(words), None, None, packed, _runs(p[again]), w[new], v[new], p[new])
        return pa.table({name: pa.array(out[name], t) for name, t in types.items()})

    return locate


def _runs(p: np.ndarray) -> bytes:
    """Sorted positions as (first, end) runs of 32-bit numbers."""
    cuts = np.flatnonzero(np.diff(p) != 1) + 1
    first, last = p[np.concatenate([[0], cuts])] if len(p) else p, p[np.concatenate([cuts - 1, [len(p) - 1]])] if len(p) else p
    return np.stack([first, last + 1], 1).astype(np.int32).tobytes()


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words the windows at these starts cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def _cut(window: int):
    @F.arrow_udf("n_removed int, digest binary, gone array<struct<start:int,end:int>>")
    def cut(packed, marked, more):
        import pyarrow as pa
        import zstandard

        unzip, n, digests, spans = zstandard.ZstdDecompressor(), [], [], []
        for z, local, far in zip(packed.to_pylist(), marked.to_pylist(), more.to_pylist()):
            words = unzip.decompress(z).split()
            gone = covered(len(words), np.asarray(far or [], np.int64), window)
            for first, end in np.frombuffer(local, np.int32).reshape(-1, 2).tolist():
                gone[first : end - 1 + window] = True
            n.append(int(gone.sum()))
            digests.append(sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).digest())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
            spans.append([{"start": int(a), "end": int(b)} for a, b in edge])
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(spans, span)], ["n_removed", "digest", "gone"])

    return cut


def repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, phrase: int = 9, shard_words: int = 150_000,
) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, gone (word ranges removed)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), _first_pass(window, phrase)(text).alias("x"))
    rows = materialize(rows.select("id", "x.*").withColumn("key", _key()), "phrases")
    words = rows.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    shards = max(1, -(-words // shard_words))
    shard = F.pmod(F.xxhash64("id", "key"), F.lit(shards)).alias("shard")

    held = rows.select(shard, "id", "key", F.explode(F.arrays_zip("phrases", "places")).alias("x")).select("shard", "id", "key", F.col("x.phrases").alias("value"), F.col("x.places").alias("place"))
    # a document lists each phrase once, and once more if it holds it repeatedly
    twice = rows.select(F.explode(F.concat("phrases", "again")).alias("value"))
    counts = twice.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("value")
    one = F.min(F.struct("id", "key", "place")).alias("x")
    recurring = held.join(counts, "value").groupBy("shard", "value").agg(one).select("shard", F.lit(0).alias("kind"), "x.id", "x.key", "x.place", F.lit(None).cast("binary").alias("digest"))
    firsts = rows.filter(F.col("n_words") >= window).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = rows.select("id", "key", "digest").join(firsts, "digest").filter("id <> first").select(shard, F.lit(1).alias("kind"), "id", "key", F.lit(None).cast("int").alias("place"), "digest")
    marks = recurring.unionByName(copies)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), _packing(window)(text).alias("x")).select("id", "x.*")
    docs = docs.filter(F.col("n_words") >= window).withColumn("key", _key()).select(shard, "id", "key", "packed")
    short = rows.filter(F.col("n_words") < window).select("id", "n_words", F.lit(0).alias("n_removed"), "digest")
    found = docs.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(_located(window, phrase), _FOUND)
    found = materialize(found, "located")

    windows = found.filter("packed IS NOT NULL").select("id", "key", "tie", F.explode(F.arrays_zip("w", "v", "p")).alias("x")).select("id", "key", "tie", "x.w", "x.v", "x.p")
    # within a shard only the first document with a window is listed, so the smallest identifier and key is the first start
    seen = windows.groupBy("w", "v").agg(F.min(F.struct("id", "key")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("w", "v", "first")
    later = windows.join(seen, ["w", "v"]).filter("id <> first.id OR key <> first.key").groupBy("id", "key", "tie").agg(F.collect_list("p").alias("more"))
    open_ = found.filter("packed IS NOT NULL").select("id", "key", "tie", "n_words", "packed", "marked").join(later, ["id", "key", "tie"], "left")
    open_ = open_.select("id", "n_words", _cut(window)("packed", "marked", "more").alias("x")).select("id", "n_words", "x.*")
    closed = found.filter("packed IS NULL").select("id", "n_words", "n_removed", "digest").unionByName(short)
    whole = F.when(F.col("n_removed") > 0, F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"))))
    closed = closed.withColumn("gone", F.coalesce(whole, F.array().cast("array<struct<start:int,end:int>>")))
    out = open_.unionByName(closed)
    return out.select(
        F.when(F.col("id") != _LAST, F.col("id")).alias(id_col), F.col("n_words").cast("long").alias("n_words"),
        F.col("n_removed").cast("long").alias("n_removed"), F.lower(F.hex("digest")).alias("kept_sha256"), "gone",
    )
