"""Language identification of mixed text: script ranges, then Viterbi over words.

Every word has a vector of scores, one per learned language, from hashed
character n-grams and the word itself (naive Bayes with add-half smoothing,
centred over the languages and clipped, so no single word decides).  The word's
script, by code point ranges, leaves only the languages seen to use it.  Viterbi
with a penalty for switching then labels spans; a document's language is the one
whose spans hold the most letters.

The best constant labelling is optimal whenever no run of words gains more than
half the penalty under another language; that test is vectorised, and the full
recursion runs only for texts that fail it.

A word is a run of letters of one script: runs are cut where the script changes,
into pieces of at most 8 letters in scripts without spaces between words and of
40 in others.  Every piece is scored.

Defined results: null texts and texts without a letter are ``und`` with score 0
and no spans; ties go to the language first in order.  Texts of any length are
labelled whole, repeated rows each for itself; an empty table gives no rows, and
without a labelled row everything is ``und``.  Input columns with an output's name
are replaced.  Fitting reads about ``per_lang`` documents of each language (a
documented bound), chosen by hash, whole; the languages themselves are few enough
for a table of one column each.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, unclash

BITS = 17
CLIP = 6.0
PENALTY = 14.0
LONGEST, UNSPACED = 40, 8
#: A word counts for at most this share of its language's words when learning.
FREQUENT = 1 / 500
_LIMIT = 800_000

#: Starts of script ranges (Unicode blocks), and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "Other"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "Latin"), (0x2C00, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Kana"), (0x3400, "Han"),
    (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"),
    (0x10000, "Other"), (0x20000, "Han"), (0x40000, "Other"),
]
_STARTS = [s for s, _ in SCRIPTS]
_UNSPACED = {"Han", "Kana", "Thai"}
_MARKS = r"\u0300-\u036F\u1AB0-\u1AFF\u1DC0-\u1DFF\u20D0-\u20FF\u3099\u309A\uFE00-\uFE0F\uFE20-\uFE2F"


def script_of(word: str) -> str:
    from bisect import bisect_right

    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def _find():
    """A function from a text to its words."""
    import regex

    runs = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
    ranges: dict[str, str] = {}
    for (start, script), end in zip(SCRIPTS, [*_STARTS[1:], 0x110000]):
        ranges[script] = ranges.get(script, "") + f"\\U{start:08X}-\\U{end - 1:08X}"
    mixed = re.compile(f"[^{ranges['Latin']}]").search
    # marks that any script uses stay with the letter before them
    pieces = re.compile("|".join(f"[{r}](?:[{r}{_MARKS}]{{0,{(UNSPACED if s in _UNSPACED else LONGEST) - 1}}})[{_MARKS}]*" for s, r in ranges.items())).findall

    def find(text: str) -> list[str]:
        found = runs(text)
        if found and (max(map(len, found)) > LONGEST or mixed(text)):
            found = [x for w in found for x in pieces(w)]
        return found

    return find


def word_features(word: str) -> list[int]:
    """Hashed trigrams of the word between boundary marks, and the word."""
    from xxhash import xxh3_64_intdigest as hashed

    mask, w = (1 << BITS) - 1, f"<{word}>"
    grams = [w[i : i + 3] for i in range(len(w) - 2)]
    grams.append("=" + word)
    return [hashed(g) & mask for g in grams]


class Model:
    """Languages, log-odds by feature, and the languages of each script."""

    def __init__(self, langs: list[str], table: np.ndarray, scripts: dict[str, list[bool]]):
        self.langs, self.table, self.scripts = langs, table, scripts


class Scorer(dict):
    """word -> row of the score matrix; bounded, rebuilt when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.find = _find()
        self.rows = np.zeros((1024, len(model.langs)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def learn(self, words: list[str]) -> None:
        """Give each new word its row, all in one go."""
        feats = [word_features(w) for w in words]
        starts = np.cumsum([0, *map(len, feats[:-1])])
        s = np.add.reduceat(self.model.table[[f for x in feats for f in x]], starts, axis=0)
        s = np.clip(s - s.mean(1, keepdims=True), -CLIP, CLIP)
        for i, w in enumerate(words):
            if (mask := self.model.scripts.get(script_of(w))) is not None and not all(mask):
                s[i, ~np.asarray(mask)] = -CLIP
        n = len(self)
        while n + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.rows[n : n + len(words)] = s
        self.letters[n : n + len(words)] = [len(w) for w in words]
        self.update(zip(words, range(n, n + len(words))))

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The score matrix and letter counts of a text's words, in order."""
        if len(self) >= _LIMIT:
            self.clear()
        found = self.find(text.lower())
        if new := [w for w in dict.fromkeys(found) if w not in self]:
            self.learn(new)
        ids = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return self.rows[ids].astype(np.float64), self.letters[ids]


_scorers: dict[str, Scorer] = {}


def scorer_of(key: str, model: Model) -> Scorer:
    """This worker's scorer of a model; only the last one is kept."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(model)
    return _scorers[key]


def viterbi(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The labelling with the largest sum of scores less penalty per switch."""
    n, k = s.shape
    best = int(s.sum(0).argmax())
    gain = np.cumsum(s - s[:, [best]], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, k)), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty / 2:
        return np.full(n, best, np.int32)
    rows = s.tolist()  # plain floats: a handful of languages is too few for arrays
    total, back = rows[0], []
    for row in rows[1:]:
        most = max(total)
        top, switch = total.index(most), most - penalty
        back.append([c if t >= switch else top for c, t in enumerate(total)])
        total = [(t if t >= switch else switch) + x for t, x in zip(total, row)]
    label = total.index(max(total))
    out = [label]
    for came in reversed(back):
        label = came[label]
        out.append(label)
    return np.array(out[::-1], np.int32)


def spans_of(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, end, label) of each run."""
    cuts = np.flatnonzero(np.diff(labels)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(labels)]])
    return [(int(a), int(b), int(labels[a])) for a, b in zip(starts, ends)]


def identify(text: str | None, scorer: Scorer) -> tuple[str, float, list]:
    """(language, score, spans) of a text."""
    if not text or not scorer.model.langs:
        return "und", 0.0, []
    s, letters = scorer.words(text)
    if not len(s):
        return "und", 0.0, []
    labels = viterbi(s)
    share = np.bincount(labels, letters, len(scorer.model.langs))
    lang = int(share.argmax())
    total = s.sum(0)
    odds = np.exp(np.clip(total - total[lang], -50, 50))
    score = float(share[lang] / share.sum() * min(1.0, 1 / odds.sum() * 1.0 if odds.sum() > 1 else 1.0))
    return scorer.model.langs[lang], score, spans_of(labels)


def fit(docs: DataFrame, allowed: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = 2500) -> Model:
    """Learn from rows for which `allowed` holds and lang_col is not null."""
    known = docs.filter(allowed & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), {})
    where = {x: i for i, x in enumerate(langs)}
    u = F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    shares = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, per_lang / counts[x]))])
    chosen = u <= F.element_at(shares, F.col(lang_col))

    def tally(batches):
        from collections import Counter, defaultdict

        import pyarrow as pa

        find, words = _find(), defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    words[lang].update(find(text.lower()))
        for lang, found in words.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([where[lang]] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "word", "n"]
            )

    words = known.filter(chosen).select(lang_col, text_col).mapInArrow(tally, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    # frequent words count, but not for everything; all tasks' counts are in, so it does not matter how they were split
    most = {r[0]: -int(-r[1] * FREQUENT // 1) for r in words.groupBy("lang").agg(F.sum("n")).collect()}

    def spread(batches):
        from collections import defaultdict

        import pyarrow as pa

        tables, scripts = defaultdict(lambda: np.zeros(1 << BITS, np.int64)), defaultdict(int)
        for batch in batches:
            for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n = min(n, most[lang])
                for f in word_features(word):
                    tables[lang][f] += n
                scripts[lang, script_of(word)] += n
        for lang, table in tables.items():
            hit = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(hit), pa.int32()), pa.array(hit.astype(str)), pa.array(table[hit], pa.int64())], ["lang", "what", "n"]
            )
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in scripts], pa.int32()), pa.array(["s" + x for _, x in scripts], pa.string()), pa.array(list(scripts.values()), pa.int64())], ["lang", "what", "n"]
        )

    rows = words.mapInArrow(spread, "lang int, what string, n long").groupBy("lang", "what").agg(F.sum("n").alias("n")).toPandas()
    discard(words)
    is_script = rows["what"].str.startswith("s")
    table = np.zeros((1 << BITS, len(langs)))
    grams = rows[~is_script]
    table[grams["what"].astype(int).to_numpy(), grams["lang"].to_numpy()] = grams["n"].to_numpy()
    seen = table.sum(1) >= 3
    odds = np.log(table + 0.5) - np.log(table.sum(0) + 0.5 * len(table))
    odds -= odds.mean(1, keepdims=True)
    odds[~seen] = 0
    scripts: dict[str, list[bool]] = {}
    of = rows[is_script]
    totals = of.groupby("lang")["n"].sum()
    for lang, what, n in of[["lang", "what", "n"]].itertuples(index=False):
        if n >= 0.005 * totals[lang]:
            scripts.setdefault(what[1:], [False] * len(langs))[lang] = True
    return Model(langs, odds.astype(np.float32), scripts)


def label(df: DataFrame, model: Model, text_col: str = "text", with_spans: bool = True) -> DataFrame:
    """Append lang_pred, score and, if asked for, spans (word ranges with languages)."""
    used, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    kind = "lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if with_spans else "")

    @F.arrow_udf(kind)
    def labelled(texts):
        import pyarrow as pa

        scorer = scorer_of(key, used.value)
        found = [identify(t, scorer) for t in texts.to_pylist()]
        columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
        names = ["lang_pred", "score"]
        if with_spans:
            langs = scorer.model.langs
            columns.append(pa.array(
                [[{"start": a, "end": b, "lang": langs[c]} for a, b, c in f[2]] for f in found],
                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])),
            ))
            names.append("spans")
        return pa.StructArray.from_arrays(columns, names)

    df = df.withColumn("__x", labelled(F.coalesce(F.col(text_col), F.lit(""))))
    return unclash(df, "lang_pred", "score", *(["spans"] if with_spans else [])).select("*", "__x.*").drop("__x")
