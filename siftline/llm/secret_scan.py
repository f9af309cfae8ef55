"""Secret scans by character Markov models.

Three fixed patterns give the base findings: assigned values, access keys and hex
strings.  They find only what has a known form or stands behind a known word.  The
method adds the rest: every run of 16 or more key characters is scored by the
log-likelihood ratio of two second-order character Markov models, one of random
strings and one of ordinary identifiers, and a run is a finding where a stretch of
it gathers at least ``least`` nats beyond one a character.

The models are trained from labelled samples.  Random: the values of all base
findings of the corpus, and generated keys over the usual alphabets, so that kinds
of keys that the corpus has not got are known too.  Ordinary: the corpus's text but
for base findings and the runs that are to be judged (a key that is copied often
would else teach that it is none), its words as they are and joined to identifiers,
and generated identifiers of common parts.  Tasks count
character triples over whole texts; the driver takes one row per triple, at most
2 * 69**3 whatever the corpus.

Defined results: a null text is empty; empty texts have no findings; texts and runs of
any length are scanned whole; repeated rows are scanned each for itself; a table
without rows can be learnt from (the generated keys and identifiers then stand
alone) and gives no rows; input columns with an output's name are replaced.
Findings come in order of their start, those of equal start in the order of KINDS; a
run that lies within a base finding is not reported again.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, by kind.  Letters of the first match in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RANDOM = "random"
KINDS = ("assign", "access", "hex", RANDOM)

#: A run of key characters; what the models read.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
C = len(ALPHABET) + 1
_CLASS = np.zeros(256, np.int32)
_CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, C)
_JOIN = int(_CLASS[ord("_")])

#: Alphabets of the generated keys.
KEY_ALPHABETS = ("0123456789abcdef", ALPHABET[26:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")

#: Parts of the generated identifiers.
PARTS = (
    "access account action address agent amount answer array async author base batch block body browser buffer build bytes cache call category channel "
    "check class client code column command comment config connection content context control cookie count create current customer data database date "
    "default delete detail device document domain download email encoding engine entry error event example export failed field file filter first format "
    "function global group handler hash header height history host image import index info input instance integration internal item iterator keyword label "
    "language last length level library limit line link list load local location logger login manager mapping match max member memory message metadata method "
    "min mode model module name network node number object offset operation option order output package page parameter parent parse password path pattern "
    "payment people pointer position prefix previous process product profile project property provider public query queue range reader record reference region "
    "release remote report request resource response result return role root route schema search section select sequence server service session setting size "
    "source start state static status storage stream string system table target task template test text thread time title token total type update upload user "
    "util validation value variable version view visible window with worker write"
).split()

Span = tuple[int, int, int, float]  # start, kind, end, score


def base_spans(text: str) -> list[Span]:
    """Base findings by start, then kind."""
    found = [(m.start(), 0, m.end(), 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # runs are maximal either way, so asking for 24 characters finds the runs that have them
    found += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text)]
    return sorted(found)


def triples(raw: bytes, step: int = 1 << 20):
    """Codes of the character triples of a text whose third character is a key character.

    What precedes the start of a run is class 0; the second yield of each stretch
    holds the triples that arise when neighbouring words are joined.
    """
    for at in range(0, len(raw), step):
        x = _CLASS[np.frombuffer(raw[max(0, at - 2) : at + step], np.uint8)]
        x = np.concatenate([np.zeros(2 - min(at, 2), np.int32), x])
        a, b, c = np.where(x[1:-1] == 0, 0, x[:-2]), x[1:-1], x[2:]
        code = (a * C + b) * C + c
        yield code[c > 0], False
        gap = x == 0
        gap[1:-1] &= ~(gap[:-2] | gap[2:])  # a single character between two words
        gap[[0, -1]] = False
        if gap.any():
            y = np.where(gap, _JOIN, x)
            near = gap[:-2] | gap[1:-1] | gap[2:]
            a, b, c = np.where(y[1:-1] == 0, 0, y[:-2]), y[1:-1], y[2:]
            yield ((a * C + b) * C + c)[near & (c > 0)], True


def _add(counts: np.ndarray, code: np.ndarray) -> None:
    if len(code) > 1 << 16:
        counts += np.bincount(code, minlength=len(counts))
    else:
        np.add.at(counts, code, 1)


def _counted(batches):
    """Texts to counts of triples by label: 1 random, 0 ordinary."""
    import pyarrow as pa

    counts = np.zeros((2, C**3), np.int64)

    def add(label: int, text: str):
        for code, _ in triples(text.encode()):
            _add(counts[label], code)

    for batch in batches:
        ordinary, random, size = [], [], 0
        for text in batch.column("text").to_pylist():
            if not text:
                continue
            at, base = 0, base_spans(text)
            for start, _, end, _ in base:
                value = ASSIGN.match(text, start)
                random.append(value[2] if value else text[start:end])
            for start, end in sorted([(s, e) for s, _, e, _ in base] + [m.span() for m in RUN.finditer(text)]):
                if end > at:
                    ordinary.append(text[at:start])
                    at = end
            ordinary.append(text[at:])
            size += len(text)
            if size > 1 << 22:
                add(0, "\n\n".join(ordinary))
                ordinary, size = [], 0
        add(0, "\n\n".join(ordinary))
        add(1, "\n\n".join(random))
    label, code = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(code, pa.int32()), pa.array(counts[label, code], pa.int64())], ["label", "code", "n"])


def generated_keys(per_alphabet: int = 2000, length: int = 40, seed: int = 11) -> list[str]:
    """Random strings over the usual alphabets, the same on every run."""
    rng = np.random.default_rng(seed)
    return ["".join(np.array(list(a))[rng.integers(0, len(a), length)]) for a in KEY_ALPHABETS for _ in range(per_alphabet)]


def generated_identifiers(per_style: int = 3000, seed: int = 12) -> list[str]:
    """Ordinary identifiers of two to five parts, in the usual ways of writing them, and numbers."""
    rng = np.random.default_rng(seed)
    parts = [[PARTS[i] for i in rng.integers(0, len(PARTS), rng.integers(2, 6))] for _ in range(per_style)]
    camel = [p[0] + "".join(w.title() for w in p[1:]) for p in parts]
    number = [f"{c}{n}" for c, n in zip(camel, rng.integers(0, 100, len(camel)).tolist())]
    joined = [sign.join(p) for p in parts for sign in ("_", "-", "/", "")]
    # digits alone are numbers of something: times, telephones, cards
    joined += ["".join(map(str, d)) for d in rng.integers(0, 10, (2 * per_style, 18)).tolist()]
    return camel + number + ["".join(w.title() for w in p) for p in parts] + ["_".join(p).upper() for p in parts] + joined


def _log_probabilities(n: np.ndarray, weight: float = 8.0) -> np.ndarray:
    """log P(c | a, b), backing off to P(c | b), to P(c), to a uniform choice."""
    n3 = n.reshape(C, C, C).astype(np.float64)
    n3[:, :, 0] = 0
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + C)
    p2 = (n2 + weight * p1) / (n2.sum(1, keepdims=True) + weight)
    p3 = (n3 + weight * p2[None]) / (n3.sum(2, keepdims=True) + weight)
    return np.log(p3)


class Model:
    """The ratio's table: nats by which a triple speaks for a random string."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, doubt: float = 1.0):
        # the doubt is taken off every character, so that length alone gathers nothing
        self.ratio = (_log_probabilities(random) - _log_probabilities(ordinary) - doubt).astype(np.float32).ravel()

    def score(self, run: str) -> float:
        """The largest sum over a stretch of the run."""
        code = np.concatenate([part for part, joined in triples(run.encode()) if not joined])
        s = np.concatenate([[0.0], np.cumsum(self.ratio[code], dtype=np.float64)])
        return float((s - np.minimum.accumulate(s)).max())

    def spans(self, text: str, least: float) -> list[Span]:
        """Base findings and what the models add, by start, then kind."""
        base = base_spans(text)
        found = list(base)
        for m in RUN.finditer(text):
            start, end = m.span()
            if any(b[0] <= start and end <= b[2] for b in base):
                continue
            score = self.score(m[0])
            if score >= least:
                found.append((start, 3, end, score))
        return sorted(found)


def train(counts: np.ndarray, per_alphabet: int = 2000) -> Model:
    """Both models from the corpus's counts by label and the generated samples."""
    for label, strings in ((1, generated_keys(per_alphabet)), (0, generated_identifiers())):
        for code, _ in triples("\n\n".join(strings).encode()):
            _add(counts[label], code)
    # other signs join words as the low line does
    joined = counts[0].reshape(C, C, C)
    for sign in "-/.":
        s = int(_CLASS[ord(sign)])
        joined[s] += joined[_JOIN]
        joined[:, s] += joined[:, _JOIN]
        joined[:, :, s] += joined[:, :, _JOIN]
    return Model(counts[1], counts[0])


def fit(df: DataFrame, text_col: str = "text", per_alphabet: int = 2000) -> Model:
    """Count triples over all texts and fit both models."""
    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted, "label int, code int, n long")
    table = counted.groupBy("label", "code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, C**3), np.int64)
    counts[table["label"].to_numpy(), table["code"].to_numpy()] = table["n"].to_numpy()
    return train(counts, per_alphabet)


def scan(df: DataFrame, model: Model, text_col: str = "text", least: float = 20.0) -> DataFrame:
    """Append findings: an array of kind, start, end (code points, end exclusive) and score."""

    @F.arrow_udf("array<struct<kind:string,start:long,end:long,score:double>>")
    def findings(texts):
        import pyarrow as pa

        lists = []
        for text in texts.to_pylist():
            spans = model.spans(text, least) if text else []
            lists.append([{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in spans])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        return pa.array(lists, pa.list_(kind))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.withColumn("findings", findings(text))


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The scanned rows with every finding in the text replaced by a mark; null stays null."""

    @F.arrow_udf("string")
    def redacted(texts, findings):
        import pyarrow as pa

        out = []
        for text, spans in zip(texts.to_pylist(), findings.to_pylist()):
            if text is None:
                out.append(None)
                continue
            parts, at = [], 0
            for f in spans:
                if f["start"] >= at:
                    parts += [text[at : f["start"]], mark]
                at = max(at, f["end"])  # one that overlaps the last is under its mark
            out.append("".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return df.withColumn(text_col, redacted(F.col(text_col), "findings"))


def count_of(findings, kind: str):
    """How many findings are of a kind."""
    return F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")


def spans_text(findings, base_only: bool = False):
    """kind:start:end of the findings, joined by commas."""
    kept = F.filter(findings, lambda f: f["kind"] != RANDOM) if base_only else findings
    return F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
