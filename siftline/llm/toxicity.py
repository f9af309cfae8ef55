"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; everything else is unlabelled text that
may hide more of them.  Features are words and word prefixes, each in steps: it
occurs, occurs twice, three times, or often for the text's length.  Features
that are more frequent in the positives than in the texts labelled clean, or than
in the unlabelled ones, are kept, and a linear classifier is trained in numpy on
the non-negative PU risk

    prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)])

with the logistic loss l: when a batch's estimate of the negatives' risk falls
below zero, the step goes against that part instead of fitting it.

Labels need not be a fair sample.  The prior is that of the unlabelled sample: the
mixture of the positives' and the clean texts' feature shares that comes nearest
to its own.  The bias is set on the labelled texts of both classes, each weighed
by a fit without it, where the error is least under that prior.  Without clean labels the prior is what the
positives' features leave room for, and the bias is the risk's.

Training reads at most ``positives`` confirmed, ``negatives`` clean and
``unlabelled`` other texts, each text once however many copies it has, chosen by
the smallest hashes of the texts; scoring reads every whole text, however long,
and repeated rows each for itself.  Defined results: null and empty texts score by
the bias alone, under one half; without a confirmed positive, so also with empty
tables, everything scores 0; an identifier that is labelled several times is toxic
if any label says so, labels that are null or of unknown identifiers say nothing;
of texts with equal hashes one is learnt from; an input column with the output's
name is replaced.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.storage import settle

from .common import unclash

STEPS = 4
DENSE = 1 / 150
FOLDS = 3
_LIMIT = 300_000


def _find():
    import regex

    return regex.compile(r"\p{L}+").findall


def word_features(word: str) -> tuple[int, ...]:
    """31-bit hashes of a lower-case word and of its prefixes of 3 to 8 letters."""
    import xxhash

    out = [xxhash.xxh3_64_intdigest("=" + word) >> 33]
    for n in range(3, min(9, len(word))):
        out.append(xxhash.xxh3_64_intdigest(word[:n]) >> 33)
    return tuple(out)


class _Features(dict):
    """word -> its features, or of them those that `known` numbers; bounded."""

    def __init__(self, known: dict[int, int] | None = None):
        super().__init__()
        self.known = known

    def __missing__(self, word: str):
        if len(self) >= _LIMIT:
            self.clear()
        f = word_features(word)
        if self.known is not None:
            f = tuple(self.known[x] for x in f if x in self.known)
        self[word] = f
        return f


def counted(text: str | None, cache: dict, find) -> tuple[Counter, int]:
    """How often each feature occurs in a whole text, and its number of words."""
    words, tally = find(text.lower()) if text else [], Counter()
    for word, n in Counter(words).items():
        for f in cache[word]:
            tally[f] += n
    return tally, len(words)


def steps_of(n: int, words: int) -> int:
    """A bit for each step that n occurrences among so many words reach."""
    return 1 | (n >= 2) << 1 | (n >= 3) << 2 | (n >= 2 and n >= words * DENSE) << 3


_all = _Features()


def features(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Columns keep, ids (features of each text, packed 32-bit) and steps (bits, in step with ids)."""

    @F.arrow_udf("ids binary, steps binary")
    def hashed(texts):
        import pyarrow as pa

        find, ids, steps = _find(), [], []
        for text in texts.to_pylist():
            tally, words = counted(text, _all, find)
            ids.append(np.fromiter(tally, np.int32, len(tally)).tobytes())
            steps.append(bytes(steps_of(n, words) for n in tally.values()))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(steps, pa.binary())], ["ids", "steps"])

    return df.select(*keep, hashed(F.coalesce(F.col(text_col), F.lit(""))).alias("x")).select(*keep, "x.*")


class Model:
    """Numbered features, weights by feature and step, and the bias."""

    def __init__(self, known: dict[int, int], weights: np.ndarray, bias: float):
        self.known, self.bias = known, bias
        # the sum of weights for each combination of steps
        bits = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
        self.table = (weights @ bits.T).tolist()


def _chosen(p: list, u: list, least: int, z: float) -> np.ndarray:
    """Features whose share of texts, at any step, differs between the samples."""
    keep = []
    for bit in range(STEPS):
        sides = []
        for part in (p, u):
            hit = [ids[(steps >> bit) & 1 == 1] for ids, steps in part]
            sides.append(np.unique(np.concatenate(hit), return_counts=True))
        every = np.union1d(sides[0][0], sides[1][0])
        n = []
        for values, counts in sides:
            at = np.zeros(len(every))
            at[np.searchsorted(every, values)] = counts
            n.append(at)
        share = (n[0] + n[1]) / (len(p) + len(u))
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / len(p) + 1 / len(u)))
        keep.append(every[(n[0] + n[1] >= least) & (n[0] / len(p) - n[1] / len(u) >= z * spread)])
    return np.unique(np.concatenate(keep))


def _shares(part: list, chosen: np.ndarray) -> np.ndarray:
    """The share of texts with each chosen feature at each step."""
    out = np.zeros((STEPS, len(chosen)))
    for ids, steps in part:
        at = np.searchsorted(chosen, ids)
        ok = at < len(chosen)
        ok[ok] = chosen[at[ok]] == ids[ok]
        for b in range(STEPS):
            out[b, at[ok & ((steps >> b) & 1 == 1)]] += 1
    return out.ravel() / len(part)


def prior_of(p: list, n: list, u: list, chosen: np.ndarray) -> float:
    """The share of u that is like p, the rest being like n; without n, the most that p's features allow."""
    sp, su = _shares(p, chosen), _shares(u, chosen)
    if n:
        sn = _shares(n, chosen)
        gap = sp - sn
        weight = 1 / np.maximum(sp * (1 - sp) + sn * (1 - sn), 1e-3)
        found = (weight * (su - sn) * gap).sum() / max(1e-9, (weight * gap * gap).sum())
    else:
        found = su.sum() / max(1e-9, sp.sum())
    return float(min(0.9, max(1e-3, found)))


def cut_of(p: np.ndarray, n: np.ndarray, prior: float) -> float:
    """The sum of weights, over 0, at which prior * misses + (1 - prior) * false alarms is least."""
    at = np.unique(np.concatenate([[0.0], p[p > 0], n[n > 0]]))
    ends = np.append(at, at[-1] + 1.0)
    p, n = np.sort(p), np.sort(n)
    # cutting between ends[i] and ends[i + 1]
    miss = np.searchsorted(p, ends[:-1], "right") / len(p)
    alarm = 1 - np.searchsorted(n, ends[:-1], "right") / len(n)
    error = prior * miss + (1 - prior) * alarm
    best = np.flatnonzero(error <= error.min() + 1e-12)
    i = best[np.diff(ends)[best].argmax()]  # of equals, the widest gap
    return float((ends[i] + ends[i + 1]) / 2)


def _solve(p: list, u: list, size: int, prior: float, epochs: int, batch: int, rate: float, l2: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of least nnPU risk; p and u hold each text's numbers of weights."""
    w, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v, mb, vb, t = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    rng = np.random.default_rng(seed)

    def margins(part):
        owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
        flat = np.concatenate(part)
        return flat, owner, np.bincount(owner, w[flat], len(part)) + bias

    def sigma(x):
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    mean, mean_bias, summed = np.zeros(size), 0.0, 0
    for epoch in range(epochs):
        step = rate * (1 - 0.9 * epoch / epochs)
        for part in np.array_split(rng.permutation(len(u)), max(1, len(u) // batch)):
            pf, po, pz = margins([p[i] for i in rng.integers(0, len(p), batch)])
            uf, uo, uz = margins([u[i] for i in part])
            negative = np.logaddexp(0, uz).mean() - prior * np.logaddexp(0, pz).mean()
            g_u, g_p = sigma(uz) / len(part), -prior * sigma(pz) / batch
            if negative >= 0:
                gp, gu = -prior * sigma(-pz) / batch + g_p, g_u
            else:
                gp, gu = -g_p, -g_u
            grad = np.bincount(np.concatenate([pf, uf]), np.concatenate([gp[po], gu[uo]]), size) + l2 * w
            gb = gp.sum() + gu.sum()
            t += 1
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            mb += 0.1 * (gb - mb)
            vb += 0.001 * (gb * gb - vb)
            fix1, fix2 = 1 - 0.9**t, 1 - 0.999**t
            w -= step * (m / fix1) / (np.sqrt(v / fix2) + 1e-6)
            bias -= step * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-6)
            if epoch >= epochs // 2:  # steps against the fit make the last one noisy
                mean, mean_bias, summed = mean + w, mean_bias + bias, summed + 1
    return mean / summed, mean_bias / summed


def train_nnpu(
    p: list, u: list, n: list = (), prior: float | None = None, epochs: int = 150, batch: int = 256, rate: float = 0.03, l2: float = 1e-4, least: int = 3, z: float = 5.0, seed: int = 3,
) -> Model:
    """p, u and n hold (ids, steps) of the positive, the unlabelled and the clean texts."""
    if not p or not u:
        return Model({}, np.zeros((0, STEPS)), -50.0)
    # a group that fills u must not hide its words: the clean labels show them too
    chosen = _chosen(p, u, least, z)
    if n:
        known = _chosen(p, n, least, z)
        chosen = np.union1d(chosen, known)
    if not len(chosen):
        return Model({}, np.zeros((0, STEPS)), -1.0)
    if prior is None:
        prior = prior_of(p, n, u, known if n and len(known) else chosen)
    size = len(chosen) * STEPS

    def numbered(part):
        rows = []
        for ids, steps in part:
            at = np.searchsorted(chosen, ids)
            ok = at < len(chosen)
            ok[ok] = chosen[at[ok]] == ids[ok]
            at, bits = at[ok], steps[ok]
            rows.append(np.concatenate([at[(bits >> b) & 1 == 1] * STEPS + b for b in range(STEPS)]))
        return rows

    # a clean text may also be in the unlabelled sample; it stays one object
    number = {id(x): row for part in (p, u, n) for x, row in zip(part, numbered(part))}
    options = (size, prior, epochs, batch, rate, l2, seed)
    w, bias = _solve([number[id(x)] for x in p], [number[id(x)] for x in u], *options)
    if n and len(p) >= FOLDS and len(n) >= FOLDS:
        # the cut is set on texts that the weights were not fitted to
        sums: tuple[list, list] = ([], [])
        for k in range(FOLDS):
            held = p[k::FOLDS], n[k::FOLDS]
            out = {id(x) for part in held for x in part}
            own, _ = _solve([number[id(x)] for x in p if id(x) not in out], [number[id(x)] for x in u if id(x) not in out or len(u) <= len(out)], *options)
            for side, part in zip(sums, held):
                side += [own[number[id(x)]].sum() for x in part]
        bias = -cut_of(np.array(sums[0]), np.array(sums[1]), prior)
    bias = min(bias, -1e-3)  # no evidence is under one half
    return Model({int(x): i for i, x in enumerate(chosen)}, w.reshape(-1, STEPS), bias)


def fit(
    docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    positives: int = 2000, unlabelled: int = 4000, negatives: int = 2000,
) -> Model:
    """Train from rows for which `allowed` (a condition on id_col) holds.

    At most `positives` confirmed, `negatives` clean and `unlabelled` other texts
    are read: the documented bound of the training sample.
    """
    known = labels.select(F.col(id_col), F.col(label_col).alias("__y")).filter(allowed & F.col("__y").isNotNull()).groupBy(id_col).agg(F.max("__y").alias("__y"))
    hashed = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.filter(allowed).select(id_col, hashed.alias("__h")).join(known, id_col, "left")
    # copies of a text are one text, toxic if any is labelled so
    texts = texts.groupBy("__h").agg(F.max("__y").alias("__y"), F.min(id_col).alias("__id"))
    sides = (("__p", texts.filter("__y = 1"), positives), ("__n", texts.filter("__y = 0"), negatives), ("__u", texts, unlabelled))
    # all sides are bounded by the parameters above
    parts = [side.orderBy("__h").limit(most).select("__h", "__id", F.lit(name).alias("side")) for name, side, most in sides]
    chosen = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("__h").agg(F.first("__id").alias("__id"), F.collect_set("side").alias("sides"))
    same = (hashed == F.col("__h")) & F.col(id_col).eqNullSafe(F.col("__id"))
    picked = docs.select(id_col, text_col).join(F.broadcast(chosen), same).dropDuplicates(["__h"])
    rows = features(picked, text_col, ["__h", "sides"]).toArrow().sort_by("__h")
    pairs = [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(s.as_buffer(), np.uint8)) for i, s in zip(rows["ids"], rows["steps"])]
    sided = rows["sides"].to_pylist()
    p, n, u = ([x for x, of in zip(pairs, sided) if name in of] for name, _, _ in sides)
    model = train_nnpu(p, u, n)
    del rows, pairs, p, n, u, sided
    settle(docs.sparkSession)  # the sample is the most that any operator holds on the driver
    return model


_scoring: dict[str, _Features] = {}


def score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """Append the probability that each whole text is toxic."""
    used, key = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.arrow_udf("double")
    def scored(texts):
        import pyarrow as pa

        model, find, found = used.value, _find(), []
        if key not in _scoring:
            _scoring.clear()
            _scoring[key] = _Features(model.known)
        cache, table, get = _scoring[key], model.table, _scoring[key].__getitem__
        for text in texts.to_pylist():
            words, tally, z = find(text.lower()), Counter(), model.bias
            for hit in filter(None, map(get, words)):
                tally.update(hit)
            for f, n in tally.items():
                z += table[f][steps_of(n, len(words))]
            found.append(float(1 / (1 + np.exp(-min(60.0, max(-60.0, z))))))
        return pa.array(found, pa.float64())

    df = df.withColumn("__s", scored(F.coalesce(F.col(text_col), F.lit(""))))
    return unclash(df, out).withColumnRenamed("__s", out)
