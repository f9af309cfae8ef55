"""Helpers shared by the corpus operators: shared storage, words and hashes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.storage import discard, materialize, release, shared_root  # noqa: F401

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def unclash(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns whose names an operator is about to produce."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def exclusive_sums(df: DataFrame, key: str, at: str, value: str, out: str, count: int, fan: int = 4096) -> DataFrame:
    """Append the sum of value over the key's rows with smaller `at`, for rows unique by (key, at < count).

    Sums run within stretches of `fan` places and then, level by level, over the
    stretches' sums: no task holds more than `fan` rows of a key.
    """
    low = df.withColumn("__b", F.floor(F.col(at) / F.lit(fan)))
    w = Window.partitionBy(key, "__b").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    low = low.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    if count > fan:
        tops = low.groupBy(key, F.col("__b").alias(at)).agg(F.sum(value).alias(value))
        more = f"{out}__above"  # a name of its own on each level
        above = exclusive_sums(tops, key, at, value, more, -(-count // fan), fan)
        low = low.join(above.select(key, F.col(at).alias("__b"), more), [key, "__b"]).withColumn(out, F.col(out) + F.col(more)).drop(more)
    return low.drop("__b")


def is_true_fold(col, modulus: int, remainder: int):
    """crc32 of the identifier's decimal text, taken modulo."""
    return F.crc32(col.cast("string").cast("binary")) % modulus == remainder


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8: bytes.split() cuts at exactly that white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on arrays."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Recent(dict):
    """A memory of at most `limit` made values, in two generations.

    When the young one is full it becomes the old one, and what is used again
    moves back: values in use outlast any number of values seen once.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.half, self.old = limit // 2, {}

    def make(self, key):
        raise NotImplementedError

    def worth(self, key) -> bool:
        """Whether to remember the value."""
        return True

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
            if not self.worth(key):
                return value
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words.  Hashing anew is cheaper than remembering a vocabulary that keeps growing."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(32))) * _C1
    x += b * _C2
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of each run of n consecutive words, from the words' hashes: runs of 1, 2, 4, ... words, joined to n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power = mix64(h ^ np.uint64(0xA0761D6478BD642F * seed % 2**64)) if seed else h
    out, have, width = None, 0, 1
    while True:
        if n & width:
            out = power if out is None else _paired(out[: len(out) - width], power[have:])
            have += width
        if width * 2 > n:
            return mix64(out[:m])
        power = _paired(power[: len(power) - width], power[width:])
        width *= 2
