"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns documents; ``run`` writes each result as Parquet to the shared
folder and rereads it as the next stage's input.

For every stage an empty table gives no rows, texts of any length are worked on
whole, and further columns pass through whatever their names, except that the last
stage replaces columns named like its outputs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import byte_bpe, exact_dedup, minhash, mixing, toxicity
from siftline.llm.common import materialize
from siftline.storage import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained from ``labels``, scores under one half.

    Null and empty texts score by the bias alone and stay; rows that repeat stay or go
    together; a score of exactly one half goes.
    """
    settle(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.lit(True))
    scored = toxicity.score(docs, model, out="__toxicity")
    return scored.filter("__toxicity < 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest identifier.

    Null is the empty text; a null identifier is the smallest; of rows that repeat
    identifier and text one stays.
    """
    settle(spark)
    return exact_dedup.deduplicate(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    Null, empty and white-space texts and null identifiers are near nothing and stay;
    of a group the smallest identifier stays, with all rows that repeat it and its text.
    """
    settle(spark)
    return minhash.keep_one(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, at most three times.

    Null and empty texts have no words to take and stay once; a null source is a
    source; rows that repeat are drawn alike.
    """
    settle(spark)
    return mixing.resample(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, checked by decoding them again.

    Null and empty texts have no ids; rows that repeat are encoded each for itself.
    """
    settle(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.digests(docs, path, pattern, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("minhash near-dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode_tokens),
]

#: Training, hashing into bands and byte-pair merging are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
