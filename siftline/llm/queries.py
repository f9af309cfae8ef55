"""The corpus operators' named queries, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, common, embedding, exact_dedup, language, licenses, minhash, mixing, negatives, secret_scan, substring, token_count, toxicity, trie


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, sf_dir), keep="largest")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir), k=4, percent=80)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = common.is_true_fold(F.col("doc_id"), 4, 2)
    model = language.fit(docs, ~held_out)
    out = language.label(docs.select("doc_id", "text"), model, with_spans=False)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    out = licenses.scan(docs, licenses.fit(docs))
    best = F.array_max(F.transform("findings", lambda x: x["probability"]))
    return out.select("doc_id", "n_paragraphs", F.size("findings").cast("long").alias("n_findings"), F.array_join("families", ",").alias("families"), F.coalesce(best, F.lit(0.0)).alias("probability"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_docs(spark, sf_dir), window=20).drop("gone")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mixture(_docs(spark, sf_dir)).taken()


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = common.is_true_fold(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, labels, ~held_out)
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = token_count.count_tokens(_docs(spark, sf_dir).select("doc_id", "text"), path, limit=1024)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = byte_bpe.digests(_docs(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    out = secret_scan.scan(docs, secret_scan.fit(docs))
    count = [secret_scan.count_of(F.col("findings"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    base = F.sha2(secret_scan.spans_text(F.col("findings"), base_only=True), 256)
    return out.select("doc_id", *count, base.alias("base_sha256"), secret_scan.spans_text(F.col("findings")).alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.hard_negatives(rows.withColumn("label", moved), anchors=F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie.prefix_trie(trie.spliced(turns)).drop("node", "parent", "points", "n_ends")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_minhash": op2_minhash,
    "op3_language": op3_language,
    "op4_embedding": op4_embedding,
    "op5_licenses": op5_licenses,
    "op6_substring": op6_substring,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_token_counts": op9_token_counts,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_secrets": op11_secrets,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)
    """,
    "op12_hard_negatives": """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS k
                   FROM embeddings
                   WHERE label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.k AS a, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
                          list_dot_product(a.v, b.v)::BIGINT AS score
                   FROM r a JOIN r b ON a.k <> b.k AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
             p AS (SELECT a, anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, row_number() OVER w AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        WINDOW w AS (PARTITION BY p.a, positive_id ORDER BY s.score DESC, s.id)
        QUALIFY row_number() OVER w <= 3
    """,
    "op13_prefix_trie": """
        WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
             h AS (SELECT c, c - c % 100 AS base,
                          xor(list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                              lambda crc, x: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(crc, x)),
                              4294967295), 4294967295) % 6 AS h
                   FROM (SELECT DISTINCT c FROM o)),
             b AS (SELECT h.c, 0 AS own, pos, role, text FROM h JOIN o ON o.c = h.base AND pos < h.h
                   UNION ALL SELECT h.c, 1, pos, role, text FROM h JOIN o ON o.c = h.c AND pos >= h.h),
             r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, role, text FROM b),
             p AS (SELECT c, d, text, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS key FROM r
                   UNION ALL SELECT c, 0, '', '' FROM h),
             n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, length(any_value(text)) AS points FROM p GROUP BY key, d),
             k AS (SELECT left(key, 64 * (d - 1)) AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
             a AS (SELECT p.key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * points) AS saved_tokens
                   FROM n LEFT JOIN k USING (key) JOIN p ON p.c = n.conv_id AND p.d <= n.d GROUP BY 1),
             e AS (SELECT p.key, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids
                   FROM p JOIN (SELECT c, max(d) AS d FROM p GROUP BY 1) l USING (c, d) GROUP BY 1)
        SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
               n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM n JOIN a USING (key) LEFT JOIN k USING (key) LEFT JOIN e USING (key)
        LEFT JOIN n u ON n.d > 0 AND u.key = left(n.key, 64 * (n.d - 1))
    """,
}
