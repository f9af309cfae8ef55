"""The pipeline's stages on the small tables: each works on what the one before kept."""

import corpus_pipeline
import pytest
from siftline.llm import common

DATA = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "minhash near-dedup", "mixing sources", "byte-level bpe"]
    ids = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.materialize(stage(spark, docs, DATA), "stage")
        rows = out.collect()
        assert rows and {r.doc_id for r in rows} <= ids
        assert out.columns[: len(columns)] == columns
        if k < 4:
            assert out.columns == columns
        if name == "exact dedup":
            assert len({r.text for r in rows}) == len(rows) == len({r.text for r in docs.collect()})
        if name == "mixing sources":
            copies = {}
            for r in rows:
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
            assert max(copies.values()) <= 3
        else:
            assert len(rows) <= docs.count()
        ids, docs = {r.doc_id for r in rows}, out
    assert all(len(r.ids) == r.n_tokens for r in rows)


def test_run_is_repeatable(spark):
    one = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    two = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, DATA).collect())
    assert one == two
    common.release(spark)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("false")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, DATA).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, name):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns with the names of outputs."""
    real = spark.read.parquet(f"{DATA}/documents.parquet").limit(20)
    rows = [
        (None, None, None, None, None, 1, "o"), (901, None, "en", "src0", 0, 2, "o"), (902, "", None, None, 0, 3, "o"), (903, " \n\t", "en", "src1", 3, 4, "o"),
        (904, "some words that repeat in a row of their own " * 3, "en", "src0", 10, 5, "o"), (904, "some words that repeat in a row of their own " * 3, "en", "src0", 10, 5, "o"),
        (905, "a very long text indeed with words " * 40_000, "en", "src1", 10, 6, "o"), (906, "tie", "en", "src1", 3, 7, "o"), (907, "tie", "en", "src0", 3, 8, "o"),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long, Score int, ids_sha256 string"
    docs = spark.createDataFrame(rows, kind).unionByName(real.selectExpr("*", "0 AS Score", "'o' AS ids_sha256")).repartition(3)
    out = common.materialize(dict(corpus_pipeline.STAGES)[name](spark, docs, DATA), "edges")
    got = out.collect()
    ids = [r.doc_id for r in got]
    if name != "byte-level bpe":
        assert out.columns == docs.columns
    # the row without identifier and text is a copy of the other empty ones
    assert (None in ids) == (name != "exact dedup") and {901, 902, 903, 905} & set(ids)
    if name == "toxicity":
        assert {901, 902, 903, 904, 905, 906, 907} <= set(ids) and ids.count(904) == 2
    if name == "exact dedup":
        assert ids.count(904) == 1 and 907 in ids and 906 not in ids and 902 in ids and 901 not in ids
    if name == "minhash near-dedup":
        assert {901, 902, 903, 906} <= set(ids) and 907 not in ids and ids.count(904) == 2
    if name == "mixing sources":
        assert {901, 902, 903} <= set(ids) and max(ids.count(i) for i in (905, 906, 907)) <= 3
    if name == "byte-level bpe":
        assert len(got) == docs.count() and out.columns[-4:] == ["n_tokens", "ids_sha256", "decoded_sha256", "ids"] and {r.n_tokens for r in got if not r.text} == {0}
    common.release(spark)
