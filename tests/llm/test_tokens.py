"""Token counts and byte-level BPE against the libraries, and exact round trips."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from siftline.llm import byte_bpe, token_count
from tokenizers import Tokenizer

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", " ", "a", "\n\n \t x", "Hello  world!", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>",
    "é ü ß 漢字 \x1c\x85​ x", "=" * 3000, "ab" * 2000, "don't we'LL I'd", "1234567 ١٢٣", "🙂🙂 flag 🇩🇪", "՘֋ x",
]


@pytest.fixture(scope="module")
def lib_count():
    t = Tokenizer.from_file(JSON)
    return lambda x: len(t.encode(x or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def lib_codec():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_match_library(lib_count):
    c = token_count.counter(JSON)
    for text in TEXTS:
        assert c.count(text) == lib_count(text), text
    rng = random.Random(1)
    for _ in range(400):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(9, 14), rng.randrange(160, 1500), rng.randrange(0x4E00, 0x4F00)])) for _ in range(rng.randrange(60)))
        assert c.count(text) == lib_count(text), text


def test_late_code_points_split_as_in_the_library(lib_codec):
    from tokenizers import pre_tokenizers

    lib, own = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True), token_count.PieceSplitter(P.PATTERN)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or (c > 0x3100 and c % 7):
            continue
        s = "a" + chr(c) + "1" + chr(c) + "!" + chr(c)
        assert own(s) == [s[i:j] for _, (i, j) in lib.pre_tokenize_str(s)], hex(c)
        if c > 0x557 and c % 5 == 0:
            assert list(byte_bpe.codec(RANKS, P.PATTERN).encode(s)) == lib_codec.encode_ordinary(s), hex(c)


def test_codec_matches_library_and_round_trips(lib_codec):
    c = byte_bpe.codec(RANKS, P.PATTERN)
    for text in TEXTS:
        ids = c.encode(text)
        assert list(ids) == lib_codec.encode_ordinary(text or "")
        assert c.decode(ids) == (text or "").encode()


def test_append_and_edit_equal_a_fresh_table():
    ranks = byte_bpe.codec(RANKS, P.PATTERN).ranks
    rng = random.Random(2)
    for _ in range(40):
        data = "".join(rng.choice("etaoin shr") for _ in range(40)).encode()
        grown = byte_bpe.PrefixTable(ranks)
        for i in range(0, 40, 7):
            grown.append(data[i : i + 7])
        assert grown.ids() == byte_bpe.PrefixTable(ranks, data).ids()
        at = rng.randrange(30)
        grown.edit(at, 3, b"xyz e")
        assert grown.ids() == byte_bpe.PrefixTable(ranks, data[:at] + b"xyz e" + data[at + 3 :]).ids()


def test_an_edit_recomputes_a_bounded_stretch():
    ranks = byte_bpe.codec(RANKS, P.PATTERN).ranks
    rng = random.Random(3)
    for inserted in (b"", b"q", b"xyz e"):
        data = "".join(rng.choice("etaoinshr") for _ in range(60_000)).encode()
        table = byte_bpe.PrefixTable(ranks, data)
        assert table.edit(20_000, 2, inserted) <= 5 * ranks.longest
        assert table.ids() == byte_bpe.PrefixTable(ranks, data[:20_000] + inserted + data[20_002:]).ids()


def test_edits_and_appends_of_whole_texts(lib_codec):
    one, rng = byte_bpe.codec(RANKS, P.PATTERN), random.Random(4)
    alphabet = ["a", "the", " ", "  ", "\n", "'re", "'", "1", "22", "é", "漢", "!", "?!", "\u0558", "\U0003FFFF", "\t"]

    def some(n):
        return "".join(rng.choice(alphabet) for _ in range(rng.randrange(n)))

    for _ in range(150):
        text = some(60)
        table = byte_bpe.TextTable(one, text)
        for _ in range(6):
            at = rng.randrange(len(text) + 1)
            removed, inserted = rng.randrange(min(5, len(text) - at) + 1), some(5)
            text = text[:at] + inserted + text[at + removed :]
            table.edit(at, removed, inserted)
            assert table.text == text and table.ids() == lib_codec.encode_ordinary(text), text
        more = some(8)
        table.append(more)
        text += more
        assert table.ids() == lib_codec.encode_ordinary(text), text
    text = "some words of a long text, " * 4000
    table = byte_bpe.TextTable(one, text)
    assert table.edit(50_000, 3, "XYZ 12") <= 4 * one.ranks.longest
    assert table.ids() == lib_codec.encode_ordinary(text[:50_000] + "XYZ 12" + text[50_003:])


def test_many_pieces_leave_the_memory_bounded(lib_codec):
    one = byte_bpe.Codec(RANKS, P.PATTERN)
    one.half = 50
    words = ["w%d" % (i % 997) for i in range(3000)]
    for i in range(0, 3000, 100):
        text = " ".join(words[i : i + 100])
        assert list(one.encode(text)) == lib_codec.encode_ordinary(text)
        assert len(one) <= 50 and len(one.old) <= 50


def test_edges_of_frames(spark):
    assert byte_bpe.digests(spark.createDataFrame([], "doc_id long, text string"), RANKS, P.PATTERN).count() == 0
    rows = [(1, "a b", "x", 5), (1, "a b", "x", 5), (None, None, None, None), (2, "long " * 300_000, "y", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS_sha256 string, ids long")
    out = byte_bpe.digests(df, RANKS, P.PATTERN, with_ids=True)
    assert sorted(out.columns) == ["decoded_sha256", "doc_id", "ids", "ids_sha256", "n_tokens", "text"]
    got = {(r.doc_id, r.n_tokens) for r in out.collect()}
    assert out.count() == 4 and (None, 0) in got and any(i == 2 and n >= 300_000 for i, n in got)
    assert byte_bpe.encode(df, RANKS, P.PATTERN).columns.count("ids") == 1


def test_frames(spark, lib_count, lib_codec):
    rows = [(i, t, "old") for i, t in enumerate(TEXTS)] + [(0, None, "old")]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string")
    out = token_count.count_tokens(df, JSON).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.n_tokens == lib_count(r.text) and r.n_bytes == len((r.text or "").encode())
        assert r.over_limit == (r.n_tokens > 1024)
    for r in byte_bpe.digests(df, RANKS, P.PATTERN).collect():
        ids = lib_codec.encode_ordinary(r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    enc = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in enc.collect())
    assert token_count.count_tokens(df.filter("false"), JSON).count() == 0
