import random
from array import array

import public_tokenizers as P
import pytest
import tiktoken

from weftline.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


PARTS = [" ", "  ", "\n", " \n", "\t", "a", "the", "'s", "'ll", "1", "23", "é", "日本", "́", "!", "...", "==", "\x1c", "\x85", "\xa0", "😀", "don't", "ſ", "\x00", "<|endoftext|>"]


def test_ids_equal_those_of_the_library_and_decode_back(codec, reference):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a" * 2000, " " * 2000, "ab" * 700 + "=" * 900, "".join(rng.choices("abcdefgh", k=5000))]
    for t in texts:
        ids = codec.encode(t)
        assert list(array("I", ids)) == reference.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_appends_and_edits_are_exact(codec):
    rng = random.Random(6)
    alphabet = b"the and ingtionabc"
    for _ in range(200):
        state, data = bpe.PrefixState(codec.bpe), b""
        for _ in range(5):
            more = bytes(rng.choices(alphabet, k=rng.randint(0, 12)))
            state.append(more)
            data += more
        assert state.ids() == bpe.PrefixState(codec.bpe, data).ids()
        at = rng.randint(0, len(data))
        removed, inserted = rng.randint(0, len(data) - at), bytes(rng.choices(alphabet, k=rng.randint(0, 6)))
        state.edit(at, removed, inserted)
        data = data[:at] + inserted + data[at + removed :]
        assert state.data == data and state.ids() == bpe.PrefixState(codec.bpe, data).ids()


def test_edit_stops_near_the_edit(codec):
    state = bpe.PrefixState(codec.bpe, b"abcdefgh" * 500)
    assert state.edit(10, 1, b"x") < 1000


def test_small_cache_gives_the_same(codec):
    ranks = bpe.load_ranks(PATH)
    small = bpe.TextCodec(ranks, P.PATTERN)
    small.spaced.entries = small.piece.entries = 2
    for t in ("one two three two one four", "a b a b c d e f a b"):
        assert small.encode(t) == codec.encode(t)


def test_frames(spark):
    rows = [(1, "hello world", "x"), (None, None, "y"), (2, "", None), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = bpe.encode(df, PATH, P.PATTERN)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out.collect()) == [(0, 0), (1, 2), (2, 0), (2, 0)]
    back = bpe.decode(out, PATH, P.PATTERN)
    assert {bytes(r.bytes) for r in back.collect()} == {b"hello world", b""}
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN, with_ids=True).collect() == []


def test_query_equals_the_library(spark, reference):
    import hashlib

    import duckdb

    d = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall())
    want = set()
    for i, t in texts.items():
        ids = array("I", reference.encode_ordinary(t or "")).tobytes()
        want.add((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_byte_bpe(spark, d).collect()} == want
