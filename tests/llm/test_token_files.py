import random
import uuid
import zlib
from array import array

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from weftline.llm.common import shared_dir
from weftline.llm.token_files import BATCH, TokenFile, read_back, words, write

PATH = P.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "The", "'s", "'LL", "23", "é", "ß", "日本", "́", "!", "==", "\x1c", "\x85", "\xa0", "😀", "don't", "İ", "ΟΔΟΣ", "\x00", "<|endoftext|>", "<|", "Ö", "½"]


def test_ids_equal_those_of_the_library():
    w, full, rng = words(PATH), Tokenizer.from_file(PATH), random.Random(7)
    for _ in range(2000):
        t = "".join(rng.choices(PARTS, k=rng.randint(0, 25)))
        assert list(array(w.code, w.ids(t))) == full.encode(t, add_special_tokens=False).ids


def check(spark, rows, length=64):
    folder = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    made = write(spark.createDataFrame(rows, "doc_id bigint, text string"), folder, PATH, length=length)
    got = sorted((tuple(r) for r in read_back(made).collect()), key=lambda r: r[1])
    full, at, want = Tokenizer.from_file(PATH), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = full.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    return made


def test_round_trip_through_files(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 60)))) for i in rng.sample(range(-50, 10_000), 300)]
    rows += [(20_000, None), (20_001, ""), (20_002, "wide word " * 30_000), (None, "first")]
    check(spark, rows)


def test_sequences_and_masks(spark):
    made = check(spark, [(i, "some words here " * 20) for i in range(500)], length=32)
    for r in made.collect():
        f = TokenFile(r.path)
        n = -(-r.n_tokens // 32)
        for i in {0, n - 1, n // 2, min(BATCH, n - 1)}:
            ids, mask = f.sequence(i)
            real = min(32, r.n_tokens - 32 * i)
            assert len(ids) == 32 and sum(mask.to_pylist()) == real
            assert (ids[:real] == f.tokens(32 * i, real)).all()


def test_empty_table(spark):
    check(spark, [])


def test_clashing_names(spark):
    folder = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df = spark.createDataFrame([(1, "a b", 7, "x"), (2, None, 8, "y")], "`doc.id` bigint, `text` string, id int, start string")
    got = read_back(write(df, folder, PATH, "doc.id")).collect()
    assert [(r.doc_id, r.n_tokens) for r in sorted(got)] == [(1, 3), (2, 1)]
