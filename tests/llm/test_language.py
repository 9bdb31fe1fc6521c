import random

import zlib

import numpy as np

from weftline.llm.language import GRAM, HASHES, MULTIPLIERS, fit, fit_texts, grams, known_only, normal, op9_language, predict, sample

STEMS = {"en": ["the", "ing", "ther", "wh", "sh", "and"], "de": ["sch", "ung", "ein", "der", "pf", "zu"], "xx": ["qa", "qi", "zzo", "kwe"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


def labelled(rng, n=40):
    return [(lang, text(rng, lang)) for lang in STEMS for _ in range(n)]


def test_learns_and_predicts():
    rng = random.Random(0)
    model = fit_texts(labelled(rng))
    got = model.predict([text(rng, lang) for lang in STEMS for _ in range(20)])
    assert [g[0] for g in got] == [lang for lang in STEMS for _ in range(20)]
    assert all(0 <= s <= 1 and 0 <= c <= 1 for _, s, c in got)


def test_blocks_change_nothing():
    rng = random.Random(1)
    model = fit_texts(labelled(rng))
    texts = [text(rng, "en", 30_000), "der und", "", "!!! 12", text(rng, "de"), text(rng, "xx", 200_000), "a"]
    assert model.predict(texts) == [model.predict([t])[0] for t in texts]
    assert [g[0] for g in model.predict(["", "12 .", None or ""])] == ["und"] * 3


def test_frames(spark):
    rng = random.Random(2)
    rows = [(i, t, lang, "s") for i, (lang, t) in enumerate(labelled(rng, 10))]
    rows += [(100, None, "en", None), (101, "?!", None, "s"), (None, text(rng, "de"), "de", "s"), (5, rows[5][1], "en", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    model = fit(df)
    got = predict(df, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (100, 101)} == {"und"}
    assert predict(df.limit(0), model).count() == 0
    kept = known_only(df, model, 0.2)
    assert kept.columns == df.columns and kept.where("doc_id in (100, 101)").count() == 0 and kept.count() == len(rows) - 2
    none = fit(df.limit(0))
    assert {r.lang_pred for r in predict(df, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    got = op9_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_bloom_counts_equal_plain_lookups():
    rng = random.Random(5)
    model = fit_texts(labelled(rng))
    for t in (text(rng, "en", 50), text(rng, "xx", 5), "a", "Ärger und Öl"):
        data = normal(t)
        want = [0] * len(model.languages)
        for k in range(len(data) - GRAM + 1):
            g = int.from_bytes(data[k : k + GRAM], "little")
            at = [((g ^ g >> 15) * m % 2**32) >> (32 - model.table.shape[1].bit_length() + 1) for m in MULTIPLIERS[:HASHES]]
            for i in range(len(model.languages)):
                want[i] += all(int(model.table[i // 64][p]) >> i % 64 & 1 for p in at)
        assert model.counts(data)[0].tolist() == want and len(grams(data)) == len(data) - GRAM + 1
    # every n-gram that a language was taught is found there
    taught = grams(normal("the thing"))
    own = fit_texts([("en", "the thing")])
    assert own.hits(taught, np.array([0]))[0, 0] == len(taught)


def test_query_holds_out_by_its_rule(spark):
    rows = op9_language(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)


def test_sample_is_bounded(spark):
    rows = [(i, "w" * 10 + str(i), "a") for i in range(300)] + [(7, "same", "b")] * 200 + [(1000, "long" * 1000, "c"), (1001, "longer" * 1000, "c"), (1002, None, "c"), (1003, "x", None)]
    df = spark.createDataFrame(rows, "i bigint, l string, h string")
    got = sample(df, "i", "l", "h", rows=50, size=3000)
    count = {k: sum(x == k for x, _ in got) for k in "abc"}
    assert 40 <= count["a"] <= 50 and count["b"] == 1 and count["c"] == 1
    assert got == sample(df.repartition(5), "i", "l", "h", rows=50, size=3000)
    assert {x for x, _ in sample(df, "i", "l", "h", languages=1)} == {"a"} and sample(df.limit(0), "i", "l", "h") == []
