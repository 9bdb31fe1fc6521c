import random
from collections import defaultdict

import numpy as np
import pytest

from weftline.llm.mixing import mix, splitting_tree


def expected(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest, open_w = total - sum(most * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        goal = {s: most * sizes[s] if s in full else rest * w[s] / open_w for s in names}
        new = {s for s in names if s not in full and goal[s] > most * sizes[s]}
        if not new:
            return goal
        full |= new


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_what_is_taken(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("x" * 1 for _ in range(rng.choice([0, 1, 5, 50, 900]))), rng.choice(["a", "b", "B", "é", None, "hot", "hot", "hot", "hot", "hot"])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix(df, block_words=500, shards=5).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.size == len(rows[r.doc_id][1].split()) and 0 <= r.taken <= 3 * r.size
        assert r.taken == sum(d.words for d in r.draws) and all(0 <= d.shard < 5 for d in r.draws)
    goal = expected(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 1
    again = mix(df.repartition(7), block_words=500, shards=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_hold_their_quotas(spark):
    rows = [(i, "w " * 20, "ab"[i % 2]) for i in range(600)]
    got = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block_words=100, shards=4).collect()
    words = defaultdict(int)
    for r in got:
        for d in r.draws:
            words[d.shard] += d.words
    assert set(words) == {0, 1, 2, 3} and max(words.values()) < 1.3 * min(words.values())


def test_tree_is_exact_and_fair():
    quotas = [1000, 10, 0, 333, 1]
    for shards in (1, 2, 5, 8):
        tree = splitting_tree(quotas, shards, 3)
        assert tree.sum(axis=0).tolist() == quotas and len(tree) == shards
        assert np.ptp(tree.sum(axis=1)) <= 1
    draws = [splitting_tree([600, 400], 2, s)[0][0] for s in range(400)]
    # 500 drawn from 1000 of which 600 are good: mean 300, variance 60
    assert abs(sum(draws) / 400 - 300) < 2 and 40 < sum((x - 300) ** 2 for x in draws) / 400 < 85
    large = splitting_tree([4 * 10**8, 5 * 10**8], 4, 1)
    assert (large == splitting_tree([4 * 10**8, 5 * 10**8], 4, 1)).all() and large.sum(axis=0).tolist() == [4 * 10**8, 5 * 10**8]


def test_shards_follow_the_tree(spark, monkeypatch):
    from weftline.llm import mixing

    rows = [(i, "w " * (1 + i % 9), "abc"[i % 3]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    seen = []

    def tree(quotas, shards, seed):
        if shards == 4:
            seen.append(quotas)
            seen.append(made := splitting_tree(quotas, shards, seed))
            return made
        return splitting_tree(quotas, shards, seed)

    monkeypatch.setattr(mixing, "splitting_tree", tree)
    got = mix(df, block_words=50, shards=4).collect()
    quotas, made = seen
    assert len(quotas) == 3 and made.shape == (4, 3)
    # a block of a source is in as many shards as it is drawn, so blocks by shard add up to the tree
    blocks = defaultdict(set)
    sizes = {r.source: r.source_size for r in got}
    for r in got:
        for k, d in enumerate(r.draws):
            n = max(-(-sizes[r.source] // 50), 1)
            blocks[r.source, d.shard].add((k, int(spark_block(spark, r.doc_id)) % n))
    for i, s in enumerate("abc"):
        for shard in range(4):
            assert len(blocks[s, shard]) <= made[shard][i]
        assert sum(len(blocks[s, shard]) for shard in range(4)) <= quotas[i]
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, s: np.array([q, *[[0] * len(q)] * (n - 1)]))
    other = mix(df, block_words=50, shards=4).collect()
    assert {d.shard for r in other for d in r.draws} == {0}
    assert sorted((r.doc_id, r.taken) for r in other) == sorted((r.doc_id, r.taken) for r in got)


def spark_block(spark, i, cache={}):  # noqa: B006
    if not cache:
        from pyspark.sql import functions as F

        from weftline.llm.mixing import SEED

        cache |= {r[0]: r[1] for r in spark.range(900).select("id", F.xxhash64(F.lit(SEED), F.col("id"))).collect()}
    return cache[i]


def test_more_sources_than_any_stratum_and_long_texts(spark):
    rows = [(i, "w " * (i % 3 + 1), f"s{i}") for i in range(5000)] + [(5000, "long " * 300_000, "s1")]
    got = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=3).collect()
    assert len(got) == 5001 and max(r.size for r in got) == 300_000
    assert all(r.taken == sum(d.words for d in r.draws) <= 3 * r.size for r in got)


def test_mixed_rows_repeat_as_often_as_they_are_drawn(spark):
    from weftline.llm.mixing import mixed

    rows = [(1, "a b", "x", 1, "p"), (1, "c d", "x", 2, "p"), (None, "e f", "y", 3, "q"), (None, None, None, 4, "q"), (2, "g", "z", 5, "r")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, shard int, `a.b` string")
    got = mixed(df)
    assert got.columns == df.columns
    n = defaultdict(int)
    for r in got.collect():
        n[tuple(r)] += 1
    want = {r.shard: len(r.draws) for r in mix(df, whole=True, keep=("shard",)).collect()}
    assert {k[3]: v for k, v in n.items()} == {k: v for k, v in want.items() if v} and set(n) <= set(rows) and all(v <= 3 for v in n.values())


def test_empty_blank_null_and_clashing_names(spark):
    assert mix(spark.createDataFrame([], "doc_id bigint, text string, source string")).collect() == []
    rows = [(1, None, "a", 1), (2, " ", "a", 2), (3, "one two", None, 3), (3, "one two", None, 3), (None, "x", "b", 4)]
    got = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string, block int")).collect()
    assert sorted(r.size for r in got) == [0, 0, 1, 2, 2] and all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == 5
    blank = mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")).collect()
    assert {(r.target, r.taken) for r in blank} == {(0.0, 0)}


def test_pipeline_mixes_whole_documents(spark):
    from corpus_pipeline import mix_sources

    # three sources of one document: targets of half, once and one and a half times its size
    texts = {i: f"one {i}\ttwo  three\nfour five six" for i in range(3)}
    rows = [(i, t, "en", "abc"[i], len(t)) for i, t in texts.items()]
    got = mix_sources(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "").collect()
    assert {r.doc_id for r in got} == {0, 1, 2} and all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in got)

    rng = random.Random(5)
    rows = [(i, "x " * rng.choice([1, 7, 60, 900]), rng.choice("aaabbcd")) for i in range(150)] + [(150, "y " * 5000, "e"), (151, "z", "f")]
    out = mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(1.0, 2.0, 3.0, 1.0, 0.001), block_words=500, whole=True).collect()
    taken, largest, goal = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert all(d.words == r.size for d in r.draws) and len(r.draws) <= 3
        taken[r.source] += r.taken
        largest[r.source], goal[r.source] = max(largest[r.source], r.size), r.target
    assert all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1 or taken[s] == largest[s] for s in "abcdf")
    # its target is a few words, and it has one document
    assert 0 < goal["e"] < 100 and taken["e"] == 5000


def test_query_keeps_its_contract(spark):
    import re

    import duckdb

    from weftline.llm.mixing import op8_mixing

    d = "/root/testdata/sf0.001"
    docs = {i: (s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in duckdb.sql(f"SELECT doc_id, source, text FROM '{d}/documents.parquet'").fetchall()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for s, n in docs.values():
        sizes[s] += n
    goal, got = expected(sizes), op8_mixing(spark, d).collect()
    assert len(got) == len(docs)
    for r in got:
        s, n = docs[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 3 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
