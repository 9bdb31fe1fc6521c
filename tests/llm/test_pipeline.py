import hashlib
from collections import Counter, defaultdict

import corpus_pipeline as c
import duckdb
import public_tokenizers as P
import tiktoken
from test_line_dedup import brute as lines
from test_mixing import expected
from test_near_dedup import brute as near

from weftline.llm.bpe import load_ranks

D = "/root/testdata/sf0.001"


def test_stages_and_their_order():
    assert [n for n, _ in c.STAGES] == ["language ID", "line dedup", "near dedup", "mixing", "byte-level BPE"] and c.ORACLE_SQL is None


def rows(df):
    return [tuple(r) for r in df.select(*c.COLUMNS).collect()]


def test_each_stage_equals_brute_force_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(c.STAGES):
        out = stage(spark, docs, D)
        assert i == 4 or out.columns == list(c.COLUMNS)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept.append(docs)
    ids = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{D}/documents.parquet' WHERE regexp_matches(text, '\\pL')").fetchall()}
    assert {r[0] for r in rows(kept[0])} == ids

    want = {(i, t, len(t)) for i, t, _, n in lines([r[:2] for r in rows(kept[0])]) if n == 0 or t.strip(" ")}
    assert {(r[0], r[1], r[4]) for r in rows(kept[1])} == want

    stay = {i for i, _, _, keep in near([r[:2] for r in rows(kept[1])], 5, 80) if keep}
    assert {r[0] for r in rows(kept[2])} == stay and len(rows(kept[2])) == len(stay)

    goal, have, most = defaultdict(float), defaultdict(int), defaultdict(int)
    sizes = {r[0]: len(r[1].split()) for r in rows(kept[2])}
    for r in rows(kept[2]):
        goal[r[3]] += sizes[r[0]]
        most[r[3]] = max(most[r[3]], sizes[r[0]])
    goal = expected(dict(goal))
    mixed = rows(kept[3])
    whole = {r[0]: r for r in rows(kept[2])}
    assert all(r == whole[r[0]] for r in mixed) and max(Counter(r[0] for r in mixed).values()) <= 3
    for r in mixed:
        have[r[3]] += sizes[r[0]]
    assert all(abs(have[s] - goal[s]) <= most[s] / 2 + 1 for s in goal)

    ranks = load_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = sorted((r[0], r[1]) for r in mixed)
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in kept[4].collect())
    assert got == sorted((i, len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for i, t in text)


def test_run(spark):
    assert {"doc_id", "ids", "n_tokens"} <= set(c.run(spark, D).columns)


def test_stages_on_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for _, stage in c.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), D).collect() == []
    rows = [(1, None, "en", None, None), (1, "one two three four", "en", "a", 3), (1, "one two three four", "en", "a", 3), (None, "three four one", None, "b", 14), (2, "", "en", "a", 0), (3, "w " * 100_000, "en", "a", 1)]
    df = spark.createDataFrame(rows, schema)
    by = {n: stage(spark, df, D).collect() for n, stage in c.STAGES}
    assert sorted(r.doc_id or 0 for r in by["language ID"]) == [0, 1, 1, 3]
    assert [r.text for r in by["line dedup"] if r.doc_id is None] == ["three four one"]
    assert len(by["near dedup"]) == 6 and len(by["byte-level BPE"]) == 6
    assert {r.text for r in by["mixing"]} <= {r[1] for r in rows}
