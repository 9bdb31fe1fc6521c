import numpy as np
from pyspark.sql import functions as F

from weftline.llm.ann import Segment, _unit, op6_permutation_index, places, prefix_of, search


def brute(rows, is_query, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for i, q in good:
        if is_query(i):
            scored = [(-round(float(q @ v) / float(np.linalg.norm(q) * np.linalg.norm(v)), 12), j) for j, v in good if j != i]
            out[i] = [j for _, j in sorted(scored)[:k]]
    return out


def run(spark, rows, k=5, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in search(df, F.col("vec_id") % 10 == 0, k, **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def test_ranking_all_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(20)]  # ties
    rows += [(300, None), (310, [0.0] * 8), (320, [None] + [1.0] * 7), (330, [float("nan")] * 8), (340, [float("inf")] * 8), (350, [1.0, 2.0])]
    got, want = run(spark, rows, least=1000), brute([r for r in rows if r[0] != 350], lambda i: i % 10 == 0, 5)
    assert {q: [v for _, v, _ in x] for q, x in got.items()} == want
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        a = np.array(dict(rows)[q], float)
        for _, v, s in found:
            b = np.array(dict(rows)[v], float)
            assert abs(s - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_recall_on_vectors_without_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).astype(np.float32).tolist()) for i in range(3000)]
    got, want = run(spark, rows, least=1000), brute(rows, lambda i: i % 10 == 0, 5)
    hits = sum(len({v for _, v, _ in got[q]} & set(w)) for q, w in want.items())
    assert hits >= 0.9 * 5 * len(want)


def test_few_empty_and_repeated(spark):
    assert run(spark, []) == {}
    assert run(spark, [(10, [1.0, 0.0])]) == {}
    got = run(spark, [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (3, [1.0, 1.0])], k=5)
    assert {v for _, v, _ in got[10]} == {3}
    df = spark.createDataFrame([(10, [1.0, 0.0], 1, "x"), (3, [1.0, 1.0], 2, "y")], "vec_id bigint, embedding array<float>, lane int, `a.b` string")
    assert [tuple(r)[:3] for r in search(df, F.col("vec_id") == 10).collect()] == [(10, 1, 3)]
    same = run(spark, [(i, [1.0, 2.0]) for i in range(400)] + [(7, [1.0, 2.0])] * 300, segment=64)
    assert [v for _, v, _ in same[0]] == [1, 2, 3, 4, 5] and [v for _, v, _ in same[10]] == [0, 1, 2, 3, 4]


def test_footrule_and_postings():
    rng = np.random.default_rng(4)
    m, pivot = rng.normal(size=(600, 16)), _unit(rng.normal(size=(200, 16)))
    k = prefix_of(200)
    seg = Segment(np.arange(600), m, pivot, k)
    order = places(_unit(m), pivot, k)
    for q in range(0, 600, 97):
        read, _ = seg.postings(order[q])
        d = seg.footrule(order[q])
        for v in range(0, 600, 41):
            a, b = order[q].tolist(), order[v].tolist()
            assert d[v] == sum(abs((a.index(p) if p in a else k) - (b.index(p) if p in b else k)) for p in {*a, *b})
    assert np.mean([len(seg.postings(o)[0]) for o in order]) < 600


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    a, b = (sorted(map(tuple, search(x, F.col("vec_id") % 10 == 0, segment=200).collect())) for x in (df.coalesce(1), df.repartition(7)))
    assert a == b


def test_recall_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows, lambda i: i % 50 == 0, 5)
    got = {}
    for r in op6_permutation_index(spark, d).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    vectors = {i: np.array(v, float) for i, v in rows if v is not None}
    for q, found in got.items():
        assert sorted(found) == list(range(1, len(found) + 1)) and q not in {v for v, _ in found.values()}
        ranked = [found[k] for k in sorted(found)]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0]))
        for v, s in ranked:
            assert abs(s - vectors[q] @ vectors[v] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[v])) < 1e-12
    assert set(got) == set(want)
    assert sum(len({v for v, _ in got[q].values()} & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))
