import random
import re

import numpy as np
import pytest

from weftline.llm.graph import components
from weftline.llm.near_dedup import joint_estimate, near_duplicates, registers
from weftline.llm.shingles import mixed, sets

WORDS = [f"w{i}" for i in range(400)]


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    s = {i: shingles(t, width) for i, t in rows}
    label = {i: i for i in s}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(s)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {(i, len(s[i]), root(i), root(i) == i) for i in s}


def near(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n int, label string") if rows and len(rows[0]) == 4 else spark.createDataFrame(rows, "doc_id bigint, text string")
    return {tuple(r) for r in near_duplicates(df, **kw).collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, width, percent):
    rng = random.Random(width)
    rows = []
    for _ in range(25):
        base = rng.choices(WORDS, k=rng.randint(5, 200))
        rows += [" ".join(edited(rng, base, rng.randint(0, 4))) for _ in range(rng.randint(1, 6))]
    # a chain: each is like the next one, its ends are not like each other
    base = rng.choices(WORDS, k=120)
    for _ in range(12):
        base = edited(rng, base, 2)
        rows.append("  ".join(base).upper() + "\n")
    rng.shuffle(rows)
    rows = [(i, t) for i, t in enumerate(rows)]
    assert near(spark, rows, width=width, percent=percent) == brute(rows, width, percent)


def test_family_without_links_to_its_first(spark):
    rng = random.Random(9)
    base = rng.choices(WORDS, k=150)
    rows = [(i, " ".join(edited(rng, base, 9))) for i in range(60)]
    assert near(spark, rows, width=3, percent=85) == brute(rows, 3, 85)


def test_nulls_short_texts_and_repeats(spark):
    rows = [(1, None), (2, " \n"), (3, "Ab c"), (4, "aB  C "), (5, "ab"), (6, "c ab"), (7, "x y z q"), (7, "x y z q")]
    got = near(spark, rows, width=3, percent=85)
    assert got == {(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 6, True), (7, 2, 7, True)}
    assert near(spark, []) == set()
    assert near(spark, [(None, "a b c d e f"), (1, "a b c d e f")]) == {(None, 2, None, True), (1, 2, 1, True)}
    assert near(spark, [(1, "a b c", 1, "x"), (2, "a b c", 2, "y")]) == {(1, 1, 1, True), (2, 1, 1, False)}


def test_sets_hold_what_words_give():
    rng = random.Random(1)
    texts = ["", None, "one", "one two", "A\tb\x0bc  d", "é ü ß É", "x" * 700_000 + " y z", " ".join(rng.choices(WORDS, k=3000))]
    texts += [" ".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in range(200)]
    for width in (1, 3, 5):
        made = list(sets(texts, width))
        want = [shingles(t, width) for t in texts]
        assert [len(x) for x in made] == [len(x) for x in want]
        assert len({x.tobytes() for x in made}) == len(set(want))


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        a, b, n = [], [], 400
        for _ in range(60):
            x = mixed(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
            both = int(2 * n * share / (1 + share))
            a.append(registers(np.unique(x[:n])))
            b.append(registers(np.unique(x[n - both : 2 * n - both])))
        size = np.full(60, float(n))
        got = joint_estimate(np.array(a), np.array(b), size, size)
        assert abs(got.mean() - both / (2 * n - both)) < 0.03


def test_merged_registers_are_those_of_the_union():
    x = mixed(np.arange(1, 500, dtype=np.uint64))
    assert (np.maximum(registers(x[:300]), registers(x[200:])) == registers(x)).all()


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 7), (5, 5), (159, 158)]
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert set(got) == {*range(100, 161), *range(200, 260), 3, 7}
    assert all(got[i] == (100 if 100 <= i <= 160 else 3) for i in got)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("size", [300, 1500])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, size):
    from weftline.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", size)
    rng = random.Random(size)
    rows = []
    for k in range(3):
        base = rng.choices(WORDS, k=150)
        rows += [" ".join(edited(rng, base, 4 + k)) for _ in range(40)]
    rows = list(enumerate(rows))
    assert near(spark, rows, width=3, percent=85) == brute(rows, 3, 85)


def test_words_that_polynomial_hashes_confuse(spark):
    t = "a"
    while len(t) < 1024:
        t += t.translate({97: 98, 98: 97})
    rows = [(1, t), (2, t.translate({97: 98, 98: 97})), (3, t)]
    assert near(spark, rows, width=3, percent=85) == {(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False)}


def test_rows_that_repeat_an_id_with_other_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(30))
    got = near(spark, [(1, a), (1, b), (2, a), (3, b), (4, None), (1, None)], width=3, percent=85)
    verdict = {(i, c) for i, _, c, _ in got}
    # one of its texts stands for 1, and 2 or 3 goes with it
    assert {x for x in got if x[0] == 1} == {(1, 38, 1, True), (1, 28, 1, True), (1, 0, 1, True)}
    assert verdict - {(1, 1), (4, 4)} in ({(2, 1), (3, 3)}, {(2, 2), (3, 1)})


def test_very_long_text(spark):
    t = " ".join(f"w{i % 70_001}" for i in range(300_000))
    assert near(spark, [(1, t), (2, t + " x"), (3, "w1 w2 w3")], width=3, percent=85) == {(1, 70_001, 1, True), (2, 70_002, 1, False), (3, 1, 3, True)}
