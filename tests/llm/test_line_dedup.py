import random
import re

from weftline.llm.line_dedup import line_dedup


def words(line):
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), line)))


def brute(rows, percent=80):
    earlier, gone = [], {}
    for i, t in sorted(rows):
        for k, line in enumerate((t or "").split("\n")):
            s = words(line)
            if s and any(100 * len(s & e) >= percent * len(s | e) for e in earlier):
                gone.setdefault(i, set()).add(k)
            if s:
                earlier.append(s)
    return {(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())), 0 if t is None else t.count("\n") + 1, len(gone.get(i, ()))) for i, t in rows}


def run(spark, rows, **kw):
    out = line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), **kw)
    return {tuple(r) for r in out.select("doc_id", "text", "n_lines", "n_removed").collect()}


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(3000)]
    pool = [rng.choices(vocab, k=rng.randint(0, 40)) for _ in range(120)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 8)):
            line = list(rng.choice(pool))
            for _ in range(rng.randint(0, 4)):
                if line:
                    line[rng.randrange(len(line))] = rng.choice(vocab)
            lines.append(" ".join(line).upper() if rng.random() < 0.1 else " ".join(line))
        rows.append((i, "\n".join(lines)))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, small=2, heads=1, each=1) == brute(rows)


def test_family_of_variants(spark):
    rng = random.Random(8)
    base = [f"a{i}" for i in range(30)]
    rows = [(i, " ".join(rng.sample(base, 30 - i % 6) + [f"z{i}"] * (i % 4))) for i in range(120)]
    rows += [(i, " ".join(rng.sample(base, 15) + [f"y{rng.randrange(9)}"])) for i in range(120, 200)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, small=8, heads=1, each=0) == brute(rows)
    assert run(spark, rows, small=500, heads=2, each=1) == brute(rows)


def test_nulls_blanks_repeats_and_order(spark):
    rows = [(5, "a b c\n\n \nx"), (2, "c b a\n"), (9, None), (3, ""), (-1, "x")]
    assert run(spark, rows) == {(5, "\n ", 4, 2), (2, "c b a\n", 2, 0), (9, None, 0, 0), (3, "", 1, 0), (-1, "x", 1, 0)}
    assert run(spark, [(1, "a\nb"), (1, "a\nb")]) == {(1, "a\nb", 2, 0)}
    assert run(spark, [(None, "a"), (1, "a")]) == {(None, "a", 1, 0), (1, "a", 1, 0)}
    assert run(spark, []) == set()


def test_small_filters_change_nothing(spark):
    rows = [(i, f"only {i} here now\nthe same line again") for i in range(20)]
    assert run(spark, rows, bits=8) == run(spark, rows)


def test_other_columns_pass_and_long_texts(spark):
    df = spark.createDataFrame([(1, "k " * 200_000 + "\nq", 3, "x"), (2, "k\nr", 4, "y")], "doc_id bigint, text string, line int, n_lines string")
    got = {r.doc_id: (r.line, r.n_lines, r.n_removed) for r in line_dedup(df).collect()}
    assert got == {1: (3, 2, 0), 2: (4, 2, 1)}


def test_a_part_that_overflows(spark, monkeypatch):
    from weftline.llm import line_dedup as module

    rng = random.Random(3)
    posts = [(i, " ".join(rng.sample([f"a{k}" for k in range(12)], 9) + [f"u{i}"] * (i % 2))) for i in range(90)]
    p = module._Part(80, 8, 2, 2)
    p.limit = 50
    counts = module.np.zeros(module.COUNTERS, module.np.int64)
    w, n = module.ordered_sets([t.encode() for _, t in posts], counts)
    size = module.prefix_size(n, 80)
    start = module.np.cumsum(n) - n
    got, all_ = [], []
    for k in range(0, 90, 10):
        some = module.np.arange(k, k + 10)
        a = module.np.zeros(int(size[some].sum()), module.POST)
        of = module.np.repeat(some, size[some])
        a["word"] = w[module._ranges(start[some], size[some])] >> module.np.uint64(32)
        a["place"], a["n"], a["doc"] = module._ranges(module.np.zeros(10, int), size[some]), n[of], of
        a["parity"], a["half"] = (x[of] for x in module._parities(w, n))
        all_.append(a)
        got += list(p.add(a))
    got += list(p.end())
    a = module.np.concatenate(all_)
    left = {}
    for b in got:
        if b.column(0)[0].as_py() == module.LEFT:
            left[b.column(6)[0].as_py()] = left.get(b.column(6)[0].as_py(), 0) + len(module.unpacked(b.column(7)[0].as_py(), module.POST))
    large = {int(x): int((a["word"] == x).sum()) for x in module.np.unique(a["word"]) if (a["word"] == x).sum() > 8}
    assert large and {k: v for k, v in left.items() if k in large} == large


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b\nc", "d", 1, True, 5, "z"), (2, "b a\nq", "e", 2, False, 6, "y")], "doc_id bigint, text string, doc string, bm int, `__gone` boolean, `__touched` int, `a.b` string")
    out = line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b\nc", "d", 1, True, 5, "z", 2, 0), (2, "q", "e", 2, False, 6, "y", 2, 1)]


def test_words_that_polynomial_hashes_confuse(spark):
    t = "a"
    while len(t) < 1024:
        t += t.translate({97: 98, 98: 97})
    other = t.translate({97: 98, 98: 97})
    assert run(spark, [(1, t), (2, other)]) == {(1, t, 1, 0), (2, other, 1, 0)}


def test_long_lines(spark):
    rng = random.Random(6)
    vocab, rows = [f"v{i}" for i in range(3000)], []
    for k in range(12):
        base = rng.sample(vocab, rng.randint(60, 400))
        for _ in range(4):
            line = [w for w in base if rng.random() > 0.08] + [rng.choice(vocab) for _ in range(rng.randint(0, 20))]
            rows.append((len(rows), " ".join(line)))
    assert run(spark, rows) == brute(rows)
