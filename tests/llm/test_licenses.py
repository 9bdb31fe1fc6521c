import math
import re
from collections import Counter

from weftline.llm.licenses import BREAK, HEADS, SPDX, TEMPLATES, THRESHOLD, license_scan, op7_license_scan

FILE = re.compile(r"(^|/)(un)?(licen[sc]e|copying|notice)(\.[a-z0-9]+)?$", re.I)


def toks(t):
    return [x for x in re.split(BREAK, (t or "").lower()) if x]


def units(p, t):
    """Terms of lines, paragraphs of several lines, heads, and whole licence files."""
    if t is None:
        return
    yield from map(toks, t.split("\n"))
    if "\n" in t:
        part = []
        for k, line in enumerate([*t.split("\n"), ""]):
            if re.search("[A-Za-z0-9]", line) or (not part and k == 0):
                part.append(line)
            else:
                yield toks(" ".join(part))
                part = []
        yield from (toks(t)[:n] for n in HEADS)
    if FILE.search(p):
        yield toks(t)


def brute(rows):
    files = [(p, t) for p, t in rows if p is not None]
    vocab = {t for _, x in TEMPLATES for t in toks(x)}
    n, df = len(files), Counter(t for _, x in files for t in set(toks(x)) & vocab)

    def vec(ts):
        return {t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in Counter(ts).items()}

    temps = [vec(toks(x)) for _, x in TEMPLATES]
    own = {}
    for p, t in files:
        tag = re.search(SPDX, t or "")
        if tag:
            own[p] = (1.0, 1, tag[1])
        for u in units(p, t):
            v = vec(u)
            for i, w in enumerate(temps):
                dot = sum(x * w.get(k, 0) for k, x in v.items())
                s = round(dot / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values())), 9) if dot else 0
                if s >= THRESHOLD:
                    own[p] = max(own.get(p, (0, 0, "")), (s, -i, TEMPLATES[i][0]))
    dirs = {}
    for p in sorted(own):
        if FILE.search(p):
            d = p.rpartition("/")[0]
            if d not in dirs or own[p][0] > dirs[d][0]:
                dirs[d] = (own[p][0], own[p][2], p)
    out = set()
    for p, _ in rows:
        if p in own:
            out.add((p, own[p][2], own[p][0], "own", p))
            continue
        d, hit = p and p.rpartition("/")[0], None
        while p is not None and hit is None:
            hit = dirs.get(d)
            if not d:
                break
            d = d.rpartition("/")[0]
        out.add((p, hit and hit[1], None, hit and "inherited", hit and hit[2]))
    return out


ROWS = [
    ("a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ("a/x.c", "int main"),
    ("a/b/c/y.c", None),
    ("a/b/NOTICE.txt", "Words before.\nreleased under the MIT license\nand after"),
    ("a/b/z.c", "some code\nAll rights reserved.\nmore code"),
    ("a/b2/LICENSE", "nothing here that helps"),
    ("d/e.c", ""),
    ("COPYING", "This work is licensed under the GNU General Public License, version 3."),
    ("top.c", "the and of under a license maybe, or not, who can say"),
    ("f/LICENSE", "Licensed under CC BY 4.0."),
    ("f/LICENCE.md", "Licensed under CC BY 4.0."),
    ("f/g/h", "we said this file is licensed under the MIT terms of another license"),
    (None, "Released under the MIT License."),
    ("g/h.c", "/*\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n *\n * code follows\n */\nint x"),
    ("g/i.c", "// SPDX-License-Identifier: EPL-2.0\nint y"),
    ("g/i.c", "another text of that path"),
]


def run(spark, rows, schema="path string, text string"):
    return {tuple(None if x is None else round(x, 8) if isinstance(x, float) else x for x in r) for r in license_scan(spark.createDataFrame(rows, schema)).collect()}


def rounded(rows):
    return {tuple(round(x, 8) if isinstance(x, float) else x for x in r) for r in rows}


def test_equals_brute_force(spark):
    assert run(spark, ROWS) == rounded(brute(ROWS))


def test_without_a_licence_at_the_root(spark):
    rows = [r for r in ROWS if r[0] != "COPYING"]
    got = run(spark, rows)
    assert got == rounded(brute(rows)) and ("d/e.c", None, None, None, None) in got


def test_repeats_empty_and_clashing_names(spark):
    assert run(spark, []) == set()
    rows = [("q/LICENSE", "Released under the ISC License.", 1.0), ("q/LICENSE", None, 2.0), ("q/r", "x", None)]
    out = license_scan(spark.createDataFrame(rows, "path string, text string, score double"))
    assert sorted(r.license for r in out.collect()) == ["ISC"] * 3


def wrapped(t, mark=""):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(t, 70))


def test_licence_files_and_headers(spark):
    from weftline.llm.license_texts import HEADERS, NOTICES, OPENINGS, TEXTS

    code = "\n\nint main(int argc, char **argv) {\n  return argc;\n}\n" * 3
    rows = [(f"t{i}/LICENSE", "Copyright (c) 2021, Some Body\nAll rights reserved.\n\n" + wrapped(t), k) for i, (k, t) in enumerate(TEXTS)]
    rows += [(f"u{i}/x.c", "/* Copyright (c) 2021 Some Body\n *\n" + wrapped(t, " * ") + "\n */\n" + code, k) for i, (k, t) in enumerate(TEXTS + HEADERS)]
    rows += [(f"o{i}/COPYING", wrapped(t) + "\n\n" + "more words of a long licence " * 900, k) for i, (k, t) in enumerate(OPENINGS)]
    rows += [(f"n{i}/x", "before\n" + t + "\nafter", k) for i, (k, t) in enumerate(NOTICES)]
    rows += [(f"s{i}/x", f"# SPDX-License-Identifier: {k}\n" + code, k) for i, k in enumerate(("MIT", "GPL-2.0-only"))]
    rows += [("z/LICENSE", "Copyright (c) 2024 Acme Corp. All rights reserved.", None), ("z/x", "All rights reserved.", None)]
    rows += [(f"f{i}/y.txt", "the program and a file of the user\n" * 4, None) for i in range(300)]
    got = {r.path: r.license for r in license_scan(spark.createDataFrame(rows, "path string, text string, want string")).collect()}
    assert {p: (got[p], k) for p, _, k in rows if got[p] != k} == {}


def test_texts_as_they_are_shipped(spark):
    import pathlib

    folder = pathlib.Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(f"{n}/LICENSE", (folder / n).read_text(), k) for n, k in names.items() if (folder / n).exists()]
    if rows:
        got = {r.path: r.license for r in license_scan(spark.createDataFrame(rows, "path string, text string, want string")).collect()}
        assert got == {p: k for p, _, k in rows}


def test_very_long_texts(spark):
    rows = [("a/x", "word " * 300_000 + "\nReleased under the MIT License.\n"), ("a/y", "z" * 2_000_000)]
    assert {r.path: r.license for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()} == {"a/x": "MIT", "a/y": None}


def test_query_equals_brute_force(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    got = op7_license_scan(spark, d).collect()
    rows = []
    for i, s, t in duckdb.sql(f"SELECT doc_id, source, text FROM '{d}/documents.parquet'").fetchall():
        rows.append((f"{s}/f{i // 1000}/" + (f"LICENSE.{i}" if i % 10 == 0 else f"d{i // 200}/{i}.txt"), t))
    assert rounded({(r.path, r.license, r.score, r.basis, r.from_path) for r in got}) == rounded(brute(rows))
    assert len(got) == len(rows) and len({r.doc_id for r in got}) == len(rows)


def test_a_notice_stays_found_among_filler_files(spark):
    notice = "Copyright 2020 The Authors. Licensed under the Apache License, Version 2.0."
    some = ["copyright of 2020", "licensed under a version of 2", "authors of the apache", "license 0"]
    scores = []
    for n in (50, 5000):
        rows = [("a/x.c", notice)] + [(f"f{i}/y", some[i % 4]) for i in range(n)]
        got = {r.path: r for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
        assert got["a/x.c"].license == "Apache-2.0" and got["a/x.c"].basis == "own"
        scores.append(got["a/x.c"].score)
    # every term is as common among 5000 files as among 50
    assert abs(scores[0] - scores[1]) < 0.02


def test_long_units_around_a_notice_are_not_scored(spark, monkeypatch):
    from weftline.llm import licenses

    scored, cut = [], licenses.cut

    def seen(df):
        out = cut(df)
        if set(df.columns) == {"path", "unit", "term", "tf"}:
            scored.extend(out.select("path", "term", "tf").collect())
        return out

    monkeypatch.setattr(licenses, "cut", seen)
    notice = "Released under the MIT License."
    # without and with blank lines, on lines of its own and within a long one
    texts = [[f"w{k}x{j}" for j in range(300)] for k in range(12)]
    rows = [(f"a{k}/x", "\n".join(w[:150]) + f"\n{notice}\n" + "\n\n".join(w[150:])) for k, w in enumerate(texts)]
    rows += [(f"b{k}/LICENSE", " ".join(w) + " " + notice) for k, w in enumerate(texts)]
    assert run(spark, rows) == rounded(brute(rows))
    assert sorted((r.path, r.term, r.tf) for r in scored) == sorted((f"a{k}/x", t, 1) for k in range(12) for t in toks(notice))


def test_bounds_with_few_exact_weights_and_full_filters(spark, monkeypatch):
    from weftline.llm import licenses

    rows = [*ROWS, ("h/i.c", "the the the license of of of the file MIT MIT\nReleased under the MIT License.\n" + "a b c d the " * 50)]
    rows += [(f"k{i}/y", "the program and a file of the user\n" * i + "Released under the MIT License. " + "the file " * i + "other words " * i) for i in range(6)]
    monkeypatch.setattr(licenses, "BITS", 8)
    for most in (0, 3):
        monkeypatch.setattr(licenses, "COMMON", most)
        assert run(spark, rows) == rounded(brute(rows))


def test_tallies_in_a_row(spark):
    from pyspark.sql import functions as F

    from weftline.llm.licenses import _tallies

    words = ["b", "a", "c", "a", "", "c", "c"]
    df = spark.createDataFrame([(words,), (["x"],), (["y", "y"],)], "terms array<string>")
    got = [Counter({x.term: x.tf for x in r.t}) for r in df.select(_tallies(F.col("terms")).alias("t")).collect()]
    assert got == [Counter(words), Counter("x"), Counter("yy")]


def test_long_units_of_common_words_are_not_scored(spark, monkeypatch):
    from weftline.llm import licenses

    scored, cut = [], licenses.cut

    def seen(df):
        out = cut(df)
        if set(df.columns) == {"path", "unit", "term", "tf"}:
            scored.extend(out.select("path", "term", "tf").collect())
        return out

    monkeypatch.setattr(licenses, "cut", seen)
    # nearly all of the long line's length is in two words that templates have too
    notice = "Released under the MIT License."
    rows = [(f"c{k}/x", "the of " * 500 + f"w{k} " + notice + "\n" + notice) for k in range(4)] + [(f"d{k}/y", "the of") for k in range(20)]
    assert run(spark, rows) == rounded(brute(rows))
    assert sorted((r.path, r.term, r.tf) for r in scored) == sorted((f"c{k}/x", t, 1) for k in range(4) for t in toks(notice))
