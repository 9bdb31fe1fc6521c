from weftline.llm.exact_dedup import exact_dedup


def run(spark, rows, schema="doc_id bigint, text string", **kw):
    out = exact_dedup(spark.createDataFrame(rows, schema), **kw)
    return {tuple(r) for r in out.collect()}


def test_longest_original_stays_then_smallest_id(spark):
    got = run(spark, [(1, "a b"), (2, "a  b"), (3, "ab"), (4, "x"), (5, "\t a\nb"), (6, "ab c")])
    assert got == {(1, 5, 4, False), (2, 5, 4, False), (3, 5, 4, False), (5, 5, 4, True), (4, 4, 1, True), (6, 6, 1, True)}


def test_nulls_blanks_and_repeats(spark):
    got = run(spark, [(1, None), (2, ""), (3, " \n"), (7, "q"), (7, "q"), (None, "z"), (8, "z")])
    assert got == {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (7, 7, 2, True), (None, 8, 2, False), (8, 8, 2, True)}


def test_same_length_and_prefix_but_other_text(spark):
    a = "x" * 100
    got = run(spark, [(1, a + "1"), (2, a + "2"), (3, a + "1")])
    assert got == {(1, 1, 2, True), (3, 1, 2, False), (2, 2, 1, True)}


def test_saturated_filter_and_clashing_names(spark):
    rows = [(1, "a", 1, "k"), (2, "a", 2, "l"), (3, "b", 3, "m")]
    got = run(spark, rows, "doc_id bigint, text string, group_size int, keep_id string", bits=8)
    assert got == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True)}


def test_empty_and_very_long(spark):
    assert run(spark, []) == set()
    long = "ab " * 300_000
    assert run(spark, [(1, long), (2, long + " ")]) == {(1, 2, 2, False), (2, 2, 2, True)}
