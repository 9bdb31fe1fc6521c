import pytest
from pyspark.sql import functions as F

from weftline.operators import keyed, record_wise

R = record_wise


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_map_reaches_nested_leaves(spark):
    df = spark.sql("SELECT 'a' AS s, array('b', null) AS a, named_struct('x', 'c', 'n', 2) AS t, true AS b, map('k', 'v') AS m, cast(null AS string) AS z")
    got = R.map_records(df, "uppercase").first()
    assert (got.s, got.a, got.t.x, got.t.n, got.b, got.m, got.z) == ("A", ["B", None], "C", 2, True, {"k": "V"}, None)
    assert R.map_records(df, "identity") is df


def test_double_of_text_and_numbers(spark):
    df = spark.createDataFrame([("7",), ("+5",), ("1.5",), ("x",), ("inf",), ("5d",), (None,)], "s string")
    assert [r[0] for r in R.map_records(df, "double").collect()] == ["14", "10", "3.0", "x", "inf", "5d", None]
    n = R.map_records(spark.sql("SELECT cast(2000000000 AS int) AS i, cast(1.5 AS float) AS f"), "double")
    assert n.dtypes == [("i", "bigint"), ("f", "double")] and n.first()[0] == 4000000000


@pytest.mark.parametrize(("predicate", "n"), [("always_true", 4), ("always_false", 0), ("non_empty", 3), ("has_field:s", 4), ("has_field:q", 0), ("equals:s=ABC", 2), ("equals:i=1", 0), ("gt:i=1.5", 3), ("lt:i=2.5", 2), ("gt:i=-1e30", 4), ("lt:i=-1e30", 0), ("gt:d=0", 2), ("gt:s=0", 0), ("gt:q=0", 0)])
def test_filters(spark, predicate, n):
    df = spark.createDataFrame([(1, "abc", 1.0), (2, "ABC", float("nan")), (3, None, 2.0), (4, "x", -1.0)], "i bigint, s string, d double")
    assert R.filter_records(df, predicate).count() == n


def test_coerced_equality(spark):
    assert R.filter_records(spark.range(5).toDF("i"), "equals:i=3", coerce=True).count() == 1


def test_filter_on_whole_numbers_reaches_the_scan(spark, tmp_path):
    spark.range(10).toDF("i").write.parquet(str(tmp_path / "t"))
    df = R.filter_records(spark.read.parquet(str(tmp_path / "t")), "gt:i=5.5")
    assert "GreaterThan(i,5)" in df._jdf.queryExecution().executedPlan().toString() and df.count() == 4


def test_flat_map(spark):
    df = spark.createDataFrame([(1, "a,b c"), (2, " , "), (3, None), (4, "x y")], "i int, s string")
    assert rows(R.flat_map(df, "split:s")) == [(1, "a"), (1, "b"), (1, "c"), (2, " , "), (3, None), (4, "x"), (4, "y")]
    assert R.flat_map(df, "split:i") is df and R.flat_map(df, "split:q") is df and R.flat_map(df, "identity") is df
    arr = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None)], "i int, v array<int>")
    assert rows(R.flat_map(arr, "explode_array:v")) == [(1, 1), (1, 2), (3, None)]
    assert R.flat_map(arr, "explode_array:i") is arr
    assert rows(R.flat_map(spark.sql("SELECT 2 AS b, 'x' AS a"), "json_expand")) == [("a", "x"), ("b", "2")]


def test_reducers(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), (None, None)], "k string, v double")
    assert rows(keyed.reduce_by_key(df, "k", "sum:v")) == [("a", 3.0), ("b", 3.0), (None, 0.0)]
    assert rows(keyed.reduce_records(df, "count")) == [(4,)] and rows(keyed.reduce_records(df, "max:k")) == [(0.0,)]
    assert rows(keyed.reduce_records(df.where("false"), "min:v")) == [(0.0,)] and rows(keyed.reduce_by_key(df.where("false"), "k", "count")) == []
    assert rows(keyed.reduce_records(df, "sum")) == [(0.0,)]
    assert keyed.reduce_by_key(df.toDF("count", "v"), "count", "count").columns == ["count"]
    inf = spark.createDataFrame([(float("inf"),), (float("nan"),)], "v double")
    assert rows(keyed.reduce_records(inf, "sum:v")) == [(0.0,)]
    got = keyed.reduce_by_key(df, "k", "collect").where("k = 'a'").first()
    assert sorted(r.v for r in got["collect"]) == [1.0, 2.0]


def test_keys(spark):
    df = spark.createDataFrame([(1,)], "v int")
    with pytest.raises(ValueError, match="missing key"):
        keyed.reduce_by_key(df, "k", "sum:v")
    with pytest.raises(Exception, match="missing key"):
        keyed.reduce_by_key(df, "v", "count", strict=True).collect()
    assert rows(keyed.reduce_by_key(df, "v", "count")) == [(1, 1)]


def side(spark, *keys, kind="string", name="l"):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"k {kind}, {name} int")


def test_joins(spark):
    one = side(spark, "a")
    assert rows(keyed.join_records(one, side(spark, "a", name="r"), "k", "k", "inner")) == [("a", 0, "a", 0)]
    other = side(spark, "b", name="r")
    assert rows(keyed.join_records(one, other, "k", "k", "inner")) == []
    assert rows(keyed.join_records(one, other, "k", "k", "left")) == [("a", 0, None, None)]
    assert rows(keyed.join_records(one, other, "k", "k", "right")) == [(None, None, "b", 0)]
    assert len(rows(keyed.join_records(one, other, "k", "k", "full"))) == 2
    assert keyed.join_records(side(spark, "a", "a"), side(spark, "a", "a", name="r"), "k", "k", "inner").count() == 4
    assert keyed.join_records(side(spark, "1"), side(spark, 1, kind="bigint", name="r"), "k", "k", "inner").count() == 1
    assert keyed.join_records(side(spark, "1"), side(spark, 1.0, kind="double", name="r"), "k", "k", "inner").count() == 0
    assert keyed.join_records(side(spark, None), side(spark, None, name="r"), "k", "k", "full").count() == 2
    with pytest.raises(Exception, match="invalid join key"):
        keyed.join_records(side(spark, None), other, "k", "k", "left", strict=True).collect()
    with pytest.raises(ValueError):
        keyed.join_records(one.select(F.array("k").alias("k")), other, "k", "k", "inner")


def test_shuffle_keeps_records_and_groups_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    out = keyed.shuffle_by_key(df, "k", 2)
    assert rows(out) == rows(df) and out.rdd.getNumPartitions() == 2
    assert out.withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.countDistinct("p").alias("n")).where("n > 1").count() == 0
    assert keyed.shuffle_by_key(df, "q", 0).count() == 4


def test_union_fills_missing_fields(spark):
    out = keyed.union_all([spark.sql("SELECT 1 AS a"), spark.sql("SELECT 2 AS b")])
    assert rows(out) == [(1, None), (None, 2)]
