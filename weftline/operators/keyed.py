"""Reduce, ReduceByKey, Join, ShuffleByKey and the union of several parents."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.dsl import Reducer, parse_reducer
from weftline.operators.record_wise import NUMERIC, col

#: The column that holds a record's slice where partition-local results are asked for.
SLICE = "_pid"


def reducer_column(df: DataFrame, r: Reducer) -> Column:
    """The aggregate of a reducer: 0.0, not null, where no number was met.

    ``collect`` gathers a whole group in one row of one task, which is what it is for.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if r.kind == "count":
        return F.count(F.lit(1)).alias(r.output)
    if r.kind == "collect":
        return F.collect_list(F.struct(*[col(n) for n in df.columns if n != SLICE])).alias(r.output)
    if r.field is None or not isinstance(kinds.get(r.field), NUMERIC):
        # count() makes it an aggregate, so that one row results
        return (F.count(F.lit(1)) * F.lit(0.0)).alias(r.output)
    c = col(r.field).cast("double")
    got = {"sum": F.sum, "min": F.min, "max": F.max}[r.kind](F.when(~F.isnan(c), c))
    finite = F.when(F.abs(got) < F.lit(float("inf")), got)
    return F.coalesce(finite, F.lit(0.0)).alias(r.output)


def reduce_records(df: DataFrame, reducer: str) -> DataFrame:
    """Reduce and Aggregate: one record; with slices, one for each slice."""
    agg = reducer_column(df, parse_reducer(reducer))
    if SLICE in df.columns:
        return df.groupBy(SLICE).agg(agg)
    return df.agg(agg)


def reduce_by_key(df: DataFrame, key: str, reducer: str, strict: bool = False) -> DataFrame:
    """ReduceByKey: the key and the aggregate; if they have one name, the aggregate stays.

    ``strict`` makes a missing or non-string key an error of the job; otherwise any atomic
    key groups, null among them.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if key not in kinds:
        raise ValueError(f"missing key field '{key}'")
    r = parse_reducer(reducer)
    agg = reducer_column(df, r)
    k = col(key)
    if strict:
        good = k.isNotNull() if isinstance(kinds[key], T.StringType) else F.lit(False)
        k = F.when(good, k).otherwise(F.raise_error(F.lit(f"missing key field '{key}'")).cast(kinds[key]))
    keys = [col(SLICE)] * (SLICE in kinds) + [k.alias(key)]
    out = df.groupBy(*keys).agg(agg.alias("__agg") if r.output == key else agg)
    return out.drop(key).withColumnRenamed("__agg", key) if r.output == key else out


def _same_kind(a: T.DataType, b: T.DataType) -> bool:
    return a == b or isinstance(a, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) and isinstance(b, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def join_records(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, strict: bool = False) -> DataFrame:
    """Join on one key; every output field carries the prefix of its side.

    Keys of one kind are compared as they are, so that bucketing, broadcasts and skew
    splitting work; otherwise by their text, so that "1" meets 1. Null keys meet nothing
    (an error with ``strict``). Sides with slices meet within a slice only.
    """
    lk = {f.name: f.dataType for f in left.schema.fields}
    rk = {f.name: f.dataType for f in right.schema.fields}
    for kinds, key in ((lk, left_key), (rk, right_key)):
        if key not in kinds:
            raise ValueError(f"missing join key '{key}'")
        if not isinstance(kinds[key], (T.StringType, *NUMERIC)):
            raise ValueError(f"join key '{key}' is neither text nor number")
    sliced = SLICE in lk and SLICE in rk
    a = left.select(*[col(n).alias(SLICE if n == SLICE else f"left_{n}") for n in lk])
    b = right.select(*[col(n).alias("__right_pid" if n == SLICE else f"right_{n}") for n in rk])
    x, y = a[f"`left_{left_key}`"], b[f"`right_{right_key}`"]
    if strict:
        x = F.when(x.isNotNull(), x).otherwise(F.raise_error(F.lit(f"invalid join key '{left_key}'")).cast(lk[left_key]))
        y = F.when(y.isNotNull(), y).otherwise(F.raise_error(F.lit(f"invalid join key '{right_key}'")).cast(rk[right_key]))
    on = x == y if _same_kind(lk[left_key], rk[right_key]) else x.cast("string") == y.cast("string")
    if sliced:
        on = on & (a[SLICE] == b["__right_pid"])
    out = a.join(b, on, how)
    if sliced:
        out = out.withColumn(SLICE, F.coalesce(F.col(SLICE), F.col("__right_pid")))
    return out.drop("__right_pid") if SLICE in rk else out


def shuffle_by_key(df: DataFrame, key: str, total_partitions: int) -> DataFrame:
    """ShuffleByKey: the same records, those of one key in one partition."""
    n = max(int(total_partitions), 1)
    return df.repartition(n, col(key)) if key in df.columns else df.repartition(n, F.lit(0))


def union_all(parents: list[DataFrame]) -> DataFrame:
    """Several parents of a node are concatenated; fields that one lacks are null."""
    return fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), parents)
