"""Map, Filter, FlatMap and the keyed operators over one VARIANT column ``rec``.

A VARIANT can be neither grouped nor compared, so keys are extracted as text first. Nested
leaves are rewritten to the depth that the records have, which one pass over them finds. A
stream cannot be read beforehand: there it is ``DEPTH``, and a deeper record is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.dsl import parse_flat, parse_map, parse_predicate, parse_reducer
from weftline.operators.record_wise import NUMBER_TEXT, WHOLE_TEXT, WORD_BREAK

DEPTH = 4


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def _is_number(v: Column) -> Column:
    return _kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")


def _fields(v: Column) -> Column:
    """A record's fields; null for a record that is no object."""
    return F.when(_is_object(v), v.cast("map<string,variant>"))


def _leaf(v: Column, fn: str) -> Column:
    text = F.try_variant_get(v, "$", "string")
    if fn in ("uppercase", "lowercase"):
        changed = (F.upper if fn == "uppercase" else F.lower)(text)
        return F.when(_kind(v) == "STRING", changed.cast("variant")).otherwise(v)
    whole = F.when(text.rlike(WHOLE_TEXT), text.try_cast("bigint")) * 2
    real = F.when(text.rlike(NUMBER_TEXT), text.try_cast("double")) * 2
    made = F.coalesce(whole.cast("variant"), real.cast("variant"), v)
    return F.when((_kind(v) == "STRING") | _is_number(v), made).otherwise(v)


def _is_array(v: Column) -> Column:
    return _kind(v).startswith("ARRAY")


def _deep(v: Column, fn: str, depth: int) -> Column:
    """``v`` with its leaves rewritten; the expression grows in proportion to ``depth``."""
    inner = _is_object(v) | _is_array(v)
    if depth == 0:
        return F.when(inner, F.raise_error(F.lit("Map: a record is nested too deeply")).cast("variant")).otherwise(_leaf(v, fn))
    items = F.transform(F.when(_is_array(v), v.cast("array<variant>")), lambda x: F.struct(F.lit("").alias("key"), x.alias("value")))
    done = F.transform(F.coalesce(F.map_entries(_fields(v)), items), lambda e: F.struct(e["key"].alias("key"), _deep(e["value"], fn, depth - 1).alias("value")))

    def built(d: Column) -> Column:
        return F.when(_is_object(v), F.to_variant_object(F.map_from_entries(d))).otherwise(F.to_variant_object(F.transform(d, lambda e: e["value"])))

    # an array of one binds what is done to a name, so that it stands in the expression once
    return F.when(inner, F.get(F.transform(F.array(done), built), F.lit(0))).otherwise(_leaf(v, fn))


def _depth(df: DataFrame) -> int:
    """Levels of objects and arrays in the deepest record."""
    text = F.regexp_replace(F.to_json("rec"), r"\\.", "")
    brackets = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), r"[^\[\]{}]", "")

    def step(a: Column, c: Column) -> Column:
        at = a["at"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(at.alias("at"), F.greatest(a["top"], at).alias("top"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))
    return df.agg(F.max(F.aggregate(F.split(brackets, ""), start, step, lambda a: a["top"]))).first()[0] or 0


def map_records(df: DataFrame, script: str, depth: int | None = None) -> DataFrame:
    fn = parse_map(script)
    if fn == "identity":
        return df
    if depth is None:
        depth = DEPTH if df.isStreaming else _depth(df)
    return df.select(_deep(F.col("rec"), fn, depth).alias("rec"))


def _field(name: str) -> Column:
    return F.element_at(_fields(F.col("rec")), F.lit(name))


def filter_records(df: DataFrame, predicate: str) -> DataFrame:
    p = parse_predicate(predicate)
    rec, m = F.col("rec"), _fields(F.col("rec"))
    if p.kind in ("always_true", "always_false"):
        return df.where(F.lit(p.kind == "always_true"))
    if p.kind == "non_empty":
        return df.where(_is_object(rec) & (F.size(m) > 0) & (F.size(F.map_filter(m, lambda _, x: F.is_variant_null(x))) == 0))
    if p.kind == "has_field":
        return df.where(F.coalesce(F.map_contains_key(m, p.field), F.lit(False)))
    v = F.try_element_at(m, F.lit(p.field))
    if p.kind == "equals":
        return df.where((_kind(v) == "STRING") & (F.lower(F.try_variant_get(v, "$", "string")) == p.text.lower()))
    n = F.when(_is_number(v), F.try_variant_get(v, "$", "double"))
    return df.where(n > p.number if p.kind == "gt" else n < p.number)


def flat_map(df: DataFrame, func: str) -> DataFrame:
    f = parse_flat(func)
    if f.kind == "identity":
        return df
    rec, m = F.col("rec"), _fields(F.col("rec"))
    if f.kind == "json_expand":
        rows = F.transform(F.map_entries(m), lambda e: F.to_variant_object(F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
        return df.select(F.explode(F.when(F.size(m) > 0, rows).otherwise(F.array(rec))).alias("rec"))
    v = F.try_element_at(m, F.lit(f.field))

    def put(x: Column) -> Column:
        rest = F.map_filter(m, lambda k, _: k != f.field)
        return F.to_variant_object(F.map_concat(rest, F.map_from_arrays(F.array(F.lit(f.field)), F.array(x))))

    if f.kind == "split":
        words = F.filter(F.split(F.try_variant_get(v, "$", "string"), WORD_BREAK), lambda t: t != "")
        many = F.when((_kind(v) == "STRING") & (F.size(words) > 0), F.transform(words, lambda t: put(t.cast("variant"))))
    else:
        many = F.when(_kind(v).startswith("ARRAY"), F.transform(v.cast("array<variant>"), put))
    return df.select(F.explode(F.coalesce(many, F.array(rec))).alias("rec"))


def _aggregate(reducer: str) -> Column:
    r = parse_reducer(reducer)
    if r.kind == "count":
        return F.count(F.lit(1)).alias(r.output)
    if r.kind == "collect":
        # all records of a group in one row, as collect asks; count or sum have no such bound
        return F.collect_list("rec").alias(r.output)
    v = F.col("rec") if r.field is None else F.try_element_at(_fields(F.col("rec")), F.lit(r.field))
    n = F.when(_is_number(v), F.try_variant_get(v, "$", "double"))
    got = {"sum": F.sum, "min": F.min, "max": F.max}[r.kind](n)
    return F.coalesce(F.when(F.abs(got) < float("inf"), got), F.lit(0.0)).alias(r.output)


def reduce_records(df: DataFrame, reducer: str) -> DataFrame:
    return df.agg(_aggregate(reducer))


def _key_text(key: str) -> tuple[Column, Column]:
    """A field, and its text if it is a string, a number or a boolean, else null."""
    v = F.try_element_at(_fields(F.col("rec")), F.lit(key))
    return v, F.when((_kind(v) == "STRING") | (_kind(v) == "BOOLEAN") | _is_number(v), F.try_variant_get(v, "$", "string"))


def reduce_by_key(df: DataFrame, key: str, reducer: str, strict: bool = False) -> DataFrame:
    """The key, as text, and the aggregate; records without such a key are one group of null.

    ``strict`` makes a key that is absent or no string an error of the job.
    """
    v, k = _key_text(key)
    if strict:
        k = F.when(_kind(v) == "STRING", k).otherwise(F.raise_error(F.lit(f"missing key field '{key}'")).cast("string"))
    out = df.groupBy(k.alias("__key")).agg(_aggregate(reducer))
    name = parse_reducer(reducer).output
    return out.drop("__key") if name == key else out.withColumnRenamed("__key", key)


def shuffle_by_key(df: DataFrame, key: str, total_partitions: int) -> DataFrame:
    """The same records, those of one key in one partition; those without one are together."""
    return df.repartition(max(int(total_partitions), 1), _key_text(key)[1])


def join_records(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Join on the text of a scalar key; unmatched rows carry the other side's marker."""

    def side(df: DataFrame, name: str) -> DataFrame:
        v = F.try_element_at(_fields(F.col("rec")), F.lit(key))
        good = (_kind(v) == "STRING") | _is_number(v)
        k = F.when(good, F.try_variant_get(v, "$", "string")).otherwise(F.raise_error(F.lit(f"invalid join key '{key}'")).cast("string"))
        fields = F.transform_keys(_fields(F.col("rec")), lambda n, _: F.concat(F.lit(f"{name}_"), n))
        return df.select(k.alias(f"{name}_k"), fields.alias(f"{name}_m"))

    a, b = side(left, "left"), side(right, "right")

    def marker(name: str) -> Column:
        return F.map_from_arrays(F.array(F.lit(f"{name}_missing")), F.array(F.parse_json(F.lit("null"))))

    both = F.map_concat(F.coalesce("left_m", marker("left")), F.coalesce("right_m", marker("right")))
    return a.join(b, a["left_k"] == b["right_k"], how).select(F.to_variant_object(both).alias("rec"))
