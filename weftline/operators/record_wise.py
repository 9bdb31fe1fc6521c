"""Map, Filter and FlatMap over typed columns: one projection each, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.dsl import FlatFunction, Predicate, integral_bound, parse_flat, parse_map, parse_predicate

#: Text that counts as a number where a string leaf is doubled; Spark's own casts also take
#: "5d", "inf" and "NaN", which stay text here.
WHOLE_TEXT = r"^[+-]?[0-9]+$"
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

#: Unicode white space and commas separate words.
WORD_BREAK = r"(?U)[\s,]+"
# The same characters one by one.
BREAKS = ", \t\n\x0b\x0c\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*INTEGRAL, T.FloatType, T.DoubleType, T.DecimalType)


def col(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _doubled_text(c: Column) -> Column:
    whole = F.when(c.rlike(WHOLE_TEXT), c.try_cast("bigint"))
    real = F.when(c.rlike(NUMBER_TEXT), c.try_cast("double"))
    return F.coalesce((whole * 2).cast("string"), (real * 2).cast("string"), c)


def map_leaf(c: Column, kind: T.DataType, fn: str) -> Column:
    """Apply a map function to every leaf below ``c``; booleans, dates and the like pass."""
    if isinstance(kind, T.StringType):
        return {"uppercase": F.upper, "lowercase": F.lower, "double": _doubled_text}[fn](c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: map_leaf(x, kind.elementType, fn))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: map_leaf(v, kind.valueType, fn))
    if isinstance(kind, T.StructType):
        made = F.struct(*[map_leaf(c.getField(f.name), f.dataType, fn).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), made)
    if fn == "double" and isinstance(kind, NUMERIC):
        return c.cast("bigint" if isinstance(kind, INTEGRAL) else "double") * 2
    return c


def map_records(df: DataFrame, script: str) -> DataFrame:
    """Map: one scalar function over every leaf value; names never change.

    In a typed column a string stays a string: "7" doubles to "14".
    """
    fn = parse_map(script)
    if fn == "identity":
        return df
    return df.select(*[map_leaf(col(f.name), f.dataType, fn).alias(f.name) for f in df.schema.fields])


def predicate_column(df: DataFrame, p: Predicate, coerce: bool = False) -> Column:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if p.kind in ("always_true", "always_false"):
        return F.lit(p.kind == "always_true")
    if p.kind == "non_empty":
        return reduce(Column.__and__, [col(n).isNotNull() for n in kinds], F.lit(bool(kinds)))
    if p.kind == "has_field":
        return F.lit(p.field in kinds)
    if p.field not in kinds:
        return F.lit(False)
    c, kind = col(p.field), kinds[p.field]
    if p.kind == "equals":
        if isinstance(kind, T.StringType):
            return F.lower(c) == p.text.lower()
        if coerce and isinstance(kind, NUMERIC):
            return c.cast("double") == F.lit(p.text).try_cast("double")
        return F.lit(False)
    if not isinstance(kind, NUMERIC):
        return F.lit(False)
    bound = p.number
    if isinstance(kind, INTEGRAL):
        whole = integral_bound(p.kind, bound)
        if whole is None:
            c = c.cast("double")
        elif not -(2**63) <= whole < 2**63:
            return F.lit((whole < 0) == (p.kind == "gt")) & c.isNotNull()
        else:
            bound = whole
    elif isinstance(kind, T.DecimalType):
        c = c.cast("double")
    # JSON has no NaN, and Spark sorts NaN above every number
    test = c > F.lit(bound) if p.kind == "gt" else c < F.lit(bound)
    return test & ~F.isnan(c) if p.kind == "gt" and isinstance(kind, (T.FloatType, T.DoubleType)) else test


def filter_records(df: DataFrame, predicate: str, coerce: bool = False) -> DataFrame:
    """Filter: keep records for which the predicate holds; a null never satisfies one.

    ``equals`` compares text regardless of case and never matches a number unless
    ``coerce`` is set (an extension).
    """
    p = parse_predicate(predicate)
    return df if p.kind == "always_true" else df.where(predicate_column(df, p, coerce))


def _split(df: DataFrame, f: FlatFunction) -> DataFrame:
    c = col(f.field)
    # plain replacements and a cut at one blank stay in generated code, other than a pattern
    words = F.array_remove(F.split(F.translate(c, BREAKS, " " * len(BREAKS)), " "), "")
    words = F.when(F.size(words) > 0, words).otherwise(F.array(c))
    return df.select(*[F.explode(words).alias(n) if n == f.field else col(n) for n in df.columns])


def _explode(df: DataFrame, f: FlatFunction, kind: T.ArrayType) -> DataFrame:
    c = col(f.field)
    kept = F.when(c.isNull(), F.array(F.lit(None).cast(kind.elementType))).otherwise(c)
    return df.select(*[F.explode(kept).alias(n) if n == f.field else col(n) for n in df.columns])


def _as_text(c: Column, kind: T.DataType) -> Column:
    return F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")


def _expand(df: DataFrame) -> DataFrame:
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    pairs = [F.struct(F.lit(f.name).alias("key"), _as_text(col(f.name), f.dataType).alias("value")) for f in fields]
    return df.select(F.inline(F.array(*pairs)))


def flat_map(df: DataFrame, func: str) -> DataFrame:
    """FlatMap: split text into words, explode an array, or turn fields into (key, value) rows.

    A row without words, without the field or with a null in it stays as it is; an empty
    array drops its row.
    """
    f = parse_flat(func)
    if f.kind == "identity":
        return df
    if f.kind == "json_expand":
        return _expand(df)
    kind = {x.name: x.dataType for x in df.schema.fields}.get(f.field)
    if f.kind == "split" and isinstance(kind, T.StringType):
        return _split(df, f)
    if f.kind == "explode_array" and isinstance(kind, T.ArrayType):
        return _explode(df, f, kind)
    return df
