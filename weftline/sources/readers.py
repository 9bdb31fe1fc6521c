"""Read: Parquet, CSV, JSON lines and JSON, in a typed and in a dynamic form.

Dynamic frames have one VARIANT column ``rec`` with one record a row and keep what typed
columns cannot: absent against null, and cells of several kinds in one column. Typed CSV
takes one kind for a column: BIGINT if all its cells are whole numbers, DOUBLE if all are
numbers, else STRING. Finding kinds and schemas runs jobs when the frame is made: three for
typed CSV, one for typed JSON lines, two for typed JSON. A JSON array is one value that no
split can begin in, so a file that holds one is read by one task; JSON lines are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.record_wise import NUMBER_TEXT, WHOLE_TEXT, col

FORMATS = ("csv", "jsonl", "ndjson", "json", "parquet")


def read(spark: SparkSession, uri: str, fmt: str, mode: str = "typed") -> DataFrame:
    """The records of ``uri``; ``mode`` is "typed" or "dynamic"."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format '{fmt}'")
    if fmt == "parquet":
        return spark.read.parquet(uri)
    if fmt == "csv":
        header, rows = _csv_rows(spark, uri)
        return _csv_dynamic(header, rows) if mode == "dynamic" else _csv_typed(header, rows)
    records = _json_records(spark, uri, fmt)
    return records if mode == "dynamic" else typed(records)


#: What the CSV reader takes for the end of a cell; it makes a line one cell.
NO_CELL_END = "\uffff\ufffe\uffff"


def trimmed(c: Column) -> Column:
    """Text without Unicode white space at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _not_blank(c: Column) -> Column:
    return c.rlike(r"(?U)\S")


def read_csv(spark: SparkSession, uri: str, mode: str = "typed") -> DataFrame:
    return read(spark, uri, "csv", mode)


def read_jsonl(spark: SparkSession, uri: str, mode: str = "typed") -> DataFrame:
    return read(spark, uri, "jsonl", mode)


def _csv_rows(spark: SparkSession, uri: str) -> tuple[list[str], DataFrame]:
    """Header names and a frame of trimmed cells, split at every comma without quoting.

    Spark's own reader leaves out the first line of each file, however files and their
    splits are packed into tasks; names are those of the first file.
    """
    first = spark.read.text(uri).limit(1).collect()
    if not first or not first[0][0].strip():
        raise ValueError(f"'{uri}' has no header")
    header = [x.strip() for x in first[0][0].split(",")]
    whole = {"header": True, "sep": NO_CELL_END, "quote": "", "escape": "", "enforceSchema": True, "nullValue": NO_CELL_END, "emptyValue": ""}
    lines = spark.read.schema("value string").options(**whole).csv(uri)
    cells = F.transform(F.split("value", ",", -1), trimmed)
    return header, lines.where(_not_blank(F.col("value"))).select(cells.alias("cells"))


def _last_of_name(header: list[str]) -> dict[str, int]:
    return {name: i for i, name in enumerate(header)}


def _csv_typed(header: list[str], rows: DataFrame) -> DataFrame:
    """Cells beyond the header become ``col{index}``, absent ones null."""
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    names = _last_of_name([*header, *[f"col{i}" for i in range(len(header), width)]])
    cell = {n: F.get("cells", F.lit(i)) for n, i in names.items()}
    tests = []
    for i, c in enumerate(cell.values()):
        finite = F.abs(c.try_cast("double")) < float("inf")
        whole = F.coalesce(c.rlike(WHOLE_TEXT) & c.try_cast("bigint").isNotNull(), F.lit(False))
        number = F.coalesce(c.rlike(NUMBER_TEXT) & finite, F.lit(False))
        tests += [F.coalesce(F.every(F.when(c.isNotNull(), whole)), F.lit(False)).alias(f"w{i}"), F.coalesce(F.every(F.when(c.isNotNull(), number)), F.lit(False)).alias(f"n{i}")]
    kinds = rows.agg(*tests).first()

    def pick(i: int, c: Column) -> Column:
        return c.cast("bigint") if kinds[f"w{i}"] else c.cast("double") if kinds[f"n{i}"] else c

    return rows.select(*[pick(i, c).alias(n) for i, (n, c) in enumerate(cell.items())])


def _csv_dynamic(header: list[str], rows: DataFrame) -> DataFrame:
    names = _last_of_name(header)
    head = F.array(*[F.lit(n) for n in header])
    n = len(header)
    extra = F.when(F.size("cells") > n, F.transform(F.sequence(F.lit(n), F.size("cells") - 1), lambda i: F.concat(F.lit("col"), i.cast("string"))))
    keys = F.concat(head, F.coalesce(extra, F.array().cast("array<string>")))

    def value(c: Column) -> Column:
        whole, real = F.when(c.rlike(WHOLE_TEXT), c.try_cast("bigint")), F.when(c.rlike(NUMBER_TEXT), c.try_cast("double"))
        real = F.when(F.abs(real) < float("inf"), real)
        return F.coalesce(F.when(whole.isNotNull(), whole.cast("variant")), real.cast("variant"), c.cast("variant"))

    here = F.slice(keys, 1, F.size("cells"))
    pairs = F.zip_with(here, "cells", lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    if len(names) < n:
        # of two columns with one name the last that the row has stays
        pairs = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(here, i + 2, F.size("cells")), p["k"]))
    made = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], value(p["v"]))))
    return rows.select(F.to_variant_object(made).alias("rec"))


def wrap(v: Column) -> Column:
    """Records are objects; any other value becomes ``{"value": v}``."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.to_variant_object(F.struct(v.alias("value"))))


def _json_lines(lines: DataFrame) -> DataFrame:
    return lines.where(_not_blank(F.col("value"))).select(wrap(F.parse_json(trimmed(F.col("value")))).alias("rec"))


def _json_records(spark: SparkSession, uri: str, fmt: str) -> DataFrame:
    lines = spark.read.text(uri)
    if fmt != "json":
        return _json_lines(lines)
    start = lines.where(_not_blank(F.col("value"))).limit(1).collect()
    if not start or not start[0][0].lstrip().startswith("["):
        return _json_lines(lines)
    whole = spark.read.text(uri, wholetext=True)
    items = whole.select(F.parse_json("value").alias("doc")).lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    return items.select(wrap(F.col("value")).alias("rec"))


def typed(records: DataFrame, schema: str | None = None) -> DataFrame:
    """Typed columns of a dynamic frame; without a schema, one is merged from all records."""
    if schema is None:
        seen = records.agg(F.schema_of_variant_agg("rec").alias("s")).first()[0]
        if not seen or not seen.startswith("OBJECT<"):
            return records.select()
        schema = "STRUCT" + seen.replace("OBJECT<", "STRUCT<")[len("STRUCT") :]
        schema = schema.replace("VOID", "STRING")
    cols = records.select(F.variant_get("rec", "$", schema).alias("r")).select("r.*")
    # JSON numbers are whole or double
    return cols.select(*[col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else col(f.name) for f in cols.schema.fields])
