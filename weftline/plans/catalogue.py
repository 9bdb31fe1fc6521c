"""The query catalogue: graphs over the driver's tables, with the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.compiler import compile_dag, result
from weftline.plans.spec import parse_dag
from weftline.sources.writers import scratch, write

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def read(sf_dir: str, table: str) -> dict:
    return {"Read": {"uri": f"{sf_dir}/{table}.parquet", "format": "parquet"}}


def chain(sf_dir: str, table: str, *ops: dict | str, partitions: int = 4) -> dict:
    """A graph of one Read and the operators after it."""
    nodes = [{"id": f"n{i}", "operator": op} for i, op in enumerate([read(sf_dir, table), *ops])]
    return {"nodes": nodes, "edges": [{"from": f"n{i}", "to": f"n{i + 1}"} for i in range(len(ops))], "partitions": partitions}


def graph(nodes: dict[str, dict | str], *edges: tuple[str, str], partitions: int = 4) -> dict:
    return {"nodes": [{"id": k, "operator": v} for k, v in nodes.items()], "edges": [{"from": a, "to": b} for a, b in edges], "partitions": partitions}


def run(spark: SparkSession, document: dict, **options) -> DataFrame:
    dag = parse_dag(document)
    return result(dag, compile_dag(spark, dag, **options))


def _add(name: str, sql: str, build: Query) -> None:
    QUERIES[name], ORACLE[name] = build, sql


def _chain(name: str, sql: str, table: str, *ops: dict | str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    _add(name, sql, lambda spark, d: then(run(spark, chain(d, table, *ops))))


def Map(f): return {"Map": {"script": f}}  # noqa: E704, N802
def Filter(p): return {"Filter": {"predicate": p}}  # noqa: E704, N802
def FlatMap(f): return {"FlatMap": {"func": f}}  # noqa: E704, N802
def Reduce(r): return {"Reduce": {"reducer": r}}  # noqa: E704, N802
def ByKey(k, r): return {"ReduceByKey": {"key": k, "op": r}}  # noqa: E704, N802
def Join(how, **keys): return {"Join": {"join_type": how, **keys}}  # noqa: E704, N802


def _rounded(c: str, digits: int = 2) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(c, F.round(c, digits))


_chain("read_scan", "SELECT * FROM region", "region")
_chain("map_identity", "SELECT * FROM nation", "nation", Map("identity"))
_chain("map_uppercase", "SELECT s_suppkey, upper(s_name) AS s_name, s_nationkey, s_acctbal FROM supplier", "supplier", Map("uppercase"))
_chain("map_lowercase", "SELECT p_partkey, lower(p_name) AS p_name, lower(p_brand) AS p_brand, lower(p_type) AS p_type, p_size, p_retailprice FROM part", "part", Map("lowercase"))
_chain("map_double", "SELECT p_partkey*2 AS p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT)*2 AS p_size, p_retailprice*2 AS p_retailprice FROM part", "part", Map("double"))
_add(
    "map_double_numeric_string",
    "SELECT CAST(n_nationkey AS BIGINT)*2 AS n_nationkey, n_name, CAST(CAST(n_regionkey AS BIGINT)*2 AS VARCHAR) AS n_regionkey FROM nation",
    lambda spark, d: run(spark, chain(d, "nation", Map("double")), sources={"n0": spark.read.parquet(f"{d}/nation.parquet").withColumn("n_regionkey", F.col("n_regionkey").cast("string"))}),
)
_chain(
    "map_double_nested_array",
    "SELECT vec_id*2 AS vec_id, CAST(embedding[1] AS DOUBLE)*2 AS e0, len(embedding) AS n FROM embeddings",
    "embeddings",
    Map("double"),
    then=lambda df: df.select("vec_id", F.get("embedding", F.lit(0)).alias("e0"), F.size("embedding").cast("bigint").alias("n")),
)
_chain("filter_always_true", "SELECT * FROM customer", "customer", Filter("always_true"))
_chain("filter_always_false", "SELECT count(*) AS count FROM customer WHERE FALSE", "customer", Filter("always_false"), Reduce("count"))
_chain("filter_has_field", "SELECT * FROM labels", "labels", Filter("has_field:quality"))
_chain("filter_has_field_missing", "SELECT count(*) AS count FROM labels WHERE FALSE", "labels", Filter("has_field:nope"), Reduce("count"))
_chain("filter_equals_ci", "SELECT * FROM events WHERE lower(event_type) = lower('SIGNUP')", "events", Filter("equals:event_type=SIGNUP"))
_chain("filter_equals_numeric", "SELECT count(*) AS count FROM orders WHERE FALSE", "orders", Filter("equals:o_custkey=5"), Reduce("count"))
_chain("filter_gt", "SELECT * FROM lineitem WHERE l_quantity > 45", "lineitem", Filter("gt:l_quantity=45"))
_chain("filter_lt", "SELECT * FROM lineitem WHERE l_discount < 0.02", "lineitem", Filter("lt:l_discount=0.02"))
_chain("filter_chain", "SELECT * FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20 AND lower(l_returnflag) = 'r'", "lineitem", Filter("gt:l_quantity=10"), Filter("lt:l_quantity=20"), Filter("equals:l_returnflag=r"))
_chain("flat_map_identity", "SELECT * FROM region", "region", FlatMap("identity"))
_chain("flat_map_split", r"SELECT p_partkey, unnest(list_filter(regexp_split_to_array(p_name, '[\s,]+'), lambda t: t <> '')) AS p_name, p_brand, p_type, p_size, p_retailprice FROM part", "part", FlatMap("split:p_name"))
_chain(
    "wordcount",
    r"SELECT text, count(*) AS count FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[\s,]+'), lambda t: t <> '')) AS text FROM documents) GROUP BY text",
    "documents",
    FlatMap("split:text"),
    ByKey("text", "count"),
)
_chain("flat_map_explode_array", "SELECT vec_id, round(CAST(unnest(embedding) AS DOUBLE), 6) AS embedding, label FROM embeddings", "embeddings", FlatMap("explode_array:embedding"), then=lambda df: df.withColumn("embedding", F.round(F.col("embedding").cast("double"), 6)))
_chain("flat_map_json_expand", "SELECT 'n_name' AS key, n_name AS value FROM nation UNION ALL SELECT 'n_nationkey', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation", "nation", FlatMap("json_expand"))
_chain("reduce_count", "SELECT count(*) AS count FROM lineitem", "lineitem", Reduce("count"))
_chain("reduce_sum", "SELECT coalesce(sum(CAST(l_quantity AS DOUBLE)), 0.0) AS sum_l_quantity FROM lineitem", "lineitem", Reduce("sum:l_quantity"))
_chain("reduce_sum_no_numeric", "SELECT CAST(0.0 AS DOUBLE) AS sum_l_returnflag", "lineitem", Reduce("sum:l_returnflag"))
_chain("reduce_min", "SELECT coalesce(min(CAST(l_extendedprice AS DOUBLE)), 0.0) AS min_l_extendedprice FROM lineitem", "lineitem", Reduce("min:l_extendedprice"))
_chain("reduce_max", "SELECT coalesce(max(CAST(l_extendedprice AS DOUBLE)), 0.0) AS max_l_extendedprice FROM lineitem", "lineitem", {"Aggregate": {"aggregation": "max:l_extendedprice"}})
_chain("reduce_empty", "SELECT coalesce(min(CAST(o_totalprice AS DOUBLE)), 0.0) AS min_o_totalprice FROM orders WHERE FALSE", "orders", Filter("always_false"), Reduce("min:o_totalprice"))
_chain("reduce_collect", "SELECT len(list(r_regionkey)) AS n FROM region", "region", Reduce("collect"), then=lambda df: df.select(F.size("collect").cast("bigint").alias("n")))
_chain("reduce_by_key_count", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type", "events", ByKey("event_type", "count"))
_chain("reduce_by_key_sum", "SELECT event_type, round(coalesce(sum(value), 0.0), 2) AS sum_value FROM events GROUP BY event_type", "events", ByKey("event_type", "sum:value"), then=_rounded("sum_value"))
_chain("reduce_by_key_min", "SELECT o_orderpriority, min(o_totalprice) AS min_o_totalprice FROM orders GROUP BY o_orderpriority", "orders", ByKey("o_orderpriority", "min:o_totalprice"))
_chain("reduce_by_key_max", "SELECT o_orderpriority, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY o_orderpriority", "orders", ByKey("o_orderpriority", "max:o_totalprice"))
_chain("reduce_by_key_collect", "SELECT event_type, len(list(event_id)) AS n FROM events GROUP BY event_type", "events", ByKey("event_type", "collect"), then=lambda df: df.select("event_type", F.size("collect").cast("bigint").alias("n")))


def _joined(name: str, sql: str, left, right, how: str, columns: tuple[str, ...], *after: dict | str, then=lambda df: df, **keys: str) -> None:
    """left and right: a table, or a table and the operators before the join."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        nodes, edges, ends = {}, [], []
        for side, (table, *ops) in (("l", left), ("r", right)):
            ids = [f"{side}{i}" for i in range(len(ops) + 1)]
            nodes |= dict(zip(ids, [read(d, table), *ops], strict=True))
            edges += list(zip(ids, ids[1:], strict=False))
            ends.append(ids[-1])
        ids = ["join", *[f"a{i}" for i in range(len(after))]]
        nodes |= dict(zip(ids, [Join(how, **keys), *after], strict=True))
        edges += [(e, "join") for e in ends] + list(zip(ids, ids[1:], strict=False))
        df = then(run(spark, graph(nodes, *edges)))
        return df.select(*columns) if columns else df

    _add(name, sql, build)


_D, _L = ("documents",), ("labels",)
_joined("filter_non_empty", "SELECT d.doc_id AS left_doc_id, d.lang AS left_lang, l.doc_id AS right_doc_id, l.quality AS right_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NOT NULL AND d.text IS NOT NULL AND d.lang IS NOT NULL AND d.source IS NOT NULL AND d.n_chars IS NOT NULL AND l.doc_id IS NOT NULL AND l.quality IS NOT NULL AND l.toxic IS NOT NULL", _D, _L, "Left", ("left_doc_id", "left_lang", "right_doc_id", "right_quality"), Filter("non_empty"), key="doc_id")
_joined("join_inner", "SELECT d.doc_id AS left_doc_id, d.lang AS left_lang, l.doc_id AS right_doc_id, l.quality AS right_quality, l.toxic AS right_toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id", _D, _L, "Inner", ("left_doc_id", "left_lang", "right_doc_id", "right_quality", "right_toxic"), key="doc_id")
_joined("join_left", "SELECT d.doc_id AS left_doc_id, d.lang AS left_lang, l.doc_id AS right_doc_id, l.quality AS right_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", _D, _L, "Left", ("left_doc_id", "left_lang", "right_doc_id", "right_quality"), key="doc_id")
_joined("join_right", "SELECT l.doc_id AS left_doc_id, l.quality AS left_quality, d.doc_id AS right_doc_id, d.lang AS right_lang FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id", _L, _D, "Right", ("left_doc_id", "left_quality", "right_doc_id", "right_lang"), key="doc_id")
_joined(
    "join_full",
    "SELECT s.s_suppkey AS left_s_suppkey, s.s_name AS left_s_name, p.p_partkey AS right_p_partkey, p.p_size AS right_p_size FROM supplier s FULL JOIN part p ON s.s_suppkey = p.p_size",
    ("supplier",),
    ("part",),
    "Full",
    ("left_s_suppkey", "left_s_name", "right_p_partkey", "right_p_size"),
    left_key="s_suppkey",
    right_key="p_size",
)
_joined("join_duplicates", "SELECT c.c_custkey AS left_c_custkey, s.s_suppkey AS right_s_suppkey FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey", ("customer",), ("supplier",), "Inner", ("left_c_custkey", "right_s_suppkey"), left_key="c_nationkey", right_key="s_nationkey")
_joined(
    "join_then_aggregate",
    "SELECT c.c_mktsegment AS left_c_mktsegment, round(coalesce(sum(o.o_totalprice), 0.0), 2) AS sum_right_o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000 GROUP BY c.c_mktsegment",
    ("customer",),
    ("orders",),
    "Inner",
    (),
    Filter("gt:right_o_totalprice=100000"),
    ByKey("left_c_mktsegment", "sum:right_o_totalprice"),
    then=_rounded("sum_right_o_totalprice"),
    left_key="c_custkey",
    right_key="o_custkey",
)


def _string_key(spark: SparkSession, d: str) -> DataFrame:
    doc = graph({"d": read(d, "documents"), "l": read(d, "labels"), "j": Join("Inner", key="doc_id")}, ("d", "j"), ("l", "j"))
    text = spark.read.parquet(f"{d}/labels.parquet").withColumn("doc_id", F.col("doc_id").cast("string"))
    return run(spark, doc, sources={"l": text}).select("left_doc_id", "right_doc_id")


_add("join_string_number_key", "SELECT d.doc_id AS left_doc_id, CAST(l.doc_id AS VARCHAR) AS right_doc_id FROM documents d JOIN labels l ON CAST(d.doc_id AS VARCHAR) = CAST(l.doc_id AS VARCHAR)", _string_key)
_chain("shuffle_by_key", "SELECT * FROM orders", "orders", {"ShuffleByKey": {"key": "o_custkey", "total_partitions": 8}})

_BOTH_ENDS = "SELECT * FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT * FROM orders WHERE o_totalprice < 50000"


def _two_filters(last: dict | str) -> Query:
    return lambda spark, d: run(spark, graph({"r": read(d, "orders"), "a": Filter("gt:o_totalprice=300000"), "b": Filter("lt:o_totalprice=50000"), "u": last}, ("r", "a"), ("r", "b"), ("a", "u"), ("b", "u")))


_add("union_all_multi_parent", _BOTH_ENDS, _two_filters(Map("identity")))
_add("union_then_reduce_by_key", f"SELECT o_orderstatus, count(*) AS count FROM ({_BOTH_ENDS}) GROUP BY o_orderstatus", _two_filters(ByKey("o_orderstatus", "count")))
_add("fan_out", "SELECT a.r_regionkey AS left_r_regionkey, b.r_name AS right_r_name FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey", lambda spark, d: run(spark, graph({"r": read(d, "region"), "x": Map("identity"), "y": Filter("always_true"), "j": Join("Inner", key="r_regionkey")}, ("r", "x"), ("r", "y"), ("x", "j"), ("y", "j"))).select("left_r_regionkey", "right_r_name"))
_add("task_scope_reduce", "SELECT round(sum(l_quantity), 2) AS sum_l_quantity FROM lineitem GROUP BY l_orderkey % 4", lambda spark, d: run(spark, chain(d, "lineitem", Reduce("sum:l_quantity")), scope="task", slice_by=lambda df: df["l_orderkey"]).withColumn("sum_l_quantity", F.round("sum_l_quantity", 2)))
_add("task_scope_reduce_by_key", "SELECT event_type, count(*) AS count FROM events GROUP BY event_id % 4, event_type", lambda spark, d: run(spark, chain(d, "events", ByKey("event_type", "count")), scope="task", slice_by=lambda df: df["event_id"]))
_add(
    "task_scope_join",
    "SELECT c.c_custkey AS left_c_custkey, o.o_orderkey AS right_o_orderkey FROM customer c JOIN orders o ON c.c_custkey % 4 = o.o_orderkey % 4 AND c.c_custkey = o.o_custkey",
    lambda spark, d: run(spark, graph({"c": read(d, "customer"), "o": read(d, "orders"), "j": Join("Inner", left_key="c_custkey", right_key="o_custkey")}, ("c", "j"), ("o", "j")), scope="task", slice_by=lambda df: df["c_custkey"] if "c_custkey" in df.columns else df["o_orderkey"]).select("left_c_custkey", "right_o_orderkey"),
)


def _props(spark: SparkSession, d: str) -> DataFrame:
    recs = spark.read.parquet(f"{d}/events.parquet").select(F.parse_json("props").alias("rec"))
    return run(spark, graph({"p": read(d, "events"), "s": Reduce("sum:k")}, ("p", "s")), sources={"p": recs})


_add("json_props_expand", "SELECT CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS sum_k FROM events", _props)


def _from_text(name: str, sql: str, fmt: str, make: Callable[[SparkSession, str, str], None], *ops: dict | str, then: Callable[[DataFrame], DataFrame] = lambda df: df, **options) -> None:
    """A graph over files of a format, which are written first."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        folder = scratch(spark)
        make(spark, d, folder)
        doc = chain(d, "region", *ops)
        doc["nodes"][0]["operator"] = {"Read": {"uri": folder, "format": fmt}}
        return then(run(spark, doc, **options))

    _add(name, sql, build)


def _csv_files(spark: SparkSession, d: str, folder: str) -> None:
    """Several files, each with a header, and blanks and tabs around cells."""
    cells = [F.concat(F.lit("\t"), F.col("c_custkey").cast("string")).alias(" key"), F.concat("c_name", F.lit(" ")).alias("name "), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")]
    rows = spark.read.parquet(f"{d}/customer.parquet").repartitionByRange(24, "c_custkey").select(*cells)
    rows.write.options(header=True, quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folder)


def _json_lines(spark: SparkSession, d: str, folder: str) -> None:
    rows = spark.read.parquet(f"{d}/nation.parquet").select(F.to_json(F.struct("n_nationkey", "n_name", F.struct("n_regionkey").alias("at"))).alias("j"))
    rows.select(F.explode(F.array(F.concat(F.lit("\t"), "j"), F.lit(" \t"))).alias("value")).write.text(folder)


def _json_array(spark: SparkSession, d: str, folder: str) -> None:
    rows = spark.read.parquet(f"{d}/nation.parquet").agg(F.collect_list(F.to_json(F.struct("n_nationkey", "n_name"))).alias("j"))
    rows.select(F.explode(F.array(F.lit("\t"), F.concat(F.lit(" ["), F.array_join("j", ","), F.lit("]")))).alias("value")).coalesce(1).write.text(folder)


_NATION_SQL = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name"
_from_text("read_csv", "SELECT c_custkey AS key, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM customer", "csv", _csv_files)
_from_text("read_csv_dynamic", "SELECT CAST(sum(c_custkey) AS DOUBLE) AS sum_key FROM customer", "csv", _csv_files, Reduce("sum:key"), mode="dynamic")
_from_text("read_jsonl", f"{_NATION_SQL}, CAST(n_regionkey AS BIGINT) AS region FROM nation", "jsonl", _json_lines, then=lambda df: df.select("n_nationkey", "n_name", F.col("at.n_regionkey").alias("region")))
_from_text("read_ndjson", "SELECT CAST(n_regionkey AS BIGINT)*2 AS region FROM nation", "ndjson", _json_lines, Map("double"), mode="dynamic", then=lambda df: df.select(F.variant_get("rec", "$.at.n_regionkey", "bigint").alias("region")))
_from_text("read_json", f"{_NATION_SQL} FROM nation", "json", _json_array)


def _dynamic(name: str, sql: str, table: str, record: Callable[[], object], *ops: dict | str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """A graph over one VARIANT column that is made of a table's columns."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        recs = spark.read.parquet(f"{d}/{table}.parquet").select(F.to_variant_object(record()).alias("rec"))
        return then(run(spark, chain(d, table, *ops), sources={"n0": recs}))

    _add(name, sql, build)


def _nested():
    inner = F.struct(F.array(F.struct(F.lower("n_name").alias("f"))).alias("e"))
    return F.struct("n_nationkey", F.struct(F.struct(F.struct(inner.alias("d")).alias("c")).alias("b")).alias("a"))


_dynamic("map_dynamic_deep", f"{_NATION_SQL} FROM nation", "nation", _nested, Map("uppercase"), then=lambda df: df.select(F.variant_get("rec", "$.n_nationkey", "bigint").alias("n_nationkey"), F.variant_get("rec", "$.a.b.c.d.e[0].f", "string").alias("n_name")))
_dynamic("reduce_by_key_dynamic", "SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, count(*) AS count FROM orders GROUP BY o_custkey", "orders", lambda: F.struct("o_custkey"), ByKey("o_custkey", "count"))


def _one_partition_a_key(df: DataFrame) -> DataFrame:
    key = F.variant_get("rec", "$.o_custkey", "bigint")
    return df.select(key.alias("o_custkey"), F.spark_partition_id().alias("p")).groupBy("o_custkey").agg(F.count_distinct("p").alias("n_partitions"), F.count(F.lit(1)).alias("n"))


_dynamic("shuffle_by_key_dynamic", "SELECT o_custkey, CAST(1 AS BIGINT) AS n_partitions, count(*) AS n FROM orders GROUP BY o_custkey", "orders", lambda: F.struct("o_custkey"), {"ShuffleByKey": {"key": "o_custkey", "total_partitions": 8}}, then=_one_partition_a_key)


def _written(name: str, fmt: str) -> None:
    """What a Write node leaves, read again."""

    def build(spark: SparkSession, d: str) -> DataFrame:
        folder = f"{scratch(spark)}/{fmt}"
        doc = chain(d, "nation", {"Write": {"uri": folder, "format": fmt}})
        write(run(spark, doc), folder, fmt)
        again = chain(d, "nation")
        again["nodes"][0]["operator"] = {"Read": {"uri": folder, "format": fmt}}
        return run(spark, again).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")

    _add(name, f"{_NATION_SQL} FROM nation", build)


_written("write_jsonl", "jsonl")
_written("write_csv", "csv")
_written("write_parquet", "parquet")
