"""Folds a graph into lazy DataFrames, one for each node."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.operators import dynamic, keyed, record_wise
from weftline.plans.spec import JOIN_TYPES, DagError, DagSpec, Node
from weftline.sources import readers


def _is_dynamic(df: DataFrame) -> bool:
    return df.dtypes == [("rec", "variant")]


def _apply(node: Node, parents: list[DataFrame], strict: bool) -> DataFrame:
    p = node.params
    if node.kind == "Join":
        left, right = parents
        how = JOIN_TYPES[p["join_type"]]
        lk, rk = p.get("left_key", p.get("key")), p.get("right_key", p.get("key"))
        if _is_dynamic(left) and _is_dynamic(right) and lk == rk:
            return dynamic.join_records(left, right, lk, how)
        return keyed.join_records(left, right, lk, rk, how, strict)
    df = keyed.union_all(parents)
    ops = dynamic if _is_dynamic(df) else record_wise
    red = dynamic if _is_dynamic(df) else keyed
    match node.kind:
        case "Identity" | "Write":
            return df
        case "Map":
            return ops.map_records(df, p["script"])
        case "Filter":
            return dynamic.filter_records(df, p["predicate"]) if ops is dynamic else record_wise.filter_records(df, p["predicate"], bool(p.get("coerce")))
        case "FlatMap":
            return ops.flat_map(df, p["func"])
        case "Reduce":
            return red.reduce_records(df, p["reducer"])
        case "Aggregate":
            return red.reduce_records(df, p["aggregation"])
        case "ReduceByKey":
            return red.reduce_by_key(df, p["key"], p["op"], strict)
        case "ShuffleByKey":
            return red.shuffle_by_key(df, p["key"], p["total_partitions"])
    raise DagError(f"unknown operator '{node.kind}'")


def compile_dag(
    spark: SparkSession,
    dag: DagSpec,
    *,
    sources: Mapping[str, DataFrame] | None = None,
    scope: str = "global",
    slice_by: Callable[[DataFrame], object] | None = None,
    mode: str = "typed",
    strict: bool = False,
    observations: dict[str, Observation] | None = None,
    observe_all: bool = False,
) -> dict[str, DataFrame]:
    """A lazy DataFrame for each node; only finding the schemas of CSV and JSON runs jobs.

    ``sources`` replaces Read nodes by id. ``scope="task"`` keeps records of different
    slices apart in joins and aggregates: the slice is ``slice_by(df)`` modulo the graph's
    partitions. ``observations`` gets a row count for each sink once an action has run, or
    with ``observe_all`` for each node; then no filter passes a node on its way to the scan.
    """
    if scope not in ("global", "task"):
        raise DagError(f"unknown scope '{scope}'")
    if scope == "task" and slice_by is None:
        raise DagError("scope 'task' needs slice_by, the expression that numbers records")
    made: dict[str, DataFrame] = {}
    sinks = {*dag.sinks(), *(n.id for n in dag.nodes if n.kind == "Write")}
    for node in dag.ordered():
        if node.kind == "Read":
            df = (sources or {}).get(node.id)
            df = readers.read(spark, node.params["uri"], node.params["format"], mode) if df is None else df
            if scope == "task":
                df = df.withColumn(keyed.SLICE, F.pmod(slice_by(df), F.lit(dag.partitions)).cast("int"))
        else:
            df = _apply(node, [made[x] for x in dag.parents(node.id)], strict)
        if observations is not None and (observe_all or node.id in sinks):
            observations[node.id] = Observation(f"node_{node.id}")
            df = df.observe(observations[node.id], F.count(F.lit(1)).alias("rows"))
        made[node.id] = df
    if scope == "task":
        made = {k: v.drop(keyed.SLICE) if k in dag.sinks() else v for k, v in made.items()}
    return made


def result(dag: DagSpec, made: Mapping[str, DataFrame]) -> DataFrame:
    """The sink that the document declares last."""
    return made[dag.sinks()[-1]]
