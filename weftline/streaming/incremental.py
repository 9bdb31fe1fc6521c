"""Runs a graph over unbounded inputs with Structured Streaming.

Record-wise nodes and unions stream as they are; Reduce and ReduceByKey keep state, so
their sink uses the "complete" output mode. Joins of two streams are left to the caller,
who can set watermarks on the frames passed in.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftline.plans.compiler import compile_dag, result
from weftline.plans.spec import DagSpec, parse_dag


def compile_stream(spark: SparkSession, document: object, streams: Mapping[str, DataFrame]) -> DataFrame:
    """The result of a graph whose Read nodes are the given streaming frames."""
    dag = document if isinstance(document, DagSpec) else parse_dag(document)
    return result(dag, compile_dag(spark, dag, sources=streams))


def output_mode(document: object) -> str:
    dag = document if isinstance(document, DagSpec) else parse_dag(document)
    stateful = any(n.kind in ("Reduce", "Aggregate", "ReduceByKey") for n in dag.nodes)
    return "complete" if stateful else "append"


def start(spark: SparkSession, document: object, streams: Mapping[str, DataFrame], name: str, **options: str) -> StreamingQuery:
    """Start the graph into an in-memory table ``name`` or, with ``format`` and ``path``, a sink."""
    df = compile_stream(spark, document, streams)
    out = df.writeStream.outputMode(output_mode(document)).queryName(name)
    return out.format(options.pop("format", "memory")).options(**options).start()
