"""Weftline: JSON dataflow documents compiled to lazy Spark DataFrames."""

from weftline.engine import Engine, Job, JobStatus
from weftline.plans.compiler import compile_dag
from weftline.plans.spec import DagError, DagSpec, parse_dag

__all__ = ["DagError", "DagSpec", "Engine", "Job", "JobStatus", "compile_dag", "parse_dag"]
