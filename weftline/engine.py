"""Engine and Job: submit a graph, follow it, get its result."""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.config import Config
from weftline.functions.dsl import NotationError
from weftline.joblog import JobLog
from weftline.plans.compiler import compile_dag, result
from weftline.plans.spec import DagError, DagSpec, parse_dag
from weftline.sources import writers

log = logging.getLogger("weftline")


class JobStatus(str, Enum):
    ACCEPTED = "Accepted"
    PENDING = "Pending"
    RUNNING = "Running"
    COMPLETED = "Completed"
    SUCCEEDED = "Succeeded"
    FAILED = "Failed"


class ErrorKind(str, Enum):
    INVALID_GRAPH = "InvalidGraph"
    NOT_FOUND = "NotFound"
    DATA = "Data"


def error_kind(e: Exception) -> ErrorKind:
    """Whether the graph is wrong, something it names is missing, or the run itself failed."""
    if isinstance(e, (DagError, NotationError)):
        return ErrorKind.INVALID_GRAPH
    missing = isinstance(e, AnalysisException) and (e.getCondition() or "") in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")
    return ErrorKind.NOT_FOUND if missing or isinstance(e, (FileNotFoundError, KeyError)) else ErrorKind.DATA


@dataclass
class Job:
    """One submitted graph. The graph is compiled at once; it runs when started."""

    spark: SparkSession
    dag: DagSpec
    frames: dict[str, DataFrame]
    observations: dict[str, Observation]
    output: str | None = None
    job_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    state: JobStatus = JobStatus.ACCEPTED
    error: str | None = None
    kind: ErrorKind | None = None
    outputs: list[str] = field(default_factory=list)
    started: float | None = None
    ended: float | None = None
    joblog: JobLog | None = None
    _thread: threading.Thread | None = None

    def to_df(self) -> DataFrame:
        """The lazy result."""
        return result(self.dag, self.frames)

    def _now(self, state: JobStatus) -> None:
        self.state = state
        log.info("job %s: %s", self.job_id, state.value)
        if self.joblog:
            self.joblog.put(self.job_id, self.status() | {"document": self.dag.to_dict(), "output": self.output})

    def run(self) -> Job:
        """Write the result (and what Write nodes name), or run it for nothing if there is no output."""
        self.started = time.time()
        self._now(JobStatus.RUNNING)
        sc = self.spark.sparkContext
        sc.setJobGroup(self.job_id, f"graph {self.job_id}")
        kept = self._kept()
        try:
            for df in kept:
                df.persist()
            for node in self.dag.nodes:
                if node.kind == "Write":
                    self.outputs.append(writers.write(self.frames[node.id], node.params["uri"], node.params["format"]))
            if self.output:
                self.outputs.append(writers.write(self.to_df(), self.output))
            elif not self.outputs:
                self.to_df().write.format("noop").mode("overwrite").save()
            self.ended = time.time()
            self._now(JobStatus.SUCCEEDED)
        except Exception as e:  # the job reports it; callers see it in status()
            self.ended, self.error, self.kind = time.time(), str(e), error_kind(e)
            self._now(JobStatus.FAILED)
        finally:
            for df in kept:
                df.unpersist()
        return self

    def _goals(self) -> list[str]:
        """Nodes that are run: each Write, and the last sink if its result is asked for."""
        goals = [n.id for n in self.dag.nodes if n.kind == "Write"]
        last = self.dag.sinks()[-1]
        return goals + [last] * (bool(self.output) or not goals)

    def _above(self, goal: str) -> set[str]:
        seen, left = set(), [goal]
        while left:
            x = left.pop()
            if x not in seen:
                seen.add(x)
                left += self.dag.parents(x)
        return seen

    def _kept(self) -> list[DataFrame]:
        """What several outputs share where their graphs part, to be computed once.

        Not scans: reading again what each output needs is cheaper than keeping all columns.
        """
        uses = Counter(x for goal in self._goals() for x in self._above(goal))
        shared = {k for k, n in uses.items() if n > 1}
        return [self.frames[n.id] for n in self.dag.nodes if n.id in shared and n.kind not in ("Read", "Identity") and not set(self.dag.children(n.id)) <= shared]

    def start(self) -> Job:
        self._now(JobStatus.PENDING)
        self._thread = threading.Thread(target=self.run, daemon=True)
        self._thread.start()
        return self

    def wait(self, timeout: float | None = None) -> Job:
        if self._thread is not None:
            self._thread.join(timeout)
        return self

    def progress(self) -> float:
        """Per cent of the tasks of the stages seen so far."""
        if self.state == JobStatus.SUCCEEDED:
            return 100.0
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self.job_id):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    done, total = done + s.numCompletedTasks, total + s.numTasks
        return 100.0 * done / total if total else 0.0

    def task_metrics(self) -> dict[str, int]:
        """Stages and tasks of the job so far, as far as Spark still knows them."""
        tracker, out = self.spark.sparkContext.statusTracker(), {"stages": 0, "tasks": 0, "completed_tasks": 0, "failed_tasks": 0}
        for job in tracker.getJobIdsForGroup(self.job_id):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    for key, n in (("stages", 1), ("tasks", s.numTasks), ("completed_tasks", s.numCompletedTasks), ("failed_tasks", s.numFailedTasks)):
                        out[key] += n
        return out

    def metrics(self) -> dict[str, int]:
        """Rows of each observed node, once the job has succeeded."""
        if self.state != JobStatus.SUCCEEDED:
            return {}
        return {k: o.get["rows"] for k, o in self.observations.items() if self._ran(k)}

    def _ran(self, node_id: str) -> bool:
        """Whether the node feeds something that was run."""
        return any(node_id in self._above(goal) for goal in self._goals())

    def records(self) -> Iterator[dict[str, Any]]:
        """The result's records one by one, a partition at a time on the driver."""
        df = self.to_df()
        text = F.to_json("rec") if df.dtypes == [("rec", "variant")] else F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        return (json.loads(r[0]) for r in df.select(text).toLocalIterator())

    def status(self) -> dict[str, Any]:
        took = (self.ended or time.time()) - self.started if self.started else None
        return {
            "job_id": self.job_id,
            "status": self.state.value,
            "progress": self.progress(),
            "metrics": self.metrics(),
            "tasks": self.task_metrics(),
            "seconds": took,
            "error": self.error,
            "error_kind": self.kind.value if self.kind else None,
            "outputs": list(self.outputs),
        }

    def results(self) -> list[str]:
        return list(self.outputs)


class Engine:
    """Compiles and runs graphs on one Spark session."""

    def __init__(self, spark: SparkSession, *, mode: str | None = None, strict: bool | None = None, config: Config | None = None):
        config = config or Config()
        self.spark = spark
        self.mode = config.mode if mode is None else mode
        self.strict = config.strict if strict is None else strict
        self.joblog = JobLog(config.job_log) if config.job_log else None
        if config.shuffle_partitions:
            spark.conf.set("spark.sql.shuffle.partitions", str(config.shuffle_partitions))
        self.jobs: dict[str, Job] = {}

    def compile(self, document: Any, **options: Any) -> DataFrame:
        """The lazy result of a graph; Catalyst plans it when an action comes."""
        dag = document if isinstance(document, DagSpec) else parse_dag(document)
        return result(dag, compile_dag(self.spark, dag, **{"mode": self.mode, "strict": self.strict} | options))

    def submit(self, document: Any, output: str | None = None, *, background: bool = False, node_metrics: bool = False, **options: Any) -> Job:
        """Run a graph. Rows are counted at its sinks; ``node_metrics`` counts them at every
        node, at the price of filters that no longer reach the scan.
        """
        dag = document if isinstance(document, DagSpec) else parse_dag(document)
        seen: dict[str, Observation] = {}
        frames = compile_dag(self.spark, dag, observations=seen, observe_all=node_metrics, **{"mode": self.mode, "strict": self.strict} | options)
        job = Job(self.spark, dag, frames, seen, output, joblog=self.joblog)
        self.jobs[job.job_id] = job
        return job.start() if background else job.run()

    def recover(self) -> list[Job]:
        """Run again the logged jobs that a driver left unfinished; they keep no old output."""
        left = [x for x in (self.joblog.all() if self.joblog else []) if x["status"] not in (JobStatus.SUCCEEDED.value, JobStatus.FAILED.value) and x["job_id"] not in self.jobs]
        done = []
        for x in left:
            done.append(self.submit(x["document"], x["output"]))
            self.joblog.put(x["job_id"], x | {"status": JobStatus.FAILED.value, "error": f"left unfinished, run again as {done[-1].job_id}"})
        return done

    def job(self, job_id: str) -> Job:
        if job_id not in self.jobs:
            raise KeyError(f"no job {job_id}")
        return self.jobs[job_id]
