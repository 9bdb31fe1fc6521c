"""``python -m weftline.cli run|explain|dag GRAPH`` and ``status|progress|metrics|results JOB``.

The second kind reads the job log, which ``--log`` or WEFTLINE_JOB_LOG names.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from weftline.config import Config
from weftline.engine import Engine, JobStatus
from weftline.joblog import JobLog
from weftline.plans.spec import DagError, parse_dag


def _logged(config: Config, command: str, job_id: str) -> int:
    if not config.job_log:
        print("no job log is set", file=sys.stderr)
        return 2
    try:
        state = JobLog(config.job_log).get(job_id)
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 1
    shown = {"status": state, "progress": state["progress"], "metrics": {"rows": state["metrics"], "tasks": state["tasks"]}, "results": state["outputs"]}
    print(json.dumps(shown[command]))
    return 0


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="weftline")
    ap.add_argument("command", choices=["run", "explain", "dag", "status", "progress", "metrics", "results"])
    ap.add_argument("target", help="a graph file, or a job id")
    ap.add_argument("--output")
    ap.add_argument("--config", help="a JSON file of settings")
    ap.add_argument("--log", help="folder of the job log")
    ap.add_argument("--dynamic", action="store_true", help="one VARIANT column instead of typed ones")
    ap.add_argument("--strict", action="store_true", help="missing or ill-typed keys are errors")
    args = ap.parse_args(argv)
    config = Config.load(args.config)
    config = dataclasses.replace(config, mode="dynamic" if args.dynamic else config.mode, strict=args.strict or config.strict, job_log=args.log or config.job_log)
    logging.basicConfig(format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    logging.getLogger("weftline").setLevel(config.log_level)
    if args.command in ("status", "progress", "metrics", "results"):
        return _logged(config, args.command, args.target)
    text = Path(args.target).read_text()
    try:
        dag = parse_dag(text)
    except DagError as e:
        print(e, file=sys.stderr)
        return 2
    if args.command == "dag":
        for node in dag.ordered():
            print(f"{node.id}: {node.kind} <- {', '.join(dag.parents(node.id)) or '-'}")
        return 0
    engine = Engine(SparkSession.builder.appName("weftline").getOrCreate(), config=config)
    if args.command == "explain":
        engine.compile(dag).explain("formatted")
        return 0
    job = engine.submit(dag, args.output)
    print(json.dumps(job.status()))
    return int(job.state != JobStatus.SUCCEEDED)


if __name__ == "__main__":
    sys.exit(main())
