"""Times headline queries; prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set it up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from weftline.plans.catalogue import QUERIES

HEADLINE = {"map_double_lineitem": None, "wordcount": "wordcount", "join_then_aggregate": "join_then_aggregate", "filter_chain": "filter_chain", "reduce_by_key_sum": "reduce_by_key_sum", "join_inner": "join_inner", "union_then_reduce_by_key": "union_then_reduce_by_key", "task_scope_join": "task_scope_join", "flat_map_explode_array": "flat_map_explode_array", "json_props_expand": "json_props_expand"}


def main() -> None:
    from weftline.plans.catalogue import Map, chain, run

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name, query in HEADLINE.items():
        make = (lambda: run(spark, chain(sf, "lineitem", Map("double")))) if query is None else (lambda query=query: QUERIES[query](spark, sf))
        took = []
        for _ in range(runs + 1):  # the first one warms up
            t = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t)
        out[name] = round(statistics.median(took[1:]), 4)
    from weftline import Engine

    took = []
    for _ in range(runs + 1):
        t = time.perf_counter()
        Engine(spark).submit(chain(sf, "lineitem", {"Filter": {"predicate": "gt:l_quantity=45"}}))
        took.append(time.perf_counter() - t)
    out["submitted_filter"] = round(statistics.median(took[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "sum of medians of headline queries", "value": round(sum(out.values()), 4), "unit": "sec", "queries": out, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    sys.exit(main())
