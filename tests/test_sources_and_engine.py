import json
import re

import pytest
from pyspark.sql import functions as F

from weftline import Engine, JobStatus, cli
from weftline.config import Config
from weftline.engine import ErrorKind, error_kind
from weftline.joblog import JobLog
from weftline.operators import dynamic, record_wise
from weftline.plans.catalogue import chain
from weftline.plans.spec import DagError
from weftline.sources.readers import read, read_csv, read_jsonl
from weftline.streaming import incremental


def pushed(df):
    return re.findall(r"PushedFilters: (\[.*?\])", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def records(df):
    return [json.loads(r[0]) for r in df.select(F.to_json("rec")).collect()]


CSV = """ a , b,c
1, x ,"q
+5,1e5
007,inf,true,extra

,20000000000000000000,-0
"""


def test_csv_dynamic(spark, tmp_path):
    got = records(read(spark, put(tmp_path, "t.csv", CSV), "csv", "dynamic"))
    assert got == [{"a": 1, "b": "x", "c": '"q'}, {"a": 5, "b": 100000.0}, {"a": 7, "b": "inf", "c": "true", "col3": "extra"}, {"a": "", "b": 2e19, "c": 0}]


def test_csv_typed(spark, tmp_path):
    df = read(spark, put(tmp_path, "t.csv", "k,n,d\na,1,1.5\nb, 2,3\n"), "csv")
    assert df.dtypes == [("k", "string"), ("n", "bigint"), ("d", "double")] and [tuple(r) for r in df.collect()] == [("a", 1, 1.5), ("b", 2, 3.0)]
    wide = read(spark, put(tmp_path, "u.csv", "k\na,9\nb\n"), "csv")
    assert [tuple(r) for r in wide.collect()] == [("a", 9), ("b", None)] and wide.columns == ["k", "col1"]


def test_csv_same_line_as_header_and_no_header(spark, tmp_path):
    assert read(spark, put(tmp_path, "t.csv", "a,b\na,b\n1,2\n"), "csv").count() == 2
    with pytest.raises(ValueError, match="header"):
        read(spark, put(tmp_path, "e.csv", "\n"), "csv")
    assert records(read(spark, put(tmp_path, "d.csv", "a,a\n1,2\n3\n"), "csv", "dynamic")) == [{"a": 2}, {"a": 3}]


def test_json_lines(spark, tmp_path):
    p = put(tmp_path, "t.jsonl", '{"a":1}\n\n5\n[1,2]\n"s"\n')
    assert records(read(spark, p, "jsonl", "dynamic")) == [{"a": 1}, {"value": 5}, {"value": [1, 2]}, {"value": "s"}]
    assert records(read(spark, p, "json", "dynamic")) == records(read(spark, p, "ndjson", "dynamic"))
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read(spark, put(tmp_path, "bad.jsonl", "{x\n"), "jsonl", "dynamic").collect()


def test_json_arrays(spark, tmp_path):
    p = put(tmp_path, "t.json", ' [{"value":"hello","n":1},{"value":"world","n":2.5}, 7]')
    assert records(read(spark, p, "json", "dynamic")) == [{"value": "hello", "n": 1}, {"value": "world", "n": 2.5}, {"value": 7}]
    typed = read(spark, put(tmp_path, "u.json", '[{"v":"a","n":1},{"v":"b"}]'), "json")
    assert sorted(typed.columns) == ["n", "v"] and sorted((r.v, r.n) for r in typed.collect()) == [("a", 1), ("b", None)]
    with pytest.raises(ValueError, match="unsupported"):
        read(spark, p, "JSON")


def recs(spark, *items):
    return spark.createDataFrame([(json.dumps(x),) for x in items], "s string").select(F.parse_json("s").alias("rec"))


def test_dynamic_operators(spark):
    df = recs(spark, {"k": "a", "v": 1, "t": ["x", {"y": "z"}]}, {"k": None}, {}, 5, {"k": "A", "v": "7"})
    up = records(dynamic.map_records(df, "uppercase"))
    assert up[0] == {"k": "A", "v": 1, "t": ["X", {"y": "Z"}]} and up[1:4] == [{"k": None}, {}, 5]
    assert records(dynamic.map_records(df, "double"))[4] == {"k": "A", "v": 14}

    def n(p):
        return dynamic.filter_records(df, p).count()

    assert [n(p) for p in ("non_empty", "has_field:k", "has_field:v", "equals:k=a", "equals:v=1", "gt:v=0", "lt:v=9")] == [2, 3, 2, 2, 0, 1, 1]
    assert records(dynamic.flat_map(recs(spark, {"tags": "a,b c"}, {"q": 1}), "split:tags")) == [{"tags": "a"}, {"tags": "b"}, {"tags": "c"}, {"q": 1}]
    assert records(dynamic.flat_map(recs(spark, {"v": [1, 2]}, {"v": []}, {"v": None}), "explode_array:v")) == [{"v": 1}, {"v": 2}, {"v": None}]
    assert records(dynamic.flat_map(recs(spark, {"b": 2, "a": 1}, {}), "json_expand")) == [{"a": 1}, {"b": 2}, {}]
    assert dynamic.reduce_records(recs(spark, {"value": 2}, {"value": 3}), "sum:value").first()[0] == 5.0
    by = dynamic.reduce_by_key(recs(spark, {"k": "a", "v": 1}, {"k": "a", "v": 2}, {"k": "b", "v": 3}), "k", "sum:v")
    assert sorted(map(tuple, by.collect())) == [("a", 3.0), ("b", 3.0)]
    with pytest.raises(Exception, match="missing key"):
        dynamic.reduce_by_key(recs(spark, {"v": 1}), "k", "sum:v", strict=True).collect()
    by = dynamic.reduce_by_key(recs(spark, {"k": 1, "v": 1}, {"k": "1", "v": 2}, {"v": 3}), "k", "sum:v")
    assert {tuple(r) for r in by.collect()} == {("1", 3.0), (None, 3.0)}
    spread = dynamic.shuffle_by_key(recs(spark, *[{"k": i % 50} for i in range(200)]), "k", 8)
    assert spread.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_dynamic_join(spark):
    left, right = recs(spark, {"k": "1", "l": 1}, {"k": "q", "l": 2}), recs(spark, {"k": 1, "r": 2})
    got = sorted(records(dynamic.join_records(left, right, "k", "left")), key=str)
    assert got == [{"left_k": "1", "left_l": 1, "right_k": 1, "right_r": 2}, {"left_k": "q", "left_l": 2, "right_missing": None}]


D = "/root/testdata/sf0.001"


def test_job_life(spark, tmp_path):
    job = Engine(spark).submit(chain(D, "nation", {"Filter": {"predicate": "gt:n_regionkey=2"}}), str(tmp_path / "out"))
    s = job.status()
    assert (s["status"], s["progress"], s["error"], s["outputs"]) == ("Succeeded", 100.0, None, [str(tmp_path / "out")])
    assert s["metrics"] == {"n1": 10} and spark.read.json(job.results()[0]).count() == 10
    assert s["tasks"]["completed_tasks"] >= 1 and s["tasks"]["failed_tasks"] == 0 and s["seconds"] > 0
    every = Engine(spark).submit(chain(D, "nation", {"Filter": {"predicate": "gt:n_regionkey=2"}}), node_metrics=True)
    assert every.metrics() == {"n0": 25, "n1": 10}


def test_failed_and_background_jobs(spark):
    engine = Engine(spark, strict=True)
    bad = engine.submit(chain(D, "nation", {"ReduceByKey": {"key": "n_nationkey", "op": "count"}}))
    assert bad.state == JobStatus.FAILED and "missing key" in bad.status()["error"]
    job = engine.submit(chain(D, "nation", "Identity"), background=True).wait(60)
    assert job.state == JobStatus.SUCCEEDED and engine.job(job.job_id) is job
    with pytest.raises(KeyError):
        engine.job("none")


def test_write_node_and_cli(spark, tmp_path, capsys):
    graph = chain(D, "region", {"Write": {"uri": str(tmp_path / "w"), "format": "csv"}})
    p = put(tmp_path, "g.json", json.dumps(graph))
    assert cli.main(["run", p]) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["status"] == "Succeeded"
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).count() == 5
    assert cli.main(["dag", p]) == 0 and "Write <- n0" in capsys.readouterr().out
    assert cli.main(["explain", p]) == 0


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a b",), ("b c b",)], "text string").write.parquet(src)
    stream = spark.readStream.schema("text string").parquet(src)
    graph = chain(D, "documents", {"FlatMap": {"func": "split:text"}}, {"ReduceByKey": {"key": "text", "op": "count"}})
    q = incremental.start(spark, graph, {"n0": stream}, "words_out")
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("words_out").collect()} == {("a", 1), ("b", 3), ("c", 1)}


def test_dynamic_map_reaches_any_depth(spark):
    deep = "x"
    for i in range(12):
        deep = {"k": deep} if i % 2 else [deep, 1, "y]\\\"}["]
    lines = [json.dumps({"a": {"b": [{"c": {"d": "x"}}]}}), json.dumps({"a": [1, deep, None, {}, []], "z": "q"}), "{}"]
    df = spark.createDataFrame([(x,) for x in lines], "j string").select(F.parse_json("j").alias("rec"))
    want = json.loads("[" + ",".join(lines).replace('"x"', '"X"').replace('"y]', '"Y]').replace('"q"', '"Q"') + "]")
    got = records(dynamic.map_records(df, "uppercase"))
    assert sorted(map(str, got)) == sorted(map(str, want))
    with pytest.raises(Exception, match="nested too deeply"):
        dynamic.map_records(df, "uppercase", 4).collect()


def test_submitted_jobs_push_filters_down_as_compiled_ones_do(spark):
    graph = chain(D, "lineitem", {"Filter": {"predicate": "gt:l_quantity=45"}})
    want = pushed(Engine(spark).compile(graph))
    assert "GreaterThan(l_quantity,45.0)" in want[0] and pushed(Engine(spark).submit(graph).to_df()) == want


def test_csv_folder_of_small_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(24):
        (folder / f"f{i:02}.csv").write_text(f"a,b\n{i},x\n")
    df = read(spark, str(folder), "csv")
    assert df.dtypes == [("a", "bigint"), ("b", "string")] and sorted(r.a for r in df.collect()) == list(range(24))
    assert len(records(read(spark, str(folder), "csv", "dynamic"))) == 24


def test_tabs_are_white_space(spark, tmp_path):
    df = read(spark, put(tmp_path, "t.csv", "a,b\n\t1 ,\xa0x\n\t\t\n2,y\n"), "csv")
    assert [tuple(r) for r in df.collect()] == [(1, "x"), (2, "y")]
    assert records(read(spark, put(tmp_path, "t.json", '\t\n [{"a":1}]'), "json", "dynamic")) == [{"a": 1}]
    assert len(records(read(spark, put(tmp_path, "t.jsonl", '{"a":1}\n\t\n\t{"a":2}\n'), "jsonl", "dynamic"))) == 2


def test_csv_keeps_quotes_and_odd_characters(spark, tmp_path):
    df = read(spark, put(tmp_path, "t.csv", 'a,b\n"x,y"\n\\"q,#z\n#c,\x01\n'), "csv")
    assert [tuple(r) for r in df.collect()] == [('"x', 'y"'), ('\\"q', "#z"), ("#c", "\x01")]


def test_job_log_outlives_the_engine(spark, tmp_path, capsys):
    folder = str(tmp_path / "log")
    job = Engine(spark, config=Config(job_log=folder)).submit(chain(D, "region", "Identity"), str(tmp_path / "o"))
    for command, want in (("status", "Succeeded"), ("progress", 100.0), ("metrics", {"n1": 5}), ("results", [str(tmp_path / "o")])):
        assert cli.main([command, job.job_id, "--log", folder]) == 0
        got = json.loads(capsys.readouterr().out)
        assert {"status": lambda: got["status"], "metrics": lambda: got["rows"]}.get(command, lambda: got)() == want
    assert cli.main(["status", "none", "--log", folder]) == 1 and cli.main(["status", "none"]) == 2
    state = JobLog(folder).get(job.job_id)
    JobLog(folder).put(job.job_id, state | {"status": "Running"})
    (again,) = Engine(spark, config=Config(job_log=folder)).recover()
    assert again.state == JobStatus.SUCCEEDED and "run again" in JobLog(folder).get(job.job_id)["error"]


def test_error_kinds_and_config(spark, tmp_path):
    with pytest.raises(DagError) as e:
        Engine(spark).submit({"nodes": []})
    assert error_kind(e.value) == ErrorKind.INVALID_GRAPH
    bad = Engine(spark, strict=True).submit(chain(D, "nation", "Identity", {"ReduceByKey": {"key": "n_nationkey", "op": "count"}}))
    assert bad.status()["error_kind"] == "Data"
    with pytest.raises(Exception) as e:
        Engine(spark).compile(chain("/nowhere", "nation", "Identity"))
    assert error_kind(e.value) == ErrorKind.NOT_FOUND
    assert Config.load(put(tmp_path, "c.json", '{"strict": true}'), {"WEFTLINE_MODE": "dynamic"}) == Config("dynamic", True)
    with pytest.raises(ValueError, match="unknown"):
        Config.load(None, {"WEFTLINE_MODE": "other"})
    with pytest.raises(ValueError, match="unknown settings"):
        Config.load(put(tmp_path, "d.json", '{"x": 1}'), {})


def test_words_break_at_any_white_space(spark):
    t = "".join(c + "w" for c in map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 44]))
    df = spark.createDataFrame([(t,), (" ,",), (None,), ("a\u200bb",)], "t string")
    got = [r[0] for r in record_wise.flat_map(df, "split:t").collect()]
    assert got == ["w"] * 26 + [" ,", None, "a\u200bb"]


def test_several_outputs_share_what_they_have_in_common(spark, tmp_path):
    ops = {"r": {"Read": {"uri": f"{D}/nation.parquet", "format": "parquet"}}, "m": {"Map": {"script": "uppercase"}}}
    ops |= {f"w{i}": {"Write": {"uri": str(tmp_path / f"w{i}"), "format": "parquet"}} for i in range(2)} | {"f": {"Filter": {"predicate": "gt:n_regionkey=2"}}}
    doc = {"nodes": [{"id": k, "operator": v} for k, v in ops.items()], "edges": [{"from": a, "to": b} for a, b in (("r", "m"), ("m", "w0"), ("m", "f"), ("f", "w1"))]}
    job = Engine(spark).submit(doc)
    assert job.state == JobStatus.SUCCEEDED and [x.schema.names for x in job._kept()] == [["n_nationkey", "n_name", "n_regionkey"]]
    assert spark.read.parquet(str(tmp_path / "w0")).count() == 25 and spark.read.parquet(str(tmp_path / "w1")).count() == 10
    assert job.metrics() == {"w0": 25, "w1": 10} and not job.frames["m"].is_cached
    assert sum(1 for _ in job.records()) in (10, 25)


def test_records_and_read_aliases(spark, tmp_path):
    p = put(tmp_path, "a.csv", "k,n\na,1\nb,\n")
    doc = {"nodes": [{"id": "r", "operator": {"read_csv": {"uri": p}}}], "edges": []}
    assert list(Engine(spark).submit(doc).records()) == [{"k": "a", "n": "1"}, {"k": "b", "n": ""}]
    assert list(Engine(spark, mode="dynamic").submit(doc).records()) == [{"k": "a", "n": 1}, {"k": "b", "n": ""}]
    assert read_jsonl(spark, put(tmp_path, "b.jsonl", '{"a":1}\n')).collect()[0].a == 1 and read_csv(spark, p).count() == 2
