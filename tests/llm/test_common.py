from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import common


def test_caches_of_other_operators_go():
    gone = []
    common.begin("a", lambda: gone.append("a"))
    common.begin("a", lambda: gone.append("a"))
    assert gone == []
    common.begin("b", lambda: gone.append("b"))
    assert gone == ["a"]
    common.begin()
    assert gone == ["a", "b"]
    common.begin()
    assert gone == ["a", "b"]


def test_slices_keep_all_rows():
    b = pa.RecordBatch.from_pydict({"x": list(range(1100))})
    parts = list(common.slices(iter([b, b.slice(0, 0)])))
    assert [p.num_rows for p in parts] == [512, 512, 76] and [x for p in parts for x in p.column(0).to_pylist()] == list(range(1100))


def test_added_names_never_clash(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "__position__ int, `__bm__` string, `__bm_no__` int")
    where = common.slot(64, F.col("__position__"))
    filt = common.bitmap(df.where("`__position__` = 1").select(where.alias("at")), "at")
    out = common.mark(df, where, filt, "seen")
    assert out.columns == [*df.columns, "seen"] and {r[0] for r in out.where("seen").collect()} >= {1}
    assert common.fresh(df, "bm") != ["__bm__"]


def test_no_local_folder_on_a_cluster():
    def session(master, checkpoint):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: checkpoint))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("yarn", None))
    assert common.shared_dir(session("yarn", "hdfs://x/y")) == "hdfs://x/y"
