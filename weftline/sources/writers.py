"""Sinks: JSON lines as the default, CSV and Parquet beside it."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("jsonl", "json", "csv", "parquet")


def write(df: DataFrame, uri: str, fmt: str = "jsonl") -> str:
    """Write ``df`` as a folder of part files, replacing what is there; returns ``uri``."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format '{fmt}'")
    out = df.write.mode("overwrite")
    if fmt == "parquet":
        out.parquet(uri)
    elif fmt == "csv":
        out.option("header", True).csv(uri)
    elif df.dtypes == [("rec", "variant")]:
        df.select(F.to_json("rec").alias("value")).write.mode("overwrite").text(uri)
    else:
        out.option("ignoreNullFields", False).json(uri)
    return uri


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share; it is deleted when Python ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="weftline-")
    folder = f"{shared}/scratch-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)

    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    atexit.register(drop)
    return folder
