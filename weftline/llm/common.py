"""What several operators share: cutting lineage, fixed-size key filters, batch plumbing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as Spark's translate() takes it.
BLANKS = " \t\n\x0b\x0c\r"

#: Bytes of one bitmap of bitmap_construct_agg, and the positions that it holds.
BITMAP_BYTES = 4096
BITMAP_BITS = 8 * BITMAP_BYTES


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="weftline-"))
    return configured or sc.getCheckpointDir()


_TO_CLEAN: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Compute now and keep the rows in the shared folder, where they survive lost executors.

    The session's own folder of checkpoints goes when Python ends; a session that sets
    spark.cleaner.referenceTracking.cleanCheckpoints drops each one as its frame goes.
    """
    spark = df.sparkSession
    shared_dir(spark)
    at = spark.sparkContext.getCheckpointDir()
    if at not in _TO_CLEAN:
        _TO_CLEAN.add(at)
        _delete_at_exit(spark, at)
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, wherever it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            delete(spark, path)

    atexit.register(drop)


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, removed when Python ends if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    return path


class Kept:
    """A table written to the shared folder, smaller than a checkpoint of wide rows.

    ``drop()`` removes it once nothing lazy depends on it; else it goes when Python ends.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = own_folder(self.spark, "kept")
        df.write.parquet(self.path)
        self.df = self.spark.read.parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no frame can read any more.

    Spark does so when the driver's JVM collects its garbage, which may be long after.
    """
    gc.collect()
    spark._jvm.System.gc()


def slot(bits: int, *cols: Column) -> Column:
    """The position of a key in a filter of so many bits, counted from 1."""
    return F.pmod(F.xxhash64(*cols), F.lit(bits)) + 1


def bitmap(slots: DataFrame, name: str, repeated: bool = False) -> DataFrame:
    """The set of the positions in column ``name``, as at most bits / 32768 rows of 4 KB.

    With ``repeated``, only positions that at least two rows have.
    """
    seen = slots.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    if repeated:
        seen = seen.where("n > 1")
    return seen.groupBy(F.bitmap_bucket_number(name).alias("bm_no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(name)).alias("bm"))


def mark(df: DataFrame, position: Column, bitmaps: DataFrame, flag: str) -> DataFrame:
    """Adds a boolean: whether the row's position is in the filter.

    The filter is broadcast: its size is bounded by the number of bits it was made with.
    """
    at, no, bits = fresh(df, "position", "bm_no", "bm")
    out = df.withColumn(at, position)
    out = out.join(F.broadcast(bitmaps.toDF(no, bits)), F.bitmap_bucket_number(at) == F.col(no), "left")
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col(bits), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return out.withColumn(flag, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop(at, no, bits)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns to add that clash with none that ``df`` has."""
    taken, tail = {c.lower() for c in df.columns}, "__"
    while any(f"__{n}{tail}".lower() in taken for n in names):
        tail += "_"
    return [f"__{n}{tail}" for n in names]


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


#: What drops the caches that an operator keeps in this Python worker from task to task.
_HELD: dict[str, Callable[[], None]] = {}


def begin(owner: str = "", drop: Callable[[], None] | None = None) -> None:
    """To be called where a task's Python begins: drops what other operators have left here.

    Workers serve one stage after the other, and caches that pay while a stage lasts would
    stand in the way of the next.
    """
    others = [k for k in _HELD if k != owner]
    for k in others:
        _HELD.pop(k)()
    if others:
        gc.collect()
    # what was freed goes back to the system, which the JVM beside this worker needs
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other than glibc
        ctypes.CDLL(None).malloc_trim(0)
    if drop:
        _HELD[owner] = drop


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], owner: str = "", drop: Callable[[], None] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function out of one for a single batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner, drop)
        for b in slices(batches):
            if (out := fn(b)) is not None:
                yield out

    return run


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Send rows to Python in batches of so many at most, from now on in this session.

    Texts are long: Spark's 10,000 rows are tens of MB in the JVM and again in Python.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that Python holds few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def texts(column: pa.Array) -> list[str]:
    """Python strings; a null is empty."""
    return [x or "" for x in column.to_pylist()]


def drop_ids(df: DataFrame, id_col: str, ids: DataFrame, bits: int = 1 << 24) -> DataFrame:
    """Rows whose id is not in the one column of ``ids``.

    Rows that a filter of fixed size shows to be safe are not shuffled.
    """
    name, maybe = fresh(df, "gone", "maybe")
    gone = ids.toDF(name).distinct()
    filt = bitmap(gone.select(slot(bits, F.col(name)).alias("at")), "at")
    rows = mark(df, slot(bits, F.col(quoted(id_col))), filt, maybe)
    safe = rows.where(~F.col(maybe)).drop(maybe)
    rest = rows.where(F.col(maybe)).drop(maybe).join(gone, F.col(quoted(id_col)) == F.col(name), "left_anti")
    return safe.unionByName(rest)
