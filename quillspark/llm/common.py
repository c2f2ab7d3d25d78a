"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word and normalisation contract, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tables of this process that nothing has released yet.
_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary
    one (local runs and tests only) where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, n_files: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost
    executors, and is read back column by column."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
    (df.coalesce(n_files) if n_files else df).write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(*tables: DataFrame) -> None:
    """Removes tables that ``written`` gave and that nothing reads again."""
    for t in tables:
        at = getattr(t, "written_at", None)
        if spark := _written.pop(at, None):
            _delete(spark, at)


@atexit.register
def _forget() -> None:
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing can be removed through it
            return


def few(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df``, a written table of narrow rows, broadcast if it has no more than so many."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: The C library's call that returns free memory to the system, where it has one.
_malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with free memory returned to the system after each batch and at the end:
    workers are reused, and would keep what one stage freed while others need it."""

    def returning(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield part
            del part
            _give_back()

    def thrifty_run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(returning(parts))
        finally:
            _give_back()

    return thrifty_run


def thrifted(result: pa.Table) -> pa.Table:
    """A group's result, with free memory returned to the system likewise."""
    _give_back()
    return result


def relax(spark: SparkSession) -> None:
    """Has the executors' engines return free heap to the system, so that a stage does not
    start beside what the one before left. Requests that meet in an executor are one."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def pieces(parts: Iterator[pa.RecordBatch], at: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose strings of column ``at`` have about so many bytes
    (at least a row), so that what a worker holds beside a batch does not grow with it."""
    for part in parts:
        ends = pa.compute.cumulative_sum(pa.compute.fill_null(pa.compute.binary_length(part.column(at)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        start = 0
        while start < part.num_rows:
            stop = max(start + 1, int(ends.searchsorted((ends[start - 1] if start else 0) + size, side="right")))
            yield part.slice(start, stop - start)
            start = stop
        if not part.num_rows:
            yield part
