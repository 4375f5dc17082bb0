"""What the corpus operators share: words, shared storage, worker-side shipping."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The six ASCII blanks that separate words; bytes.split() splits on the same set.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def ship_by_value(module: str) -> None:
    """Pickle a module's functions by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def give_back() -> None:
    """Hand the memory that this process has freed back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function ``run`` for ``mapInArrow``, after which the worker gives back what it no longer holds.

    Workers outlive their tasks, and allocators keep what is freed: else each of an
    executor's workers stays as large as the largest task that it ever had.
    """

    def lean_run(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Array of the blank-separated words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_CLASS + "+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir.

    Where that is unset, a temporary folder serves in local mode; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="alertloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    The folder is removed by ``remove_written``, or else when the driver's Python ends.
    """
    path = f"{shared_dir(spark)}/alertloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    # What this job shuffled is garbage now; a collection lets Spark's cleaner delete it before the next job adds its own.
    spark.sparkContext._jvm.java.lang.System.gc()
    atexit.register(_remove, spark, path)
    stored = spark.read.schema(schema).parquet(path)
    stored.written_to = path
    return stored


def remove_written(*stored: DataFrame) -> None:
    """Delete what ``written`` stored, once nothing reads it any more; takes the frames that it returned."""
    for frame in stored:
        _remove(frame.sparkSession, frame.written_to)


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _place(columns: list[str], name: str) -> int:
    """Where a column stands: spelled the same, or else in other letter case; the first of several."""
    for fits in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, column in enumerate(columns):
            if fits(column):
                return i
    raise ValueError(f"column {name!r} is missing among {columns}")


def checked_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by place, so that extra columns can't interfere whatever their names.

    Raises ValueError where one is missing.
    """
    by_place = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return by_place.select(*[F.col(f"c{_place(df.columns, n)}").alias(n) for n in names])


def sheltered(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The frame with the named columns under just these names, all others under names that no operator uses.

    Also a function that takes a frame with these columns back to the original ones, in order.
    """
    old = df.columns
    given = {_place(old, n): n for n in names}
    held = [given.get(i, f"own {i}") for i in range(len(old))]
    return df.toDF(*held), lambda done: done.select(*[F.col(f"`{c}`") for c in held]).toDF(*old)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """32 bytes that tell rows of different doc_id or text apart; null and empty texts count as the same."""
    parts = [F.col(doc_id).isNull().cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)]
    return F.unhex(F.sha2(F.concat_ws("|", *parts), 256))


ship_by_value(__name__)
