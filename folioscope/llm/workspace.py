"""Tables in the shared folder, to cut lineage: they outlive lost executors.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (as in tests on one
machine) is a folder of our own set.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of text that go to a Python worker at once, at most (one longer row goes alone).
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches for this session, so that an executor's memory holds few texts at once outside its heap; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        size = int("".join(c for c in now if c.isdigit() or c == "-")) if now else 0
        if not (now and now.lstrip("-").isdigit() and 0 < size <= most):
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, with memory that a batch left free given back before the next, so that idle workers stay small."""
    def tidy(batches):
        yield from run(_returning(batches))

    return df.mapInArrow(tidy, schema)


def _returning(batches):
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


def _find_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another allocator than glibc's
        return None


_trim = _find_trim()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet in the shared folder and read from there."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return held_in(spark.read.schema(df.schema).parquet(path), path)


_folders: dict[int, str] = {}


def held_in(df: DataFrame, path: str) -> DataFrame:
    """``df``, with a note that it is read from a path of :func:`folder`, for :func:`discard`."""
    _folders[id(df._jdf)] = path
    return df


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads; others are left alone."""
    for df in tables:
        path = _folders.pop(id(df._jdf), None)
        if path:
            dropped(df.sparkSession, path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a path of :func:`folder` that no later plan reads."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
