"""Shared scratch tables.

Intermediate results that are read more than once are written as Parquet
under the session's ``spark.checkpoint.dir``, the folder that the driver and
all executors share.  A lost executor then costs a reread, never a recompute
of an unbounded lineage, and nothing depends on a machine-local disk.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side tables whose rows take at most this much memory are joined by
#: broadcast; larger ones take the shuffled way.
BROADCAST_BYTES = 16 * 1024 * 1024


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; only a local session without the setting gets its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = f"file://{tempfile.gettempdir()}/climekin-scratch"
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    """A path that nothing has used yet."""
    return f"{shared_dir(spark).rstrip('/')}/climekin/{label}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def memory_of(df: DataFrame) -> int:
    """Bytes that the rows of a staged table take in memory; strings, binaries and arrays of numbers are measured."""
    loose = [F.sum(F.octet_length(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    loose += [F.sum(8 * F.greatest(F.size(c), F.lit(0))) for c, kind in df.dtypes if kind.startswith("array<")]
    n, *lengths = df.agg(F.count(F.lit(1)), *loose).first()
    return n * (24 + 8 * len(df.columns)) + sum(x or 0 for x in lengths)


def small(df: DataFrame, bound: int | None = None) -> DataFrame:
    """A staged side table, marked for broadcast if it is small enough."""
    return F.broadcast(df) if memory_of(df) <= (BROADCAST_BYTES if bound is None else bound) else df


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and return it as read from there."""
    return stage_at(df, new_path(df.sparkSession, label))


def stage_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What is written meanwhile sends Python workers batches of at most so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    if before is None or not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def release_memory() -> None:
    """Give a worker's free memory back to the system; the executor's next tasks have to fit beside it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Tables:
    """Scratch tables of one operator, deleted together once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(new_path(self.spark, label))
        return stage_at(df, self.paths[-1])

    def result(self, df: DataFrame, label: str) -> DataFrame:
        """Write the result, which stays, and delete the tables behind it."""
        out = stage(df, label)
        self.drop()
        return out

    def drop(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def with_columns_free(names: list[str], taken: list[str]) -> dict[str, str]:
    """Internal column names that clash with none of the caller's columns."""
    used, out = {c.lower() for c in taken}, {}
    for n in names:
        x = f"_{n}"
        while x.lower() in used:
            x = f"_{x}"
        used.add(x.lower())
        out[n] = x
    return out
