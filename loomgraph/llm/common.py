"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextvars
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests, one machine) gets one here; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. Whatever is there when the driver ends goes with it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(of)
    return path


_noted: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("noted", default=None)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns; of what stored() wrote meanwhile, only what this still reads is kept. Nothing that another call wrote is touched."""
    mine: list[str] = []
    token, read = _noted.set(mine), ""
    try:
        out = make()
        read = "\n".join(out.inputFiles())
    finally:
        _noted.reset(token)
        for x in mine:
            if x.rpartition("/")[2] not in read:
                _delete(spark, x)
    return out


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: it cuts the lineage, survives lost executors, and gives the planner true sizes."""
    spark = df.sparkSession
    path = fresh_path(spark, "stage")
    if (mine := _noted.get()) is not None:
        mine.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes what stored() wrote, once no plan reads it any more."""
    for df in frames:
        _delete(df.sparkSession, df.stored_at)


def release() -> None:
    """Gives what this Python worker has freed back to the system: workers outlive their stages and share an executor's memory with its heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, after which a worker gives back what each partition has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)
