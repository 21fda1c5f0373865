"""Staged results: frames that several later plans read, written once to the shared folder.

Inside a scope() they are deleted when it ends; call it around a read of the result, as a lazily read frame needs them.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_own = threading.local()  # paths made in each open scope of this thread


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder; others raise."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ragloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/ragloom/{tag}-{uuid.uuid4().hex}"
    if scopes := getattr(_own, "scopes", None):
        scopes[-1].append(path)
    return path


def spread(frame: DataFrame, *by: str, ranges: bool = False) -> DataFrame:
    """frame dealt out by columns, or ranges of them, to the session's tasks where it comes from fewer files, which few tasks would read.

    Large inputs have more files than the session has tasks, and stay as they are: no shuffle.
    """
    tasks = frame.sparkSession.sparkContext.defaultParallelism
    if len(frame.inputFiles()) >= tasks:
        return frame
    return frame.repartitionByRange(tasks, *by) if ranges else frame.repartition(tasks, *by)


def pieces(parts: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most `rows` rows: what Python makes of one goes before the next, however large batches are."""
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)


def staged(frame: DataFrame, tag: str) -> DataFrame:
    """frame written as Parquet and read again: computed once, and safe from lost executors."""
    path = new_path(frame.sparkSession, tag)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def at_once(spark: SparkSession, jobs: list[Callable]) -> list:
    """The results of functions that run Spark jobs and do not need each other: one's tasks fill the slots that another's leave."""
    shared_dir(spark)
    scopes = getattr(_own, "scopes", None)

    def within(job: Callable):
        if scopes:
            _own.scopes = scopes
        return job()

    with ThreadPoolExecutor(len(jobs)) as pool:
        made = [pool.submit(inheritable_thread_target(spark)(lambda job=job: within(job))) for job in jobs]
        return [m.result() for m in made]


def place(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    system, own = place(spark, path)
    return system.exists(own)


def length(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    system, own = place(spark, path)
    return system.getContentSummary(own).getLength()


def delete(spark: SparkSession, path: str) -> None:
    system, own = place(spark, path)
    system.delete(own, True)


@contextmanager
def scope(spark: SparkSession):
    """Everything staged inside goes at the end."""
    _own.scopes = [*getattr(_own, "scopes", []), []]
    try:
        yield
    finally:
        for path in _own.scopes.pop():
            delete(spark, path)
