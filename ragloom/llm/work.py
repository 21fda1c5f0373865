"""Shared plumbing of the corpus operators: work tables, Arrow batches and partition counts."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own = threading.local()  # scopes, readers: lists of the paths made in each open scratch() and until_read() of this thread
_model: list = [None, None]  # name and value of the one model that a Python worker holds


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master gets a temporary one; others raise."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ragloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/ragloom/{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def no_shuffle_left(spark: SparkSession):
    """Shuffle files of the writes inside go when each is done, as nothing but the written table is read later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(df: DataFrame, tag: str, stays: bool = False) -> DataFrame:
    """df written as a Parquet work table and read again: it cuts lineage and survives lost executors.

    Inside a scratch() scope the table goes with the scope, unless it stays; one that stays goes with until_read().
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    scopes, readers = getattr(_own, "scopes", None), getattr(_own, "readers", None)
    if scopes and not stays:
        scopes[-1].append(path)
    elif readers:
        left_for_reader(path)
    with no_shuffle_left(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Work tables made inside are deleted at the end; what is returned from inside must be a table that stays."""
    _own.scopes = [*getattr(_own, "scopes", []), []]
    try:
        yield
    finally:
        for path in _own.scopes.pop():
            delete(spark, path)


def left_for_reader(path: str) -> None:
    """The folder is needed until the result is read: the open until_read(), if there is one, deletes it."""
    if readers := getattr(_own, "readers", None):
        readers[-1].append(path)


@contextmanager
def until_read(spark: SparkSession):
    """Tables that operators called inside leave for their results are deleted at the end: read or write the results inside."""
    _own.readers = [*getattr(_own, "readers", []), []]
    try:
        yield
    finally:
        for path in _own.readers.pop():
            delete(spark, path)


def remove(spark: SparkSession, frame: DataFrame) -> None:
    """Delete a work table that no later plan reads."""
    for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()[:1]}:
        delete(spark, folder)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def batches(batch_iter, size: int = 512):
    """Arrow batches cut to at most `size` rows, so that Python holds few texts at a time."""
    for batch in batch_iter:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def without_collector(run):
    """run with Python's cyclic collector off until it ends: for code that makes no cycles but keeps many objects.

    What it keeps is then frozen, so that the collector does not visit it later; it still goes when nothing holds it.
    """

    def quiet(batch_iter):
        gc.disable()
        try:
            yield from run(batch_iter)
        finally:
            gc.freeze()
            gc.enable()

    return quiet


def held(name, make):
    """The named model of this worker, made once. A worker holds one: that of another operator goes, with its caches."""
    if _model[0] != name:
        _model[:] = [None, None]
        _model[:] = [name, make()]
    return _model[1]


def forget() -> None:
    """Let go of the model of an operator that ran in this worker before."""
    _model[:] = [None, None]
