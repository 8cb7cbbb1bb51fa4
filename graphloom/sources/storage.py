"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and all runs on this machine, a temporary folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="graphloom-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        found = f"file://{_own[0]}"
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share; it goes when the driver's JVM ends."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    delete_at_exit(spark, folder)
    return folder


#: The folders of each scratch() that is open here: threads have scopes of their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the intermediate tables that were written within it, but for those that are taken off its list (the latest is the last).
    For what is needed no more once a result is written; it must not be read lazily later."""
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield made
    finally:
        _scopes.reset(token)
        for folder in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """Has the file system delete an existing folder when the driver's JVM ends, if not before."""
    if scopes := _scopes.get():
        scopes[-1].append(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again, so that what follows doesn't make it anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of some tens of bytes that a join may send to all executors.
BROADCAST_ROWS = 200_000


def sized(rows: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows written and counted: marked for broadcast if there are at most `most` of them, else left to a shuffled join."""
    made = materialize(rows, name)
    return F.broadcast(made) if made.count() <= most else made
