"""A ledger of answers to prompts: tasks write each answer ahead of anything else, so that no prompt is paid for twice.

Under a folder, `ahead` holds what tasks write while they call (lines of JSON, one file or more for each attempt), `kept` what ended
runs have folded into Parquet. A prompt's key is a hash of it and of a scope, which names what else an answer depends on.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .storage import materialize

SCHEMA = "key string, response string, error string, end int"


def key_of(prompt: Column, scope: str) -> Column:
    return F.sha2(F.concat(F.lit(scope + "\n"), prompt), 256)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark resolves it, in the form that pyarrow reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file:///") else full


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).format(kind).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def calls(spark: SparkSession, path: str) -> DataFrame:
    """A row for each call that the ledger has: key, response, error. A line that a crash cut short is no row."""
    return _read(spark, f"{path}/kept", "parquet").unionByName(_read(spark, f"{path}/ahead", "json")).filter("end = 1").drop("end")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each key: an answer rather than an error, the first by text of several."""
    best = F.min(F.struct(F.col("error").isNotNull().alias("bad"), "response", "error")).alias("best")
    return calls(spark, path).groupBy("key").agg(best).select("key", "best.response", "best.error")


class Pace:
    """One rate for all tasks: of `callers` tasks this one has every callers-th slot of a common schedule. A task that is late goes on
    from where it is, so in any time all tasks together make at most rate calls a second and one more each."""

    def __init__(self, rate: float, callers: int, mine: int, start: float, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.next, self.clock, self.sleep = callers / rate, start + mine / rate, clock, sleep

    def wait(self) -> None:
        now = self.clock()
        if now < self.next:
            self.sleep(self.next - now)
        self.next = max(self.next, now) + self.gap


class _Ahead:
    """What attempts at one part of a run write, and what earlier ones have written."""

    def __init__(self, folder: str, name: str, per_file: int):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.name, self.per_file, self.out, self.lines = name, per_file, None, 0

    def done(self) -> set[str]:
        found = set()
        for info in self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True)):
            if info.base_name.startswith(self.name):
                with self.store.open_input_stream(info.path, compression=None) as read:
                    for line in read.read().split(b"\n")[:-1]:
                        found.add(json.loads(line)["key"])
        return found

    def write(self, key: str, response: str, error: str | None) -> None:
        if self.out is None:
            self.out, self.lines = self.store.open_output_stream(f"{self.root}/{self.name}{uuid.uuid4().hex}.json", compression=None), 0
        self.out.write((json.dumps({"key": key, "response": response, "error": error, "end": 1}) + "\n").encode())
        self.out.flush()
        self.lines += 1
        if self.lines >= self.per_file:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def ask(asked: DataFrame, make: Callable[[], Callable[[str], str]], answer: Callable[[Callable[[str], str], str], tuple[str, str | None]], path: str, *, scope: str = "", rate: float | None = None, callers: int = 8, per_file: int = 50, again: bool = True) -> DataFrame:
    """asked (with prompt) and response and error of its prompt from the ledger under path, after what the ledger lacks was asked.

    Each distinct prompt is called once, whatever rows, stages, retries of tasks and runs need it: answers that the ledger has are
    joined away before; a task that runs again skips what its earlier attempts wrote; a run that was broken off leaves what it wrote
    to the next. Errors count as no answer in the next run, unless `again` is false. answer(call, prompt) is the response and no
    error, or "" and an error. callers tasks call at once, with rate calls a second among them, retries included. Where files can't
    be read before they are closed, a crash repeats up to per_file calls of each task; speculative execution isn't guarded against.
    Rows with a null prompt get nulls.
    """
    spark = asked.sparkSession
    folder, run_id, start = qualified(spark, path), uuid.uuid4().hex, time.time()
    keyed = asked.withColumn("__key", key_of(F.col("prompt"), scope))
    known = answers(spark, path)
    lacking = keyed.filter(F.col("prompt").isNotNull()).groupBy(F.col("__key").alias("key")).agg(F.first("prompt").alias("prompt"))
    # Written first: the parts of the run must not change while the ledger grows.
    todo = materialize(lacking.join(known.filter("error IS NULL") if again else known, "key", "left_anti"), "asked")

    def call_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = TaskContext.get().partitionId()
        ahead = _Ahead(f"{folder}/ahead", f"{run_id}-{mine}-", per_file)
        call, pace = make(), Pace(rate, callers, mine, start) if rate else None

        def paced(prompt: str) -> str:
            if pace:
                pace.wait()
            return call(prompt)

        done, n = ahead.done(), 0
        try:
            for batch in batches:
                for key, prompt in zip(batch["key"], batch["prompt"], strict=True):
                    if key not in done:
                        ahead.write(key, *answer(paced, prompt))
                        n += 1
        finally:
            ahead.close()
        yield pd.DataFrame({"n": [n]})

    if not todo.isEmpty():
        store, root = fs.FileSystem.from_uri(f"{folder}/ahead")
        store.create_dir(root, recursive=True)
        todo.repartition(callers, "key").mapInPandas(call_all, "n long").agg(F.sum("n")).collect()
        fold(spark, path)
    found = answers(spark, path).withColumnRenamed("key", "__key")
    return keyed.join(found, "__key", "left").drop("__key")


def fold(spark: SparkSession, path: str) -> None:
    """Moves what tasks wrote ahead into Parquet, so that the number of files stays small. A crash between the two leaves rows twice,
    which answers() takes once. Not to be called while another run writes to the same ledger."""
    store, root = fs.FileSystem.from_uri(f"{qualified(spark, path)}/ahead")
    there = [i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.is_file]
    if there:
        rows = _read(spark, f"{path}/ahead", "json").filter("end = 1")
        rows.coalesce(max(1, len(there) // 100)).write.mode("append").parquet(f"{path}/kept")
        for file in there:
            store.delete_file(file)
