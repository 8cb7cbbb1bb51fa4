"""Reading filings and triples, and writing triples, errors and results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from graphloom.functions.schemas import ENVELOPE, ERRORS, TRIPLE

from .ledger import qualified
from .store import BucketStore


def filings(spark: SparkSession, folder: str, glob: str = "*_2023.txt") -> DataFrame:
    """(source_file, text): whole files, in no order. A missing folder, or no file in it, gives an empty table."""
    kind = T.StructType([T.StructField("source_file", T.StringType()), T.StructField("text", T.StringType())])
    try:
        read = spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)
    return read.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))


def write_filings(df: DataFrame, folder: str) -> None:
    """A file for each row (source_file, text), in UTF-8; a task that runs again writes the same files again."""
    where = qualified(df.sparkSession, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(batch["source_file"], batch["text"], strict=True):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    df.select("source_file", "text").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def triples(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """Triples of an envelope {"total", "triples"}, with ord. A missing file is an error unless missing_ok; so is an envelope
    whose triples are no list."""
    try:
        read = spark.read.schema(ENVELOPE).option("multiLine", True).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if missing_ok:
            return spark.createDataFrame([], f"{TRIPLE}, extractor string, ord int")
        raise FileNotFoundError(path) from error
    if not read.filter(F.col("triples").isNull()).isEmpty():
        raise ValueError("the file has no list of triples")
    return read.select(F.posexplode("triples").alias("ord", "t")).select("t.*", "ord")


def triple_store(spark: SparkSession, path: str) -> BucketStore:
    """The triples of one extractor, by source_file: a file's rows are replaced as a whole, and there is no folder for each file."""
    return BucketStore(spark, path, ("source_file",))


def stored_triples(spark: SparkSession, path: str) -> DataFrame:
    """What a triple_store() holds, with ord; an empty table before anything was written."""
    kind = spark.createDataFrame([], f"{TRIPLE}, ord struct<source_file:string,sent_pos:int,pos:int>").schema
    return triple_store(spark, path).read(kind)


def error_store(spark: SparkSession, path: str) -> BucketStore:
    """Errors by source_file: those of files that a batch doesn't hold stay, and a batch that comes again adds none twice."""
    return BucketStore(spark, path, ("source_file",))


def write_envelope(df: DataFrame, path: str, order: list) -> None:
    """Triples as one JSON document with their number. For exports: all of them meet in one row; keep Parquet inside."""
    columns = [c for c in ("head", "relation", "tail", "confidence", "source_file", "source_sentence", "extractor") if c in df.columns]
    rows = df.select(F.struct(*order).alias("o"), F.struct(*columns).alias("t")).agg(F.array_sort(F.collect_list(F.struct("o", "t"))).alias("rows"))
    body = F.struct(F.size("rows").alias("total"), F.transform("rows", lambda r: r["t"]).alias("triples"))
    rows.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_errors(df: DataFrame, path: str, done: DataFrame | None = None, batch: int | None = None) -> None:
    """The errors of the files in done (source_file; without it, of those that have errors) are replaced; all others stay."""
    rows = df.select(*[f.split()[0] for f in ERRORS.split(", ")])
    error_store(df.sparkSession, path).replace(rows, rows if done is None else done, batch)


def write_by_file(df: DataFrame, path: str, done: DataFrame | None = None, batch: int | None = None) -> None:
    """The triples of the files in done (source_file; without it, of those that have triples) are replaced, so a crash loses no other."""
    triple_store(df.sparkSession, path).replace(df, df if done is None else done, batch)


def write_copies(df: DataFrame, paths: list[str], write) -> None:
    """The same rows to several places, made once."""
    kept = df.persist()
    try:
        for path in paths:
            write(kept, path)
    finally:
        kept.unpersist()


def write_csv(df: DataFrame, path: str) -> None:
    """A result table with a header; texts may span lines."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
