"""Work on new files only: a ledger of processed files, or a stream over a folder with a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pending(filings: DataFrame, ledger: DataFrame) -> DataFrame:
    """The filings whose source_file the ledger doesn't have. The ledger names files, not triples: one without triples is done too."""
    return filings.join(ledger.select("source_file").distinct(), "source_file", "left_anti")


def pending_by_triples(filings: DataFrame, triples: DataFrame) -> DataFrame:
    """The filings without a triple yet: one that gives none comes again in every run."""
    return pending(filings, triples)


def process_new(spark: SparkSession, folder: str, checkpoint: str, work: Callable[[DataFrame, int], None], glob: str = "*_2023.txt") -> None:
    """Calls work(filings, batch) on the files that came since the last run, each once, and ends when there are no more."""
    read = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(folder)
    named = read.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))
    named.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
