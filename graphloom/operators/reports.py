"""Reports over merged triples and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.lexicon import Lexicon

from .resolve import is_anchor


def relation_counts(triples: DataFrame, widest: int = 1_000_000) -> DataFrame:
    """relation, n and bar, the most frequent first, ties by name. A bar has a block for each triple, or, if the longest would have
    more than `widest`, as many of them as its share."""
    counted = triples.groupBy("relation").agg(F.count("*").alias("n"))  # a row for each relation
    largest = F.max("n").over(Window.partitionBy(F.lit(0)))
    size = F.when(largest <= widest, F.col("n")).otherwise(F.ceil(F.col("n") * widest / largest))
    return counted.withColumn("size", size.cast("int")).withColumn("bar", F.expr("repeat('█', size)")).drop("size").orderBy(F.col("n").desc(), "relation")


def companies(triples: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Every head and tail once, by name, with a star for anchors."""
    names = triples.select(F.col("head").alias("company")).union(triples.select("tail")).distinct()
    return names.withColumn("star", F.when(is_anchor(F.col("company"), lexicon or Lexicon()), " ★").otherwise("")).orderBy("company")


def totals(triples: DataFrame) -> DataFrame:
    """triples, unique triples and companies."""
    ends = triples.select(F.struct("head", "relation", "tail").alias("triple"), F.posexplode(F.array("head", "tail")).alias("side", "name"))
    return ends.agg(F.count_if(F.col("side") == 0).alias("triples"), F.countDistinct("triple").alias("unique_triples"), F.countDistinct("name").alias("companies"))


def per_file(filings: DataFrame, triples: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Triples and errors of each file, files without any too."""
    out = filings.select("source_file").distinct().join(triples.groupBy("source_file").agg(F.count("*").alias("triples")), "source_file", "left")
    if errors is not None:
        out = out.join(errors.groupBy("source_file").agg(F.count("*").alias("errors")), "source_file", "left")
    return out.na.fill(0)
