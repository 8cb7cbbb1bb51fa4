"""Positions in spans, and names in texts, found by equi-joins of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.storage import sized


def containing(points: DataFrame, spans: DataFrame, *, key: list[str], by: list[str], at: str, start: str, end: str, order: list[str], take: list[str]) -> DataFrame:
    """points (whose columns `key` tell them apart) with the columns `take` of the first span, by the columns `order`, that has the
    same `by` and start <= at < end; nulls where there is none. Empty spans hold nothing.

    A span is listed in bins of the next power of two, at most two of them whatever its length; a point looks into its bin of each
    such width that occurs, at most 64, so both meet by key, width and bin, and only what a bin holds is compared.
    """
    long = F.col(end) - F.col(start)
    wide = spans.filter(long > 0).withColumn("__level", F.when(long == 1, 0).otherwise(F.length(F.bin(long - 1))).cast("int"))
    bins = F.array_distinct(F.array(F.expr(f"shiftright({start}, __level)"), F.expr(f"shiftright({end} - 1, __level)")).cast("array<long>"))
    listed = wide.select(*by, *dict.fromkeys([*order, *take]), F.col(start).alias("__start"), F.col(end).alias("__end"), "__level", F.explode(bins).alias("__bin"))
    levels = sorted(r["__level"] for r in wide.select("__level").distinct().collect())
    looking = points.select(*key, *[b for b in by if b not in key], F.col(at).alias("__at"), F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("__level"))
    looking = looking.withColumn("__bin", F.expr("shiftright(__at, __level)").cast("long"))
    hits = looking.join(listed, [*by, "__level", "__bin"]).filter("__start <= __at AND __at < __end")
    first = hits.groupBy(*key).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("__span"))
    return points.join(first, key, "left").withColumns({t: F.col("__span")[t] for t in take}).drop("__span")


def occurrences(texts: DataFrame, text: str, key: list[str], names: DataFrame, name: str) -> DataFrame:
    """The columns `key` of texts, all columns of names and pos (the first place, from 1) for each name that a text holds. Empty names
    are in no text. Case counts. Names are looked up by length and hash, at every place of a text and for every length that a name
    has, and then compared; names come as rows, so a common beginning is no common key."""
    known = names.filter(F.length(name) > 0).withColumn("__size", F.length(name)).withColumn("__hash", F.xxhash64(name))
    sizes = sorted(r["__size"] for r in known.select("__size").distinct().collect())  # no more than the longest name has characters
    places = F.transform(F.sequence(F.lit(1), F.length(text) - F.col("__size") + 1), lambda p: F.struct(p.alias("pos"), F.substring(F.col(text), p, F.col("__size")).alias("__part")))
    looking = texts.select(*key, text, F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("__size")).filter(F.length(text) >= F.col("__size"))
    looking = looking.select(*key, "__size", F.inline(places)).withColumn("__hash", F.xxhash64("__part"))
    hits = looking.join(sized(known, "names"), ["__size", "__hash"]).filter(F.col("__part") == F.col(name))
    return hits.groupBy(*key, *names.columns).agg(F.min("pos").alias("pos"))
