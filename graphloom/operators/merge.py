"""Merging the triples of several extractors into one set with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.lexicon import Lexicon
from graphloom.functions.text import ticker

from . import ranges
from .ranges import ranged, running
from .resolve import Names, filer_table, flagged

KEY = ("head", "relation", "tail")


def normalize_relation(df: DataFrame) -> DataFrame:
    """customer_of(A, B) becomes supplier_of(B, A); other relations stay."""
    turn = F.col("relation") == "customer_of"
    changed = {"head": F.when(turn, F.col("tail")).otherwise(F.col("head")), "tail": F.when(turn, F.col("head")).otherwise(F.col("tail")), "relation": F.when(turn, F.lit("supplier_of")).otherwise(F.col("relation"))}
    return df.withColumns(changed)


def union_extractors(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Triples with their order columns, the name and rank of their extractor."""
    out = None
    for rank, (name, df) in enumerate(parts):
        part = df.withColumn("extractor", F.lit(name)).withColumn("extractor_ord", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def reject_reason(lexicon: Lexicon) -> Column:
    """The first reason against a triple of resolved names, from head, tail, relation and the flags of both names; null if there is none."""
    head, tail, relation = F.col("head"), F.col("tail"), F.col("relation")
    h, t = F.col("__head_anchor"), F.col("__tail_anchor")
    return (
        F.when(head.isNull() | tail.isNull() | (head == "") | (tail == ""), "no_entity")
        .when(head == tail, "self_loop")
        .when(~F.coalesce(relation.isin(*lexicon.relations), F.lit(False)), "bad_rel")
        .when(~h & ~t, "no_anchor")
        .when((~h & ~F.col("__head_valid")) | (~t & ~F.col("__tail_valid")), "bad_entity")
    )


def judge(triples: DataFrame, lexicon: Lexicon) -> DataFrame:
    """triples with head and tail resolved (raw_head and raw_tail keep the old ones), filer, confidence 0.5 where null, and reason.
    Each distinct name is resolved once; triples only look it up."""
    spark = triples.sparkSession
    raw = triples.withColumnRenamed("head", "raw_head").withColumnRenamed("tail", "raw_tail")
    names = Names(raw.select(F.explode(F.array("raw_head", "raw_tail")).alias("name")), lexicon)
    filers = flagged(filer_table(spark, lexicon.filers), "filer", lexicon).select("ticker", "filer", F.struct("anchor", "valid").alias("__filer"))
    found = raw.withColumn("ticker", ticker(F.col("source_file"))).join(F.broadcast(filers), "ticker", "left").drop("ticker")
    found = found.withColumn("filer", F.coalesce("filer", F.lit("")))
    for side in ("head", "tail"):
        found = names.attach(found, f"raw_{side}", "__is")
        own = F.col("__is.pronoun") & (F.col("filer") != "")
        flags = {f"__{side}_{flag}": F.coalesce(F.when(F.col("__is.pronoun"), F.col("__filer")[flag]).otherwise(F.col("__is")[flag]), F.lit(False)) for flag in ("anchor", "valid")}
        found = found.withColumns({side: F.when(own, F.col("filer")).otherwise(F.col("__is.entity")), **flags}).drop("__is")
    judged = found.withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).withColumn("reason", reject_reason(lexicon))
    return judged.drop("__filer", "__head_anchor", "__head_valid", "__tail_anchor", "__tail_valid")


def keep_best(judged: DataFrame, order: tuple[str, ...] = ("extractor_ord", "ord")) -> DataFrame:
    """One row of each (head, relation, tail) without a reason against it: the highest confidence, the first of equals. first_ord
    holds the key's first place. Tasks keep the best of what they read before it is shuffled, so a triple with very many rows is no
    hot key."""
    good = judged.filter(F.col("reason").isNull())
    rest = [c for c in good.columns if c not in KEY]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("confidence"), *order))
    kept = good.groupBy(*KEY).agg(best.alias("__best"), F.min(F.struct(*order)).alias("first_ord"))
    return kept.select(*[F.col(c) if c in KEY else F.col("__best")[c].alias(c) for c in good.columns], "first_ord")


def state_rows(judged: DataFrame, order: tuple[str, ...] = ("extractor_ord", "ord")) -> DataFrame:
    """keep_best() of some triples, as a state that combine() adds others to."""
    return keep_best(judged, order).drop("reason")


def combine(states: DataFrame, order: tuple[str, ...] = ("extractor_ord", "ord")) -> DataFrame:
    """One state of several: of each triple the best row and the first place. States may come in any order and more than once."""
    rest = [c for c in states.columns if c not in (*KEY, "first_ord")]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("confidence"), *order))
    kept = states.groupBy(*KEY).agg(best.alias("__best"), F.min("first_ord").alias("first_ord"))
    return kept.select(*[F.col(c) if c in (*KEY, "first_ord") else F.col("__best")[c].alias(c) for c in states.columns])


def kept_counts(judged: DataFrame, order: tuple[str, ...] = ("extractor_ord", "ord")) -> DataFrame:
    """By extractor, how many rows were new or better than all before them with the same key."""
    good = judged.filter(F.col("reason").isNull()).select(*KEY, *order, *[c for c in ("extractor", "confidence") if c not in order])
    at = [F.col(c) for c in order]
    seen = running(ranged(good, [*map(F.col, KEY), *at], "kept"), list(KEY), at, "confidence", "max", "__best")
    return seen.groupBy("extractor").agg(F.count_if(F.col("__best").isNull() | (F.col("confidence") > F.col("__best"))).alias("kept"))


def reject_counts(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("reason").isNotNull()).groupBy("extractor", "reason").agg(F.count("*").alias("n"))


def _order() -> list:
    return [F.col("confidence").desc(), F.col("head"), F.col("relation"), F.col("first_ord")]


def sorted_triples(merged: DataFrame) -> DataFrame:
    return merged.orderBy(*_order())


def placed(merged: DataFrame, name: str = "place", order: list | None = None) -> DataFrame:
    """merged with its place in order, from 1."""
    return ranges.placed(merged, order or _order(), name)


def merge(parts: list[tuple[str, DataFrame]], lexicon: Lexicon | None = None) -> DataFrame:
    """The clean triples of all parts (name, triples with ord), in order."""
    lexicon = lexicon or Lexicon()
    return sorted_triples(keep_best(judge(union_extractors(parts), lexicon)))
