"""Text preparation as column expressions: cleaning, sentences, relevance, tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lexicon import BANNER, RELEVANT, SENTENCE_END


def strip(c: Column) -> Column:
    """c without white space at either end; white space by Unicode."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Section banners go (they don't cross lines), then each run of white space becomes a space, and the ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, BANNER, ""), r"(?U)\s+", " "))


def split_sentences(c: Column) -> Column:
    """The stripped sentences of cleaned text; all but the last lose their full stop."""
    return F.transform(F.split(c, SENTENCE_END), strip)


def sentences(filings: DataFrame) -> DataFrame:
    """(source_file, sent_pos, sentence) of filings (source_file, text). Null text has none."""
    return filings.select("source_file", F.posexplode(split_sentences(clean_text(F.col("text")))).alias("sent_pos", "sentence"))


def fits_rules(c: Column) -> Column:
    return F.length(c).between(30, 800)


def fits_model(c: Column) -> Column:
    return (F.length(c) > 40) & (F.length(c) < 600)


def is_relevant(c: Column, words: tuple[str, ...] = RELEVANT, stems: bool = False) -> Column:
    """Does c hold one of the words? They must stand alone, stems included, unless `stems` lets words go on."""
    return c.rlike(rf"(?i)\b({'|'.join(words)}){'' if stems else r'\b'}")


def relevance_stats(sents: DataFrame, cap: int = 80) -> DataFrame:
    """By file: total, relevant, pct (0 where there are none), capped (a note where more than cap are relevant) and sending."""
    by = sents.groupBy("source_file").agg(F.count("*").alias("total"), F.count_if(is_relevant(F.col("sentence"))).alias("relevant"))
    pct = F.coalesce(F.try_divide(F.col("relevant") * 100, F.col("total")), F.lit(0.0))
    return by.select("source_file", "total", "relevant", pct.alias("pct"), F.when(F.col("relevant") > cap, F.lit(f"(capped at {cap})")).otherwise("").alias("capped"), F.least("relevant", F.lit(cap)).alias("sending"))


def first_sentences(sents: DataFrame, cap: int = 80) -> DataFrame:
    """The first cap rows of each file, in order."""
    w = Window.partitionBy("source_file").orderBy("sent_pos")
    return sents.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).drop("rank")


def ticker(source_file: Column) -> Column:
    """The upper-cased part of the file's stem before the first underscore."""
    return F.upper(F.split(F.regexp_replace(source_file, r"\.[^.]*$", ""), "_")[0])


def _quoted(c: Column) -> Column:
    """Text in quotes as it reads in code: single ones, unless only single ones are in it."""
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("\\'")), F.lit("'")))


def display(head: Column, relation: Column, tail: Column, confidence: Column, source_file: Column) -> Column:
    """A triple on one line, its confidence to two places."""
    return F.format_string("(%s, %s, %s) conf=%.2f src=%s", _quoted(head), relation, _quoted(tail), confidence, source_file)
