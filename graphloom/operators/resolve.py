"""Entity resolution: spelling, canonical names, noise, and whether a name looks like a company."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import lexicon as fixed
from graphloom.functions.lexicon import Lexicon
from graphloom.functions.text import strip, ticker
from graphloom.sources.storage import BROADCAST_ROWS, materialize


def plain_apostrophes(c: Column) -> Column:
    return F.translate(c, "’‘ʼ", "'''")


def canon_key(c: Column) -> Column:
    return F.rtrim(F.lower(strip(c)), F.lit(".,; "))


def canon_table(spark, lexicon: Lexicon) -> DataFrame:
    """canon_key, canonical; a null canonical means that the name is blacklisted."""
    rows = list(lexicon.canonical.items())
    return spark.createDataFrame(rows, "canon_key string, canonical string")


def filer_table(spark, filers: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(filers.items()), "ticker string, filer string")


def with_filer(df: DataFrame, filers: DataFrame, missing: str | None = None) -> DataFrame:
    """df with its filer, looked up by the ticker in source_file; missing is given where there is none."""
    found = df.withColumn("ticker", ticker(F.col("source_file"))).join(filers.select("ticker", "filer"), "ticker", "left").drop("ticker")
    return found if missing is None else found.withColumn("filer", F.coalesce("filer", F.lit(missing)))


def canonicalize(df: DataFrame, name: str, canon: DataFrame, out: str) -> DataFrame:
    """df with the canonical form of column `name` as `out`.

    The key, then the key without a possessive, is looked up; a name that has neither key stays as it is, stripped; one that
    has a key with a null becomes null.
    """
    key = canon_key(F.col(name))
    tables = [canon.select(F.col("canon_key").alias(f"__k{i}"), F.col("canonical").alias(f"__c{i}")) for i in (1, 2)]
    found = df.withColumn("__a", key).withColumn("__b", F.regexp_replace(key, "'s$", ""))
    found = found.join(tables[0], F.col("__a") == F.col("__k1"), "left").join(tables[1], F.col("__b") == F.col("__k2"), "left")
    value = F.when(F.col("__k1").isNull() & F.col("__k2").isNull(), strip(F.col(name))).otherwise(F.coalesce("__c1", "__c2"))
    return found.withColumn(out, value).drop("__a", "__b", "__k1", "__c1", "__k2", "__c2")


def is_pronoun(c: Column) -> Column:
    return c.rlike(f"(?iu)^{fixed.PRONOUN}$")


def is_noise(c: Column, lexicon: Lexicon) -> Column:
    return F.lower(c).isin(*lexicon.noise)


def is_junk(c: Column, lexicon: Lexicon) -> Column:
    return c.rlike(f"(?iu)^{lexicon.junk}")


def is_anchor(c: Column, lexicon: Lexicon) -> Column:
    return c.isin(*lexicon.anchors)


def looks_like_company(c: Column, lexicon: Lexicon) -> Column:
    """The quality gate for names that are no anchors."""
    bad = [
        F.length(c) < 3,
        c.rlike(f"^{fixed.SHORT_CAPITALS}$") & ~c.isin(*fixed.KNOWN_CAPITALS),
        ~c.rlike("[A-Za-z]"),
        F.lower(c).startswith("the ") & ~is_anchor(c, lexicon),
        F.substring(c, 1, 1).isin("•", "–", "—", "-", "/"),
        c.rlike(f"(?iu)^{lexicon.generic}"),
        c.rlike(f"(?iu)^{lexicon.product}") & ~c.isin(*fixed.NO_PRODUCTS),
        reduce(Column.__or__, [c.endswith(s) for s in fixed.CATEGORIES]),
        c.isin(*lexicon.not_companies),
        F.size(F.split(strip(c), r"(?U)\s+")) > 6,
    ]
    return ~reduce(Column.__or__, bad)


def flagged(df: DataFrame, name: str, lexicon: Lexicon) -> DataFrame:
    """df with anchor and valid of the names in a column. What the column is made of is not inlined into the conditions."""
    held = df.select(*[c for c in df.columns if c != name], F.inline(F.array(F.struct(F.col(name)))))
    c = F.col(name)
    return held.withColumns({"anchor": F.coalesce(is_anchor(c, lexicon), F.lit(False)), "valid": F.coalesce(looks_like_company(c, lexicon), F.lit(False))})


class Names:
    """What distinct names stand for, resolved once: name, pronoun, entity (null for empty names, pronouns, blacklisted names, noise
    and junk), anchor and valid of the entity. A name that a large part of all rows has is joined back by a broadcast, as there can be
    few such names; a table small enough is broadcast whole."""

    def __init__(self, names: DataFrame, lexicon: Lexicon, small: int = BROADCAST_ROWS, share: float = 0.001):
        """names: a column `name` with repeats."""
        spark = names.sparkSession
        counted = names.filter(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("n"))
        found = canonicalize(counted.withColumn("__name", plain_apostrophes(strip(F.col("name")))), "__name", canon_table(spark, lexicon), "__canon")
        held = found.select("name", "n", F.inline(F.array(F.struct("__name", "__canon"))))
        plain, c = F.col("__name"), F.col("__canon")
        pronoun = (plain != "") & is_pronoun(plain)
        entity = F.when((plain != "") & ~pronoun & ~is_noise(c, lexicon) & ~is_junk(c, lexicon), c)
        self.rows = materialize(flagged(held.select("name", "n", pronoun.alias("pronoun"), entity.alias("entity")), "entity", lexicon), "names")
        size = self.rows.agg(F.count("*").alias("rows"), F.sum("n").alias("all")).first()
        self.small, self.hot = size["rows"] <= small, max(1, int((size["all"] or 0) * share))

    def attach(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """df with a struct `out` of what column's name stands for; null where the name is null."""
        kept = self.rows.select(F.col("name").alias("__name"), "n", F.struct("pronoun", "entity", "anchor", "valid").alias("__found"))
        if self.small:
            return df.join(F.broadcast(kept.drop("n")), F.col(column) == F.col("__name"), "left").withColumnRenamed("__found", out).drop("__name")
        # At most 1 / share names can have more rows than that share.
        often = F.broadcast(kept.filter(F.col("n") > self.hot).select(F.col("__name").alias("__often"), F.col("__found").alias("__fast")))
        first = df.join(often, F.col(column) == F.col("__often"), "left")
        # Rows that are done, or have no name, get keys of their own: they match nothing and lie anywhere.
        alone = F.concat(F.lit("\0"), F.monotonically_increasing_id())
        keyed = first.withColumn("__key", F.when(F.col("__often").isNull() & F.col(column).isNotNull(), F.col(column)).otherwise(alone))
        both = keyed.join(kept.filter(F.col("n") <= self.hot).drop("n"), F.col("__key") == F.col("__name"), "left")
        return both.withColumn(out, F.coalesce("__fast", "__found")).drop("__often", "__fast", "__key", "__name", "__found")


def resolve(df: DataFrame, name: str, lexicon: Lexicon, out: str) -> DataFrame:
    """df (with filer) and the entity that column `name` stands for as `out`: null for empty names, words for a filing company
    that isn't known, blacklisted names, noise and junk."""
    found = Names(df.select(F.col(name).alias("name")), lexicon).attach(df, name, "__is")
    return found.withColumn(out, F.when(F.col("__is.pronoun"), F.when(F.col("filer") != "", F.col("filer"))).otherwise(F.col("__is.entity"))).drop("__is")
