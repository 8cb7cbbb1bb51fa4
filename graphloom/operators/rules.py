"""Relation extraction by trigger words over annotated sentences, as expressions on token and entity arrays.

Input rows have source_file, sent_pos, sentence, tokens and ents (graphloom.functions.schemas.ANNOTATED) and filer, which
may be null. Only sentences with a trigger get as far as the tree rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.lexicon import JUNK_SPAN, PREPOSITIONS, SELF_WORDS, SKIP_WORDS, TRIGGERS

from .merge import normalize_relation

_STRING = "string"


def entity_filter(ents: Column) -> Column:
    """Organisations, places and products, stripped, of at most 80 characters and without words of documents."""
    kept = F.filter(ents, lambda e: e["label"].isin("ORG", "GPE", "PRODUCT"))
    bare = F.transform(kept, lambda e: F.struct(F.regexp_replace(e["text"], r"(?U)^\s+|\s+$", "").alias("text"), e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))
    return F.filter(bare, lambda e: (F.length(e["text"]) <= 80) & ~e["text"].rlike(JUNK_SPAN))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once, however often use() names it: expressions with lambdas aren't shared otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_of(candidates: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.get(F.filter(candidates, lambda c: c.isNotNull() & (c != "")), F.lit(0))


def _first_made(*candidates: Column) -> Column:
    """first_of(), which makes no candidate after the one that it takes."""
    return F.coalesce(*[first_of(F.array(c)) for c in candidates])


def _preferred(found: Column, last: bool) -> Column:
    at = F.lit(-1 if last else 1)
    return once(found, lambda f: F.coalesce(F.try_element_at(F.filter(f, lambda e: e["label"].isin("ORG", "PRODUCT")), at), F.try_element_at(f, at))["text"])


def nearest_before(ents: Column, at: Column, window: int = 300) -> Column:
    """The last entity that ends within `window` characters before `at`; organisations and products before places."""
    return _preferred(F.filter(ents, lambda e: (e["end"] <= at) & (at - e["end"] <= window)), True)


def nearest_after(ents: Column, at: Column, window: int = 300) -> Column:
    return _preferred(F.filter(ents, lambda e: (e["start"] >= at) & (e["start"] - at <= window)), False)


def is_entity(text: Column, ents: Column, filer: Column) -> Column:
    """Is text an entity's text, part of one, or around one, or the filer?"""

    def among(low: Column) -> Column:
        return F.exists(F.transform(ents, lambda e: F.lower(e["text"])), lambda e: e.contains(low) | low.contains(e))

    return F.coalesce(once(F.lower(text), lambda low: (low != "") & ~low.isin(*SKIP_WORDS) & ((F.coalesce(filer, F.lit("")) != "") & (low == F.lower(filer)) | among(low))), F.lit(False))


def own_word(text: Column, filer: Column) -> Column:
    """The filer, if text is a word for it."""
    return F.when(F.lower(text).isin(*SELF_WORDS), filer)


def token_entity(token: Column, ents: Column, filer: Column) -> Column:
    inside = F.get(F.filter(ents, lambda e: (e["start"] <= token["idx"]) & (token["idx"] < e["end"])), F.lit(0))["text"]
    return F.coalesce(inside, own_word(token["text"], filer))


def _children(tokens: Column, of: Column, right: bool | None, deps: tuple[str, ...]) -> Column:
    def take(t: Column) -> Column:
        side = (t["i"] > of["i"]) if right else (t["i"] < of["i"])
        return (t["head"] == of["i"]) & side & t["dep"].isin(*deps)

    return F.filter(tokens, take)


def _under(tokens: Column, preposition: Column, ents: Column, filer: Column, window: int) -> Column:
    """Candidates below a preposition, in order: each object's entity, those of its appositions, the nearest after it."""

    def of_object(gc: Column) -> Column:
        more = F.transform(_children(tokens, gc, True, ("appos", "conj")), lambda x: token_entity(x, ents, filer))
        return F.concat(F.array(token_entity(gc, ents, filer)), more, F.array(nearest_after(ents, gc["idx"], window)))

    return F.flatten(F.transform(_children(tokens, preposition, True, ("pobj", "nmod")), of_object))


def preposition_entity(tokens: Column, token: Column, ents: Column, filer: Column, preps: tuple[str, ...] = ("of",), window: int = 200) -> Column:
    own = F.filter(_children(tokens, token, True, ("prep",)), lambda c: F.lower(c["lemma"]).isin(*preps))
    return first_of(F.flatten(F.transform(own, lambda c: _under(tokens, c, ents, filer, window))))


def subject(tokens: Column, token: Column, ents: Column, filer: Column) -> Column:
    """The entity of the first subject on the left, null if that is none; the head's subject only where there is no subject."""
    own = F.get(_children(tokens, token, False, ("nsubj", "nsubjpass", "csubj")), F.lit(0))
    above = F.get(F.filter(tokens, lambda t: (t["i"] == token["head"]) & (t["i"] != token["i"])), F.lit(0))
    theirs = once(above, lambda a: F.when(a.isNotNull(), F.get(_children(tokens, a, False, ("nsubj", "nsubjpass")), F.lit(0))))
    return once(F.coalesce(own, theirs), lambda t: token_entity(t, ents, filer))


def object_(tokens: Column, token: Column, ents: Column, filer: Column, ordered: Column) -> Column:
    """The first direct object that is an entity, else what stands below prepositions in the given order."""
    direct = F.transform(_children(tokens, token, True, ("dobj", "attr")), lambda c: token_entity(c, ents, filer))

    def below(preps: Column) -> Column:
        ranked = F.flatten(F.transform(ordered, lambda p: F.filter(preps, lambda c: F.lower(c["lemma"]) == p)))
        return F.flatten(F.transform(ranked, lambda c: _under(tokens, c, ents, filer, 250)))

    return F.coalesce(first_of(direct), first_of(once(_children(tokens, token, True, ("prep",)), below)))


def trigger_table(spark, triggers=TRIGGERS) -> DataFrame:
    """lemma, kind (verb or noun), relation, confidence, subj_is_head, preps: the relation's own first, then the others."""
    rows = []
    for relation, verbs, nouns, cv, cn, head, preps in triggers:
        order = [*preps, *[p for p in PREPOSITIONS if p not in preps]]
        rows += [(v, "verb", relation, cv, head, order) for v in verbs] + [(n, "noun", relation, cn, head, order) for n in nouns]
    return spark.createDataFrame(rows, "trigger string, kind string, relation string, confidence double, subj_is_head boolean, preps array<string>")


def trigger_kind(pos: Column, lemma: Column, verbs: list[str], nouns: list[str]) -> Column:
    """Which table a token is looked up in: verbs first, so that a noun in both counts as a verb."""
    return F.when(pos.isin("VERB", "AUX", "NOUN") & lemma.isin(verbs), "verb").when(pos.isin("NOUN", "PROPN") & lemma.isin(nouns), "noun")


def extract(annotated: DataFrame, triggers=TRIGGERS) -> DataFrame:
    """The triples of annotated sentences (with filer), customer_of turned round: one of each (head, relation, tail) a sentence,
    the first; ord orders them within a file."""
    spark = annotated.sparkSession
    verbs, nouns = [v for t in triggers for v in t[1]], [n for t in triggers for n in t[2]]
    ents, filer, tokens = F.col("ents"), F.col("filer"), F.col("tokens")

    def kind(t: Column) -> Column:
        return trigger_kind(t["pos"], F.lower(t["lemma"]), verbs, nouns)

    # Only triggers become rows: each row carries all of its sentence.
    rows = annotated.withColumn("ents", entity_filter(ents)).withColumn("token", F.explode(F.filter("tokens", lambda t: kind(t).isNotNull())))
    rows = rows.withColumn("trigger", F.lower("token.lemma")).withColumn("kind", kind(F.col("token")))
    rows = rows.join(trigger_table(spark, triggers), ["trigger", "kind"])
    token, verb = F.col("token"), F.col("kind") == "verb"
    above = F.get(F.filter(tokens, lambda t: t["i"] == token["head"]), F.lit(0))
    doer = F.when(verb, token).otherwise(once(above, lambda a: F.when(a["pos"].isin("VERB", "AUX"), a)))
    subj = once(doer, lambda d: F.when(d.isNotNull(), subject(tokens, d, ents, filer)))
    end = token["idx"] + F.length(token["text"])
    obj = F.when(verb, _first_made(object_(tokens, token, ents, filer, F.col("preps")), nearest_after(ents, end))).otherwise(_first_made(preposition_entity(tokens, token, ents, filer), nearest_after(ents, end, 200)))
    # inline() of one struct: a filter on its columns can't be pushed below it, where it would make them once for each mention.
    pair = F.struct(_first_made(subj, nearest_before(ents, token["idx"]), filer).alias("subj"), obj.alias("obj"))
    rows = rows.select("*", F.inline(F.array(pair)))
    s, o = F.col("subj"), F.col("obj")
    rows = rows.filter(s.isNotNull() & o.isNotNull() & (s != o) & ~F.lower(s).isin(*SKIP_WORDS) & ~F.lower(o).isin(*SKIP_WORDS) & (is_entity(s, ents, filer) | is_entity(o, ents, filer)))
    possessed = (F.coalesce(filer, F.lit("")) != "") & ((F.size(F.filter(_children(tokens, token, False, ("poss", "det")), lambda c: F.lower(c["text"]).isin(*SELF_WORDS))) > 0) | (token["dep"] == "dobj"))
    swap = ~verb & possessed & F.col("relation").isin("supplier_of", "customer_of") & is_entity(o, ents, F.lit(None).cast(_STRING))
    turn = verb & ~F.col("subj_is_head")
    rows = rows.withColumn("head", F.when(swap | turn, o).otherwise(s)).withColumn("tail", F.when(swap, filer).when(turn, s).otherwise(o))
    w = Window.partitionBy("source_file", "sent_pos", "head", "relation", "tail").orderBy("token.i")
    rows = rows.withColumn("rank", F.row_number().over(w)).filter("rank = 1")
    out = rows.select("head", "relation", "tail", "confidence", "source_file", F.col("sentence").alias("source_sentence"), F.struct("source_file", "sent_pos", F.col("token.i").alias("pos")).alias("ord"))
    return normalize_relation(out)
