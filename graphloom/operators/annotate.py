"""Annotation of sentences with tokens and entities, by any parser that follows the Annotator protocol."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.lexicon import TRIGGERS
from graphloom.functions.schemas import ANNOTATED


class Annotator(Protocol):
    def __call__(self, sentence: str) -> tuple[list[dict], list[dict]]:
        """The sentence's tokens and entities, as in schemas.TOKENS and schemas.ENTITIES."""


_TOKEN = re.compile(r"\w+(?:'\w+)?|[^\w\s]")
_NAME = re.compile(r"[A-Z][\w&.-]*(?:\s+[A-Z][\w&.-]*)*")
_PREPOSITIONS = {"with", "to", "from", "of", "on", "for", "against", "such"}
_ENDINGS = (("ies", "y"), ("ing", ""), ("ing", "e"), ("ed", ""), ("ed", "e"), ("es", ""), ("es", "e"), ("s", ""))
_VERBS = {v for t in TRIGGERS for v in t[1]}
_NOUNS = {n for t in TRIGGERS for n in t[2]}


def trigger_forms() -> list[str]:
    """All words that the endings trace back to a trigger."""
    triggers = _VERBS | _NOUNS
    return sorted(triggers | {t.removesuffix(b) + a for t in triggers for a, b in _ENDINGS if t.endswith(b)})


class PlainAnnotator:
    """Needs no model: capitalised runs are organisations, endings give lemmas of trigger words, a trigger verb's neighbours to the
    left and right are its subject and object, and prepositions hang on the trigger before them."""

    @staticmethod
    def may_matter(sentence: Column) -> Column:
        """False for sentences in which this annotator finds no trigger: none of the forms that its endings trace back to one."""
        # All maximal runs of letters a to z hold at least the words that are a form; a hash set beats an alternation of as many.
        return F.arrays_overlap(F.split(F.lower(sentence), "[^a-z]+"), F.array(*map(F.lit, trigger_forms())))

    def lemma(self, word: str) -> str:
        low = word.lower()
        if low in _VERBS or low in _NOUNS:
            return low
        return next((low[: -len(a)] + b for a, b in _ENDINGS if low.endswith(a) and low[: -len(a)] + b in _VERBS | _NOUNS), low)

    def __call__(self, sentence: str) -> tuple[list[dict], list[dict]]:
        ents = [{"text": m[0].rstrip("."), "start": m.start(), "end": m.start() + len(m[0].rstrip(".")), "label": "ORG"} for m in _NAME.finditer(sentence) if m.start() or " " in m[0] or m[0].isupper()]
        tokens, trigger, preposition = [], -1, -1
        for i, m in enumerate(_TOKEN.finditer(sentence)):
            lemma = self.lemma(m[0])
            inside = any(e["start"] <= m.start() < e["end"] for e in ents)
            kind = "PROPN" if inside else "VERB" if lemma in _VERBS else "NOUN" if lemma in _NOUNS else "ADP" if m[0].lower() in _PREPOSITIONS else "X"
            token = {"i": i, "idx": m.start(), "text": m[0], "lemma": lemma, "pos": kind, "dep": "dep", "head": i}
            if kind in ("VERB", "NOUN"):
                trigger, preposition = i, -1
                before = [t for t in tokens if t["pos"] == "PROPN" or t["text"].lower() in ("we", "our", "us")]
                if before and before[-1]["dep"] == "dep":
                    own = kind == "NOUN" and before[-1]["i"] == i - 1 and before[-1]["text"].lower() == "our"
                    before[-1] |= {"dep": "poss" if own else "nsubj", "head": i}
            elif kind == "ADP" and trigger >= 0:
                preposition = i
                token |= {"dep": "prep", "head": trigger}
            elif kind == "PROPN" and preposition >= 0:
                token |= {"dep": "pobj", "head": preposition}
                preposition = -1
            elif kind == "PROPN" and trigger == i - 1 >= 0:
                token |= {"dep": "dobj", "head": trigger}
            tokens.append(token)
        return tokens, ents


def annotate(sents: DataFrame, make: Callable[[], Annotator] = PlainAnnotator) -> DataFrame:
    """sents with tokens and ents. make() runs once in each Python worker's task, so a model is loaded once for all its rows.
    Filter rows before: nothing is pushed below this. If make has may_matter (a condition on sentences), others are left out."""
    if hasattr(make, "may_matter"):
        sents = sents.filter(make.may_matter(F.col("sentence")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = make()
        for batch in batches:
            found = [parse(s) for s in batch["sentence"]]
            yield batch.assign(tokens=[t for t, _ in found], ents=[e for _, e in found])

    return sents.select("source_file", "sent_pos", "sentence").mapInPandas(run, ANNOTATED)
