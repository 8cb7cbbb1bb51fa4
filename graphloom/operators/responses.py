"""Extraction by a language model: prompts, a provider of completions, strict parsing of what comes back."""

from __future__ import annotations

import functools
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions.lexicon import RELATIONS
from graphloom.functions.text import strip
from graphloom.sources import ledger
from graphloom.sources.storage import new_folder

from .merge import normalize_relation

SYSTEM_PROMPT = """Extract relations between named organisations from one sentence of a corporate filing. Answer with JSON only:
{"triples":[{"head":"...","relation":"...","tail":"...","confidence":0.0}]}
Relations and their direction:
- supplier_of: head sells or delivers to tail
- customer_of: head buys from tail
- subsidiary_of: head is owned by tail
- competitor_of: head competes with tail
- partner_of: head has an alliance with tail
- depends_on: head cannot do without tail
Words such as "we" or "the Company" stand for the filing company. Take only what the sentence states; leave out what fits no
relation; answer {"triples": []} if nothing does. confidence lies between 0 and 1."""

_BODY = "triples array<struct<head:string,relation:string,tail:string,confidence:string>>"


class CompletionProvider(Protocol):
    def __call__(self, prompt: str) -> str: ...


class ProviderError(RuntimeError):
    """What a provider raises; a message with 429 means: try again later."""


class HttpProvider:
    """Completions from an endpoint that takes chat messages as JSON, at temperature 0 unless told otherwise."""

    def __init__(self, url: str, key: str, model: str, *, system: str | None = SYSTEM_PROMPT, temperature: float = 0.0, max_tokens: int | None = 512, timeout: float = 60.0):
        if not key:
            raise ValueError("a key is required")
        self.url, self.key, self.timeout = url, key, timeout
        self.fixed = {"model": model, "temperature": temperature} | ({"max_tokens": max_tokens} if max_tokens else {})
        self.head = [{"role": "system", "content": system}] if system else []

    def __call__(self, prompt: str) -> str:
        body = json.dumps({**self.fixed, "messages": [*self.head, {"role": "user", "content": prompt}]}).encode()
        ask = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urllib.request.urlopen(ask, timeout=self.timeout) as said:
                return json.load(said)["choices"][0]["message"]["content"] or ""
        except urllib.error.HTTPError as error:
            raise ProviderError(f"{error.code} {error.read().decode(errors='replace')[:500]}") from error


def prompts(sents: DataFrame) -> DataFrame:
    """sents (with filer) and prompt, prompt_hash."""
    text = F.concat(F.lit("Filing company: "), F.coalesce("filer", F.lit("Unknown Company")), F.lit("\nSentence: "), F.col("sentence"), F.lit("\n"))
    return sents.withColumn("prompt", text).withColumn("prompt_hash", F.sha2(text, 256))


def wait_seconds(message: str, attempt: int, base: float = 2.0) -> float:
    """How long to wait after a refusal: what it says (minutes and seconds) and 5 more, else twice as long each time."""
    said = re.search(r"try again in (\d+)m([\d.]+)s", message)
    return int(said[1]) * 60 + float(said[2]) + 5 if said else base * 2**attempt


def with_retries(call: CompletionProvider, prompt: str, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str | None]:
    """The completion and no error, or "" and an error. Only refusals with 429 are tried again."""
    for attempt in range(tries):
        try:
            return call(prompt) or "", None
        except Exception as error:  # whatever a provider raises becomes a row in quarantine
            if "429" not in str(error) or attempt == tries - 1:
                return "", f"API error: {error}"
            sleep(wait_seconds(str(error), attempt))
    return "", "API error: no try was made"


#: Calls a second, over all tasks.
RATE = 1 / 0.3


def complete(asked: DataFrame, make: Callable[[], CompletionProvider] | None, path: str | None = None, *, scope: str = "", rate: float | None = RATE, callers: int = 8, tries: int = 5) -> DataFrame:
    """asked (prompt) with response and error. make() gives a provider for a task; None (no key) answers nothing.

    Each distinct prompt is called once, now, and its answer kept in a ledger (sources.ledger) under path, so that whatever reads the
    result reads the same answers; without a path the ledger lasts as long as the driver's JVM. callers tasks call at once, rate calls
    a second among them; None sets no rate. scope names what an answer depends on besides its prompt, such as the model.
    """
    if make is None:
        return asked.limit(0).withColumn("response", F.lit("")).withColumn("error", F.lit(None).cast("string"))
    if path is None:
        path = new_folder(asked.sparkSession, "answers")
    return ledger.ask(asked, make, functools.partial(with_retries, tries=tries), path, scope=scope, rate=rate, callers=callers)


def replay(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """asked with the response recorded for its prompt (prompt_hash, response)."""
    return asked.join(responses.select("prompt_hash", "response"), "prompt_hash").withColumn("error", F.lit(None).cast("string"))


def clean_json(raw: Column) -> Column:
    """The body of the first fence; else all from the first brace; else raw."""
    fence = r"(?s)```(?:json)?(?U)\s*(.*?)\s*```"
    return F.when(raw.rlike(fence), F.regexp_extract(raw, fence, 1)).when(F.locate("{", raw) > 0, raw.substr(F.locate("{", raw), F.length(raw))).otherwise(raw)


@F.pandas_udf(StringType())
def json_error(text: pd.Series) -> pd.Series:
    """Why text isn't one JSON object, strictly; null if it is. Built-in parsers accept text after the object and single quotes."""

    def check(t: str | None) -> str | None:
        try:
            return None if isinstance(json.loads(t or ""), dict) else "not an object"
        except ValueError as error:
            return str(error)

    return text.map(check)


def parse(answered: DataFrame) -> DataFrame:
    """answered (response, error) with triples (an array, or null) and error: earlier ones stay, bad JSON adds one with the raw text."""
    cleaned = answered.withColumn("__json", clean_json(strip(F.col("response"))))
    checked = cleaned.withColumn("__bad", json_error("__json"))
    error = F.coalesce("error", F.when(F.col("__bad").isNotNull(), F.concat(F.lit("JSON parse error: "), "__bad", F.lit("  |  raw="), "response")))
    body = F.when(F.col("__bad").isNull(), F.from_json("__json", _BODY)["triples"])
    return checked.withColumn("error", error).withColumn("triples", F.when(F.col("error").isNull(), body)).drop("__json", "__bad")


def checked_relation(relation: Column, relations: tuple[str, ...] = RELATIONS) -> Column:
    return F.when(relation.isin(*relations), relation).otherwise(F.concat(F.lit("INVALID:"), F.coalesce(relation, F.lit(""))))


def clamped(confidence: Column) -> Column:
    """A confidence between 0 and 1; 0.5 where there is none or it is no number."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence.try_cast("double"), F.lit(0.5))))


def triples(parsed: DataFrame) -> DataFrame:
    """The triples of parsed rows; those without a head or a tail (null ones too) are dropped, unknown relations are marked."""
    rows = parsed.select("source_file", "sent_pos", "sentence", F.posexplode("triples").alias("pos", "t"))
    named = rows.select(strip(F.col("t.head")).alias("head"), checked_relation(F.col("t.relation")).alias("relation"), strip(F.col("t.tail")).alias("tail"), clamped(F.col("t.confidence")).alias("confidence"), "source_file", F.col("sentence").alias("source_sentence"), F.struct("source_file", "sent_pos", "pos").alias("ord"))
    return normalize_relation(named.filter((F.col("head") != "") & (F.col("tail") != "")))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).select("sentence", "error", "source_file")
