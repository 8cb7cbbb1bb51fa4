"""Language identification with n-gram filters whose cells hold a bitmask of languages.

One Bloom filter serves all languages: cell i holds, bit-sliced over as many words as the languages need, those that have an
n-gram hashed to i. The AND of an n-gram's cells is the set of all languages that contain it. A text's n-grams give a count
for each language; the count that false positives alone would give is taken out, and the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered_columns, rounds, same_columns, table, unused, utf8, with_fields

_LETTER = regex.compile(r"\p{L}")
#: Cells of a filter for each n-gram of the language that has the most.
CELLS = 16
#: An n-gram isn't a language's own if the share of its texts that have it is below so much of the largest share of any language: a
#: few mislabelled or quoting texts don't make one.
OWN = 0.05
#: Cells that one executor's row of a filter holds.
_BLOCK = 1 << 16
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@dataclass
class LanguageFilter:
    """langs[j] is bit j % 64 of the cells' word j // 64; rates[j] is the share of n-grams not in langs[j] that the filter takes
    for its own. cells: a row of cells for each word."""

    langs: list[str]
    cells: np.ndarray
    rates: np.ndarray
    n: int

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - (self.cells.shape[1] - 1).bit_length())

    def masks(self, grams: np.ndarray, word: int) -> np.ndarray:
        """The languages of one word of the cells that contain each n-gram."""
        found = self.cells[word, (grams * np.uint64(_MIX[0])) >> self.shift]
        for c in _MIX[1:]:
            found = found & self.cells[word, (grams * np.uint64(c)) >> self.shift]
        return found


def grams_of(raw: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each position as an integer; a text's last n - 1 positions run on into what follows."""
    padded = np.concatenate([raw, np.zeros(n - 1, np.uint8)])
    out = np.zeros(len(raw), np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | padded[i : i + len(raw)]
    return out


def prepared(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the lower-cased texts, each between spaces, so that n-grams see where words begin and end."""
    data = [f" {' '.join((t or '').lower().split())} ".encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)


def grams_in(text: str, n: int) -> np.ndarray:
    """The distinct n-grams of a text."""
    raw, _ = prepared([text])
    return np.unique(grams_of(raw, n)[: max(0, len(raw) - n + 1)])


def _cells(langs: int) -> tuple[int, type]:
    """Words of a cell and their type, by the number of languages."""
    width = min(64, max(1, langs))
    return max(1, -(-langs // 64)), next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= width)


def log2_cells(most: int) -> int:
    """A filter's size for languages of at most `most` n-grams."""
    return max(16, (CELLS * max(1, most) - 1).bit_length())


def _rated(langs: list[str], cells: np.ndarray, n: int) -> LanguageFilter:
    one = cells.dtype.type(1)
    rates = [((cells[j // 64] >> cells.dtype.type(j % 64)) & one).mean() ** len(_MIX) for j in range(len(langs))]
    return LanguageFilter(langs, cells, np.array(rates), n)


def fit(rows: list[tuple[str, str]], *, n: int = 4) -> LanguageFilter:
    """The filter of (lang, text) rows, in memory: all n-grams of each language that are its own."""
    parts: dict[str, list[np.ndarray]] = {}
    for lang, text in rows:
        if text:
            parts.setdefault(lang, []).append(grams_in(text, n))
    parts = {lang: x for lang, x in sorted(parts.items()) if any(map(len, x))}
    counted = {lang: np.unique(np.concatenate(x), return_counts=True) for lang, x in parts.items()}
    most: dict[int, float] = {}
    for lang, (found, k) in counted.items():
        for g, share in zip(found.tolist(), (k / len(parts[lang])).tolist(), strict=True):
            most[g] = max(share, most.get(g, 0.0))
    grams = {lang: found[k / len(parts[lang]) >= OWN * np.array([most[g] for g in found.tolist()])] for lang, (found, k) in counted.items()}
    words, kind = _cells(len(grams))
    size = log2_cells(max(map(len, grams.values()), default=0))
    cells = np.zeros((words, 1 << size), kind)
    for j, own in enumerate(grams.values()):
        for c in _MIX:
            cells[j // 64, np.unique((own * np.uint64(c)) >> np.uint64(64 - size))] |= kind(1 << j % 64)
    return _rated(list(grams), cells, n)


def learned(docs: DataFrame, *, most: int = 4000, n: int = 4) -> LanguageFilter:
    """The filter of training_rows(docs), as of fit(): its size follows from how many n-grams the sample holds. Whole texts are cut
    and the filter's blocks filled on the executors; the driver gets the filter, and a count for each language."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = grams_in(text, n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64))], names=["lang", "gram"])

    sample = table(training_rows(docs, most=most).filter(F.octet_length("text") > 0), "op10-sample")
    texts = F.create_map(*[F.lit(x) for r in sample.groupBy("lang").count().collect() for x in (r["lang"], float(r["count"]))] or [F.lit(""), F.lit(1.0)])
    share = F.count("*") / texts[F.col("lang")]
    shares_ = sample.mapInArrow(cut, "lang string, gram long").groupBy("lang", "gram").agg(share.alias("share"))
    own = F.col("share") >= OWN * F.max("share").over(Window.partitionBy("gram"))  # a row for each language
    grams = table(shares_.withColumn("own", own).filter("own").select("lang", "gram"), "op10-grams")
    counts = {r["lang"]: r["count"] for r in grams.groupBy("lang").count().collect()}
    langs = sorted(counts)
    words, kind = _cells(len(langs))
    size = log2_cells(max(counts.values(), default=0))
    place = {lang: j for j, lang in enumerate(langs)}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, bit = batch.column("gram").to_numpy().view(np.uint64), np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for c in _MIX:
                at = ((own * np.uint64(c)) >> np.uint64(64 - size)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bit // 64), pa.array(at // _BLOCK), pa.array(at % _BLOCK), pa.array(bit % 64)], names=["word", "block", "cell", "bit"])

    def filled(rows: pa.Table) -> pa.Table:
        cells = np.zeros(_BLOCK, kind)
        np.bitwise_or.at(cells, rows.column("cell").to_numpy(), kind(1) << rows.column("bit").to_numpy().astype(kind))
        return pa.table({"word": rows.column("word")[:1], "block": rows.column("block")[:1], "cells": pa.array([cells.tobytes()], pa.binary())})

    cells = np.zeros((words, 1 << size), kind)
    blocks = grams.mapInArrow(spread, "word long, block long, cell long, bit long").groupBy("word", "block").applyInArrow(filled, "word long, block long, cells binary")
    for r in blocks.collect():  # the filter itself
        cells[r["word"], r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["cells"], kind)
    return _rated(langs, cells, n)


def shares(model: LanguageFilter, texts: list[str | None]) -> np.ndarray:
    """For each text and language, the share of n-grams that the language contains, corrected for false positives."""
    raw, offsets = prepared(texts)
    ends = np.maximum(offsets[1:] - model.n + 1, offsets[:-1])
    total = np.maximum(ends - offsets[:-1], 1)
    grams = grams_of(raw, model.n)
    out = np.zeros((len(texts), len(model.langs)))
    for j in range(len(model.langs)):
        if j % 64 == 0:
            masks = model.masks(grams, j // 64)
        hit = np.concatenate([[0], np.cumsum((masks >> masks.dtype.type(j % 64)) & masks.dtype.type(1), dtype=np.int64)])
        share = (hit[ends] - hit[offsets[:-1]]) / total
        out[:, j] = np.clip((share - model.rates[j]) / (1 - model.rates[j]), 0, 1)
    return out


def predict(model: LanguageFilter, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Languages and scores (the corrected share of the language that wins; ties go to the first by name).

    Texts that are null or without a letter are `und` with score 0, as are all if nothing was learned.
    """
    share = shares(model, texts) if model.langs else np.zeros((len(texts), 1))
    best = share.argmax(axis=1)
    known = [bool(model.langs) and t is not None and bool(_LETTER.search(t)) for t in texts]
    return [model.langs[b] if k else "und" for b, k in zip(best.tolist(), known, strict=True)], [float(share[i, b]) if k else 0.0 for i, (b, k) in enumerate(zip(best.tolist(), known, strict=True))]


def training_rows(docs: DataFrame, *, most: int = 4000) -> DataFrame:
    """lang and text of a sample of at most `most` labelled rows (or of one for each language, if there are more), the same at
    every run: of each language an equal part of `most`, those rows that a hash of id and text puts first. Texts are whole. The
    driver gets a count for each language."""
    order = F.xxhash64("doc_id", "text")
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return labelled.select("lang", "text").limit(0)
    each = max(1, most // len(counts))
    # A hash below its language's bound leaves about twice as many rows as are wanted: so few are ranked.
    spark = docs.sparkSession
    bounds = spark.createDataFrame([(lang, min((1 << 63) - 1, (2 * each << 64) // n - (1 << 63))) for lang, n in sorted(counts.items())], "lang string, bound long")
    rows = labelled.select("lang", "text", order.alias("at")).join(F.broadcast(bounds), "lang").filter(F.col("at") <= F.col("bound"))
    first = Window.partitionBy("lang").orderBy("at", F.sha2("text", 256))
    return rows.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= each).select("lang", "text")


def languages(docs: DataFrame, model: LanguageFilter, *, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",), made: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns named, then language and score (named by `made`), of each row of docs, from its whole text alone.

    Null and letterless texts give `und` and score 0; repeated rows stay; an empty table gives an empty result.
    """
    names, whole = list(columns), unused("text", docs)
    read = docs.select(*numbered_columns(columns), F.col(text_col).cast("string").alias(whole))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # CELLS to 2 * CELLS cells for each n-gram of the bounded sample's largest language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(whole))
            text, lang, score = batch.column(whole), [], []
            for a, b in rounds(np.diff(offsets)):
                found = predict(LanguageFilter(**shared.value), text.slice(a, b - a).to_pylist())
                lang += found[0]
                score += found[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, *made])

    return read.mapInArrow(run, with_fields(docs, columns, f"`{made[0]}` string, `{made[1]}` double"))


def held_out(doc_id):
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


def keep_known(docs: DataFrame, *, least: float = 0.1) -> DataFrame:
    """docs with all their columns, without those that have no letter and those without a lang whose n-grams hardly any language
    has (a score below `least`); a null lang becomes the language found. If nothing could be learned, only the former go."""
    model = learned(docs.filter(~held_out(F.col("doc_id"))))
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = unused("lang", docs), unused("score", docs)
    found = languages(docs, model, columns=tuple(docs.columns), made=(lang, score)).filter((F.col(lang) != "und") & (F.col("lang").isNotNull() | (F.col(score) >= least)))
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*same_columns(docs))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learned(docs.filter(~held_out(F.col("doc_id"))))
    return languages(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
