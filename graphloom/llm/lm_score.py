"""Language-model scores by stupid backoff, from n-gram counts of the whole corpus.

1. Texts are gathered into chunks. A chunk row holds its texts, compressed; the table of chunks is bucketed by chunk, so that
   only counts travel to texts, never texts to counts.
2. Each chunk explodes its texts into the hashes of all their n-grams, and sends those it holds, once each, with their
   numbers, sorted and Golomb-Rice coded, to the owner of that part of the hash range: the count tables, by hash.
3. Owners add up and join each count back to the chunks that have the n-gram.
4. Chunks score each word from the counts of the n-grams that end in it, and sum by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, chunk_texts, chunked, grown, mixed, rice_decode, rice_encode, word_bounds

def grams(word: np.ndarray, at: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to order: the hashes of the n-grams of that length and the words at which they end. word: hashes
    of all words; at: the offsets of texts in them."""
    first = np.repeat(at[:-1], np.diff(at))
    out = [(mixed(word), np.arange(len(word)))]
    for k in range(2, order + 1):
        before, ends = out[-1]
        # n-grams that end at a word whose text has k words up to it: the shorter one that ends before it, and this word.
        longer = ends[ends - first[ends] >= k - 2]
        keep = (longer + 1 < len(word)) & (first[np.minimum(longer + 1, len(word) - 1)] == first[longer])
        hashes = before[np.searchsorted(ends, longer[keep])]
        out.append((mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + word[longer[keep] + 1] + np.uint64(k)), longer[keep] + 1))
    return out


def _words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of a chunk row and the offsets of its texts in them."""
    raw, offsets = chunk_texts(row)
    starts, ends, at = word_bounds(raw, offsets)
    return Hashes(raw).of(starts, ends), at


def _small(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold them all, compressed."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if counts.max(initial=0) <= np.iinfo(k).max)
    return kind[2].encode() + len(counts).to_bytes(4, "little") + pa.compress(counts.astype(kind).tobytes(), "zstd", asbytes=True)


def _full(blob: bytes) -> np.ndarray:
    width, n = int(blob[:1]), int.from_bytes(blob[1:5], "little")
    return np.frombuffer(pa.decompress(blob[5:], width * n, "zstd", asbytes=True), f"<u{width}").astype(np.int64)


def _sent(owners: int, bits: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, at = _words(row)
                if not len(words):
                    continue
                found, counts = np.unique(np.concatenate([h for h, _ in grams(words, at, order)]) >> np.uint64(64 - bits), return_counts=True)
                owner = (found >> np.uint64(bits - 32)) * np.uint64(owners) >> np.uint64(32)
                edges = np.flatnonzero(np.diff(owner.astype(np.int64), prepend=-1)).tolist()
                out = [(row["chunk"], int(owner[a]), b - a, rice_encode(found[a:b]), _small(counts[a:b])) for a, b in zip(edges, [*edges[1:], len(owner)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "owner", "n", "coded", "counts"])

    return run


def _totals(sent: pd.DataFrame) -> pd.DataFrame:
    """One owner's count table, joined back to the n-grams of each chunk."""
    parts = [rice_decode(x) for x in sent["coded"]]
    _, where = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(where, np.concatenate([_full(x) for x in sent["counts"]])).astype(np.int64)[where]
    return pd.DataFrame({"chunk": sent["chunk"], "owner": sent["owner"], "counts": [_small(c) for c in np.split(total, np.cumsum([len(p) for p in parts])[:-1])]})


def word_scores(found: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray], total: int, discount: float, least: int) -> np.ndarray:
    """The log score of each word: of the longest n-gram that ends in it with a count of at least `least` (1 for single words),
    the log of its count over its history's, and the log of the discount for each length left out."""
    n = len(found[0][1])
    by_end = []
    for (_, ends), c in zip(found, counts, strict=True):
        here = np.zeros(n, np.int64)
        here[ends] = c
        by_end.append(here)
    out = np.log(by_end[0] / total)
    for k in range(1, len(found)):
        has = np.zeros(n, bool)
        has[found[k][1]] = True
        good = has & (by_end[k] >= least)
        history = np.concatenate([[1], by_end[k - 1][:-1]])
        out = np.where(good, np.log(np.where(good, by_end[k], 1) / np.where(good, history, 1)), np.where(has, out + np.log(discount), out))
    return out


_OUT = "doc_id long, n_words long, log_score double"


def _scores(bits: int, order: int, total: int, discount: float, least: int):
    def run(chunk: pa.Table, replies: pa.Table) -> pa.Table:
        parts = []
        for row in chunk.to_pylist():
            docs, known = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["known"], bool)
            words, at = _words(row)
            scores = np.zeros(0)
            if len(words):
                found = grams(words, at, order)
                _, where = np.unique(np.concatenate([h for h, _ in found]) >> np.uint64(64 - bits), return_inverse=True)
                counts = np.concatenate([_full(x) for x in replies.sort_by("owner").column("counts").to_pylist()])[where]
                scores = word_scores(found, np.split(counts, np.cumsum([len(h) for h, _ in found])[:-1]), total, discount, least)
            # Each document's own sum, so that no other document's words round it.
            sums = np.array([scores[a:b].sum() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.float64)
            parts.append(pa.table({"doc_id": pa.array(docs, mask=~known), "n_words": np.diff(at), "log_score": sums}))
        return pa.concat_tables(parts) if parts else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})

    return run


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, discount: float = 0.4, least: int = 1, chunk_bytes: int = 4 << 20, owner_rows: int = 2_000_000, spare_bits: int = 28) -> DataFrame:
    """doc_id, n_words, log_score of each row of docs: the sum of its words' log stupid-backoff scores.

    Counts come from all of docs, the row itself and its copies included, and all n-grams count; with a higher `least`, those of
    two or more words that occur fewer than `least` times back off. Words are runs of other than space and U+0009 to U+000D; n-grams don't cross
    texts. Null and empty texts have no words and a score of 0; repeated rows count each; an empty table gives an empty
    result. An n-gram's hash has log2(n-grams) + spare_bits bits: one in 2**spare_bits may share a count with another.
    """
    size = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    chunks = chunked(docs, "op8-chunks", id_col=id_col, text_col=text_col, row_col=None, chunk_bytes=grown(chunk_bytes, size), size=size, measure=lambda raw, at: len(word_bounds(raw, at)[0]))
    total = chunks.agg(F.sum("n").alias("n")).first()["n"] or 0
    bits = min(64, max(32, (order * total).bit_length() + spare_bits))
    owners = max(8, -(-order * total // grown(owner_rows, size)))
    sent = chunks.mapInArrow(_sent(owners, bits, order), "chunk long, owner int, n int, coded binary, counts binary")
    replies = sent.groupBy("owner").applyInPandas(_totals, "chunk long, owner int, counts binary")
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_scores(bits, order, total, discount, least), _OUT)


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    scored = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    mean = F.col("log_score") / F.greatest("n_words", F.lit(1))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(F.exp(-mean), 3).alias("perplexity"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(words) AS c, generate_subscripts(words, 1) AS i FROM w),
q AS (SELECT doc_id, i, c, lag(c, 1) OVER o AS b, lag(c, 2) OVER o AS a FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT count(*) AS n FROM q),
u AS (SELECT c AS x, count(*) AS k FROM q GROUP BY ALL),
v AS (SELECT b AS x, c AS y, count(*) AS k FROM q WHERE b IS NOT NULL GROUP BY ALL),
t AS (SELECT a AS x, b AS y, c AS z, count(*) AS k FROM q WHERE a IS NOT NULL GROUP BY ALL),
s AS (SELECT q.doc_id, CASE WHEN t.k >= 1 THEN ln(t.k / h.k) WHEN v.k >= 1 THEN ln(v.k / g.k) + CASE WHEN a IS NULL THEN 0 ELSE ln(0.4) END
             ELSE ln(u.k / n.n) + CASE WHEN b IS NULL THEN 0 WHEN a IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS score
      FROM q CROSS JOIN n JOIN u ON u.x = q.c LEFT JOIN u AS g ON g.x = q.b LEFT JOIN v ON v.x = q.b AND v.y = q.c
      LEFT JOIN v AS h ON h.x = q.a AND h.y = q.b LEFT JOIN t ON t.x = q.a AND t.y = q.b AND t.z = q.c),
d AS (SELECT doc_id, count(*) AS n_words, sum(score) AS score FROM s GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(score, 0), 4) AS log_score,
       round(exp(-coalesce(score, 0) / greatest(coalesce(n_words, 0), 1)), 3) AS perplexity
FROM w LEFT JOIN d USING (doc_id)
"""
