"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Texts are packed into chunks, with the SHA-256 of each text without white space.
2. Each chunk sends every owner (a range of fingerprints) its distinct fingerprints, sorted and Golomb-Rice coded, with a
   bit for those it holds twice itself.
3. Each owner answers each chunk with a bitmap of the fingerprints that another chunk, or the chunk itself, repeats.
4. Each chunk reads its bitmaps where its texts lie. Only rows that a bitmap marks, the suspects, are shuffled, with their whole
   texts, and grouped; the bytes of a group must all be the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.storage import scratch

from .common import SPACES, chunk_texts, chunked, grown, rice_decode, rice_encode, same_columns, sized, table, unused

_SPACES = SPACES.encode()


def _digests(raw: np.ndarray, at: np.ndarray) -> bytes:
    """The SHA-256 of each text without white space, then its length in code points, eight bytes each."""
    data = raw.tobytes()
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return b"".join(hashlib.sha256(data[a:b].translate(None, _SPACES)).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) + np.diff(first[at]).astype(np.int64).tobytes()


def _digest_rows(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Digests, a row of 32 bytes each, and lengths of a chunk's texts."""
    n = len(row["ids"]) // 8
    return np.frombuffer(row["more"], np.uint8, 32 * n).reshape(n, 32), np.frombuffer(row["more"], np.int64, n, 32 * n)


def _prints(shas: np.ndarray, bits: int) -> np.ndarray:
    return shas[:, :8].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - bits)


def _encode(owners: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                prints, counts = np.unique(_prints(_digest_rows(row)[0], bits), return_counts=True)
                owner = (((prints << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
                out = [(row["chunk"], int(owner[a]), b - a, rice_encode(prints[a:b]), np.packbits(counts[a:b] > 1).tobytes()) for a, b in zip(edges, [*edges[1:], len(owner)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "owner", "n", "coded", "local"])

    return run


def _answer(sent: pd.DataFrame) -> pd.DataFrame:
    """One owner's bitmaps, one for each chunk."""
    parts = [rice_decode(x) for x in sent["coded"]]
    local = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(sent["local"], sent["n"], strict=True)]
    found, where, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    twice = (counts > 1) | (np.bincount(where, np.concatenate(local), len(found)) > 0)
    marks = np.split(twice[where], np.cumsum([len(x) for x in parts])[:-1])
    return pd.DataFrame({"chunk": sent["chunk"], "owner": sent["owner"], "n": sent["n"], "marks": [np.packbits(m).tobytes() for m in marks]})


_SUSPECT = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("chars", pa.int64()), ("sha", pa.binary()), ("norm", pa.binary())])


def _docs(row: dict) -> pa.Array:
    return pa.array(np.frombuffer(row["docs"], np.int64), mask=~np.frombuffer(row["known"], bool))


def _suspects(bits: int):
    def run(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(chunk) or not len(marks):
            return _SUSPECT.empty_table()
        (row,) = chunk.to_pylist()
        shas, chars = _digest_rows(row)
        prints = _prints(shas, bits)
        marks = marks.sort_by("owner")
        twice = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(marks.column("marks").to_pylist(), marks.column("n").to_pylist(), strict=True)]).astype(bool)
        some = np.flatnonzero(twice[np.searchsorted(np.unique(prints), prints)])
        if not len(some):
            return _SUSPECT.empty_table()
        raw, at = chunk_texts(row)
        norm = [raw[at[i] : at[i + 1]].tobytes().translate(None, _SPACES) for i in some.tolist()]
        ids = pa.array(np.frombuffer(row["ids"], np.int64)[some])
        return pa.Table.from_arrays([ids, _docs(row).take(pa.array(some)), pa.array(chars[some]), pa.array([x.tobytes() for x in shas[some]], pa.binary()), pa.array(norm, pa.binary())], schema=_SUSPECT)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shas = _digest_rows(row)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["ids"], np.int64)), _docs(row), pa.array([x.tobytes() for x in shas], pa.binary())], names=["row_id", "doc_id", "sha"])


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, chunk_bytes: int = 16 << 20, owner_rows: int = 2_000_000, spare_bits: int = 14, broadcast_rows: int = 250_000) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space (space, U+0009 to U+000D) is deleted; null counts as empty. The row
    with the most code points in its original text stays, of those the one with the smallest id (null last). Of rows that
    agree in all of that, exactly one stays. Ids become longs. Columns of docs other than id and text are not read. row_col
    names a column of unique longs if docs has one; otherwise rows are numbered here. An empty table gives an empty result.

    An owner gets about owner_rows fingerprints, so their number grows with the input. Fingerprints are log2(rows) +
    spare_bits long; a chance collision only makes a suspect, which the grouping by whole digests clears. Up to broadcast_rows
    groups of equal texts are sent to all executors; more are joined to the rows' digests by a shuffle. Texts that no bitmap
    marks are never shuffled.
    """
    size = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("size"), F.count("*").alias("n")).first()
    n, size = size["n"], size["size"] or 0
    chunks = chunked(docs, "op2-chunks", id_col=id_col, text_col=text_col, row_col=row_col, chunk_bytes=grown(chunk_bytes, size), size=size, more=_digests)
    owners = max(8, -(-n // grown(owner_rows, size)))
    bits = min(64, max(1, n).bit_length() + spare_bits)
    sent = chunks.select("chunk", "ids", "more").mapInArrow(_encode(owners, bits), "chunk long, owner int, n int, coded binary, local binary")
    marks = sent.groupBy("owner").applyInPandas(_answer, "chunk long, owner int, n int, marks binary")
    suspects = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_suspects(bits), "row_id long, doc_id long, chars long, sha binary, norm binary")
    best = F.min(F.struct((-F.col("chars")).alias("fewer"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_id")).alias("best")
    groups = suspects.groupBy("sha").agg(F.count("*").alias("group_size"), best, F.min("norm").alias("low"), F.max("norm").alias("high")).filter("group_size > 1")
    # A group by SHA-256 is one by bytes if its first and last text are the same; anything else ends the run.
    checked = F.when(F.col("low") == F.col("high"), F.col("group_size")).otherwise(F.raise_error(F.lit("different texts share a SHA-256")))
    classes = groups.select("sha", checked.cast("long").alias("group_size"), F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("stay"))
    rows = chunks.select("ids", "docs", "known", "more").mapInArrow(_rows, "row_id long, doc_id long, sha binary")
    # Nothing after this join needs the rows of a text together, so a text that very many rows share is split over tasks.
    out = rows.join(sized(classes, "op2-classes", broadcast_rows), "sha", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_id") == F.col("stay"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row_id",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with all their columns, one row of each group of equal texts."""
    row = unused("row", docs)
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    with scratch(docs.sparkSession) as made:
        gone = sized(exact_groups(numbered, row_col=row).filter("not kept").select(F.col("row_id").alias(row)), "op2-gone")
        made.pop()  # only the rows that go are read from here on
    return numbered.join(gone, row, "left_anti").select(*same_columns(docs))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")


ORACLE = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS rank,
             first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, rank = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
