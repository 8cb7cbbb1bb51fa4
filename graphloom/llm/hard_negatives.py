"""Hard negatives: for an anchor and one of its nearest rows of the same label, the nearest rows of other labels within a band of scores.

1. Components become integers; the second moments of all rows give an orthogonal rotation whose leading components carry most.
2. Anchors and rows are cut into blocks, and each block of anchors meets each block of rows once. In a pair of blocks the products
   of leading components are summed step by step; the rest of a product is at most the product of the residual norms. A pair whose
   bound, with slack for rounding, can't reach what its anchor still needs is discarded.
3. Survivors are verified with integer products. Two such searches follow each other: positives first, whose scores then give the
   bands in which negatives are sought.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grown, table

#: Components ahead of each check of the bound, as shares of all.
STEPS = (1 / 8, 1 / 4, 1 / 2)
#: A block whose pairs are down to one in so many goes on pair by pair, else as a whole.
FEW = 32
#: Components below this give products of up to 2**14 components that 64 bits hold.
_LIMIT = 1 << 24
#: No score is as large.
WIDE = (1 << 62) - 1


def integer_rows(rows: DataFrame, *, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """row_id, vec_id, label and v (the floors of scale times the components, four bytes each) of the rows that take part: those with
    a label and a vector whose components are all finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            x = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(x) and np.abs(x).max() >= _LIMIT:
                raise ValueError("a component is too large for exact products")
            ends = np.concatenate([[0], np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            cut = pa.Array.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(4 * ends), pa.py_buffer(x.astype("<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("vec_id"), batch.column("label"), cut.cast(pa.binary())], names=["row_id", "vec_id", "label", "v"])

    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    read = rows.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    return read.filter(F.col("label").isNotNull() & F.coalesce(whole, F.lit(False))).mapInArrow(run, "row_id long, vec_id long, label long, v binary")


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; a shorter one ends in zeros."""
    if {len(b) for b in blobs} == {4 * width}:
        return np.frombuffer(b"".join(blobs), "<i4").reshape(-1, width).astype(np.int64)
    out = np.zeros((len(blobs), width), np.int64)
    for i, b in enumerate(blobs):
        v = np.frombuffer(b, "<i4")
        out[i, : len(v)] = v
    return out


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """An orthogonal matrix whose columns are the principal axes of all rows' vectors, the strongest first. Tasks send their sums of
    products, width squared numbers each; the driver gets as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("v").to_pylist(), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "s"])

    moments = np.zeros(width * width)
    for r in rows.select("v").mapInArrow(run, "cell int, s double").groupBy("cell").agg(F.sum("s").alias("s")).collect():
        moments[r["cell"]] = r["s"]
    moments = moments.reshape(width, width)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()


def products(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 15) -> np.ndarray:
    """The inner products of rows i of x and j of y, `most` at a time."""
    out = np.empty(len(i), np.result_type(x, y))
    for a in range(0, len(i), most):
        out[a : a + most] = np.einsum("ij,ij->i", x[i[a : a + most]], y[j[a : a + most]])
    return out


class Pruner:
    """Products of anchors and rows, but only of pairs that may matter."""

    def __init__(self, axes: np.ndarray, anchors: np.ndarray, rows: np.ndarray):
        self.anchors, self.rows = anchors, rows
        self.a, self.b = anchors @ axes, rows @ axes
        width = axes.shape[0]
        self.cuts = sorted({max(1, round(width * s)) for s in STEPS} | {width})
        norms = np.sqrt((self.a**2).sum(1)), np.sqrt((self.b**2).sum(1))
        # What the axes lack of being orthogonal, and what sums of `width` rounded products can be off.
        loose = np.linalg.norm(axes.T @ axes - np.eye(width)) + 8 * width * np.finfo(float).eps
        self.slack = loose * (norms[0].max(initial=0) * norms[1].max(initial=0)) + 1e-6
        self.rest = {k: (self._tail(self.a, k), self._tail(self.b, k)) for k in self.cuts}
        self.seen = np.zeros(len(self.cuts) + 2, np.int64)  # pairs, those left after each cut, those verified

    @staticmethod
    def _tail(x: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt((x[:, k:] ** 2).sum(1))

    def survivors(self, cols: slice, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, rows and exact scores of the allowed pairs whose score may lie from low to high (by anchor)."""
        self.seen[0] += np.count_nonzero(allowed)
        whole, start = np.zeros(allowed.shape), 0
        i = j = part = None  # the pairs that are left, once they are few
        for n, k in enumerate(self.cuts):
            rest_a, rest_b = self.rest[k]
            if i is None:
                whole += self.a[:, start:k] @ self.b[cols, start:k].T
                left = rest_a[:, None] * rest_b[cols][None, :] + self.slack
                allowed = allowed & (whole + left >= low[:, None]) & (whole - left <= high[:, None])
                many = np.count_nonzero(allowed)
                if many * FEW <= allowed.size or k == self.cuts[-1]:
                    i, j = np.nonzero(allowed)
                    part, j = whole[i, j], j + cols.start
            else:
                part = part + products(self.a[:, start:k], self.b[:, start:k], i, j)
                left = rest_a[i] * rest_b[j] + self.slack
                keep = (part + left >= low[i]) & (part - left <= high[i])
                i, j, part = i[keep], j[keep], part[keep]
                many = len(i)
            start = k
            self.seen[n + 1] += many
        score = products(self.anchors, self.rows, i, j)
        good = (score >= low[i]) & (score <= high[i])
        self.seen[-1] += good.sum()
        return i[good], j[good], score[good]


def first_of(owner: np.ndarray, score: np.ndarray, unknown: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """The positions of each owner's first `most`, by falling score, then id (unknown ones last), then row."""
    order = np.lexsort((rows, ids, unknown, -score, owner))
    own = owner[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
    return order[rank < most]


def best_in_block(axes: np.ndarray, anchors: pd.DataFrame, rows: pd.DataFrame, same: bool, most: int, pairs: int = 1 << 18) -> pd.DataFrame:
    """The first `most` rows for each anchor row and each of its bands of scores (low and high, lists) among rows: of its label or of
    others. About `pairs` pairs are in memory at a time."""
    width, bands = axes.shape[0], max(map(len, anchors["low"]), default=0)
    a_label, b_label = anchors["label"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
    a_row, b_row = anchors["row_id"].to_numpy(np.int64), rows["row_id"].to_numpy(np.int64)
    b_id, b_unknown = rows["vec_id"].to_numpy(np.int64), rows["unknown"].to_numpy(bool)
    low, high = np.full((len(a_row), bands), WIDE), np.full((len(a_row), bands), -WIDE)  # a band that an anchor hasn't is empty
    for i, (x, y) in enumerate(zip(anchors["low"], anchors["high"], strict=True)):
        low[i, : len(x)], high[i, : len(y)] = x, y
    vectors = matrix(rows["v"].tolist(), width)
    # Long vectors first: high scores are found early, and the bounds of what comes later are small.
    order = np.argsort(-(vectors.astype(float) ** 2).sum(1), kind="stable")
    vectors, b_label, b_row, b_id, b_unknown = (x[order] for x in (vectors, b_label, b_row, b_id, b_unknown))
    pruner = Pruner(axes, matrix(anchors["v"].tolist(), width), vectors)
    kept = [np.zeros(0, np.int64)] * 3  # anchor and band, row, score
    step = max(64, pairs // max(1, len(low)))
    for at in range(0, len(vectors) if low.size else 0, step):
        cols = slice(at, min(at + step, len(vectors)))
        allowed = (a_label[:, None] == b_label[cols][None, :]) == same
        allowed &= a_row[:, None] != b_row[cols][None, :]
        i, j, score = pruner.survivors(cols, low.min(1), high.max(1), allowed)
        hit, band = np.nonzero((score[:, None] >= low[i]) & (score[:, None] <= high[i]))
        kept = [np.concatenate(x) for x in zip(kept, (i[hit] * bands + band, j[hit], score[hit]), strict=True)]
        top = first_of(kept[0], kept[2], b_unknown[kept[1]], b_id[kept[1]], b_row[kept[1]], most)
        kept = [x[top] for x in kept]
        # A band that has its number of rows needs no lower score than the last of them.
        many = np.bincount(kept[0], minlength=low.size) == most
        last = np.full(low.size, WIDE)
        np.minimum.at(last, kept[0], kept[2])
        low.ravel()[many] = np.maximum(low.ravel()[many], last[many])
    owner, j, score = kept
    i, band = owner // max(1, bands), owner % max(1, bands)
    return pd.DataFrame({"key": a_row[i], "band": band, "found_row": b_row[j], "found_id": pd.arrays.IntegerArray(b_id[j], b_unknown[j]), "score": score})


def search(anchors: DataFrame, rows: DataFrame, axes: np.ndarray, *, same: bool, most: int, anchor_block: int, row_block: int) -> DataFrame:
    """For each of anchors (row_id, label, v, and lists low and high: bands of scores) and each band the first `most` of rows with
    another row_id, a score in the band and the same label or another: row_id, band, found_row, found_id, score, rank. Each block of
    anchors meets each block of rows."""
    a_blocks, b_blocks = (max(1, -(-df.count() // n)) for df, n in ((anchors, anchor_block), (rows, row_block)))
    left = anchors.withColumn("a", F.pmod(F.xxhash64("row_id"), F.lit(a_blocks))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(b_blocks - 1)).cast("array<long>")))
    known = rows.select("row_id", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("unknown"), "label", "v")
    right = known.withColumn("b", F.pmod(F.xxhash64("row_id"), F.lit(b_blocks))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a_blocks - 1)).cast("array<long>")))

    def run(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        return best_in_block(axes, ours, theirs, same, most)

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(run, "key long, band int, found_row long, found_id long, score long")
    order = Window.partitionBy("key", "band").orderBy(F.col("score").desc(), F.col("found_id").asc_nulls_last(), "found_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).withColumnRenamed("key", "row_id")


def hard_negatives(rows: DataFrame, *, anchors: Callable | None = None, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_block: int = 2048, row_block: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which anchors(id column) holds; by default those whose id is divisible by 50. An anchor's positives are
    its first `positives` other rows of its label (all, if there are fewer), by falling integer inner product, ties by smaller id (null
    last, then any order that reruns share). A positive's negatives are the first `negatives` rows of other labels whose scores lie
    from band[0] to band[1] hundredths of the positive's; those it has none of give no row. Rows with a null label, a null vector or
    a null or non-finite component take no part; a shorter vector ends in zeros; an empty vector scores 0. Components of 2**24 and
    more after scaling raise. Repeated rows are rows of their own. An empty table gives an empty result. Other columns are not read.

    Anchors times rows are many by definition, so blocks grow with the root of their number and each is sent to as many tasks as
    the others have blocks.
    """
    held = table(integer_rows(rows, scale=scale, id_col=id_col, vector_col=vector_col, label_col=label_col), "op13-rows")
    return mined(held, anchors=anchors, positives=positives, negatives=negatives, band=band, anchor_block=anchor_block, row_block=row_block)


def mined(held: DataFrame, *, anchors: Callable | None = None, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), anchor_block: int = 2048, row_block: int = 2048) -> DataFrame:
    """hard_negatives() of integer_rows(), written."""
    shape = held.agg(F.max(F.octet_length("v")).alias("width"), F.count("*").alias("n")).first()
    axes = rotation(held, max(1, (shape["width"] or 0) // 4))
    sizes = {"anchor_block": grown(anchor_block, shape["n"], 10**6), "row_block": grown(row_block, shape["n"], 10**6)}
    least, most = band
    chosen = held.filter(F.col("vec_id") % 50 == 0 if anchors is None else anchors(F.col("vec_id")))
    asked = chosen.select("row_id", "label", "v", F.array(F.lit(-WIDE)).alias("low"), F.array(F.lit(WIDE)).alias("high"))
    found = table(search(asked, held, axes, same=True, most=positives, **sizes), "op13-positives")
    # A positive's band: 50 p <= 100 n <= 95 p, in whole numbers; empty below zero.
    low, high = F.expr(f"-((-{least} * score) div 100) + IF(({least} * score) % 100 > 0, 1, 0)"), F.expr(f"({most} * score) div 100 - IF(({most} * score) % 100 < 0, 1, 0)")
    banded = found.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("bands"))  # `positives` at most
    asked = banded.join(chosen.select("row_id", "label", "v"), "row_id").select("row_id", "label", "v", "bands.low", "bands.high")
    near = search(table(asked, "op13-bands"), held, axes, same=False, most=negatives, **sizes)
    named = found.join(chosen.select("row_id", F.col("vec_id").alias("anchor_id")), "row_id").select("row_id", "anchor_id", (F.col("rank") - 1).alias("band"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(near, ["row_id", "band"]).select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


ORACLE = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.a = n.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id) <= 3
"""
