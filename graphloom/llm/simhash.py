"""Near-duplicates by SimHash, searched with tables of distances to reference fingerprints (pivots).

1. Each text gives a 64-bit fingerprint; equal fingerprints become one, with a row of Hamming distances to the pivots. This
   table of distances is written once.
2. Two fingerprints that differ in at most r of 64 bits agree wholly in b - r of b blocks. Each fingerprint is listed once
   under every choice of b - r blocks, so every pair to be found meets in a list; rows of distances go along.
3. By the triangle inequality a pair within r bits has no two coordinates further apart than r: in each list, other pairs are
   discarded without being compared; survivors are verified.
4. A list yields a spanning forest of its links, never all of its pairs; components are joined by label propagation with
   pointer jumping over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rounds, same_columns, sized, table, unused, utf8, word_bounds

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCKS = 4


def fingerprints(raw: np.ndarray, offsets: np.ndarray, words: int = 3, seed: int = 42) -> np.ndarray:
    """The SimHash of each text (bytes and offsets as of utf8()), as uint64; texts without a word give 0."""
    text = raw.tobytes().translate(_LOWER)
    starts, ends, at = word_bounds(raw, offsets)
    n = np.diff(at)
    # All words joined by one space: the bytes of shingles lie together. Words end where texts end, though no white space does.
    data = b" ".join([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    length = ends - starts
    new_end = np.cumsum(length + 1) - 1
    new_start = new_end - length
    shingles = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(shingles.sum())
    last = np.minimum(first + words, np.repeat(at[1:], shingles)) - 1
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(data[a:b], seed) for a, b in zip(new_start[first].tolist(), new_end[last].tolist(), strict=True)), np.uint64, len(first))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        step = 1 << 16
        total = np.zeros((len(some), 64), np.int64)
        owner = np.repeat(np.arange(len(some)), shingles[some])
        for lo in range(0, len(h), step):
            bits = np.unpackbits(h[lo : lo + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            own = owner[lo : lo + step]
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            total[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        over = (2 * total > shingles[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(over, axis=1).view(">u8").ravel()
    return out


def _fingerprint_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            parts = [np.zeros(0, np.uint64)]
            for a, b in rounds(np.diff(offsets)):
                parts.append(fingerprints(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(np.concatenate(parts).view(np.int64))], names=["row_id", "doc_id", "print"])

    return run


def pivot_prints(count: int = 32, seed: int = 7) -> np.ndarray:
    """Reference fingerprints: half of them random, half with one half-byte set, which tell blocks' bit counts apart."""
    half = count // 2
    spread = np.random.default_rng(seed).integers(0, 1 << 63, count - half, dtype=np.uint64) * np.uint64(2)
    return np.concatenate([np.array([0xF << (4 * (i % 16)) for i in range(half)], np.uint64), spread])


def distances(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The table of Hamming distances, a row for each fingerprint."""
    return np.bitwise_count(prints[:, None] ^ pivots[None, :]).astype(np.int16)


def _distance_rows(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = distances(batch.column("print").to_numpy().view(np.uint64), pivots).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("print"), pa.array([x.tobytes() for x in near], pa.binary())], names=["print", "near"])

    return run


def pivot_table(prints: DataFrame, pivots: int = 32) -> DataFrame:
    """print and near of distinct fingerprints (column print, long): its distances to the pivots, a byte each; written."""
    return table(prints.select("print").mapInArrow(_distance_rows(pivot_prints(pivots)), "print long, near binary"), "op9-distances")


def links_of(prints: np.ndarray, near: np.ndarray, most: int, block: int = 512) -> list[tuple[int, int]]:
    """A spanning forest of the links among some fingerprints, as pairs of positions (child, root). near: distances().

    Rows are sorted by their first coordinate, so that only a window of rows can be in reach of a block.
    """
    n = len(prints)
    order = np.argsort(near[:, 0], kind="stable")
    first, root = near[order, 0], np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(0, n, block):
        rows = order[a : a + block]
        end = np.searchsorted(first, first[min(a + block, n) - 1] + most, "right")
        for c in range(a, end, block):
            cols = order[c : min(c + block, end)]
            keep = np.ones((len(rows), len(cols)), bool)
            for p in range(near.shape[1]):
                keep &= np.abs(near[rows, p][:, None] - near[cols, p][None, :]) <= most
                if p % 4 == 3 and not keep.any():
                    break
            x, y = np.nonzero(keep)
            x, y = rows[x], cols[y]
            good = (np.bitwise_count(prints[x] ^ prints[y]) <= most) & (x != y)
            for i, j in zip(x[good].tolist(), y[good].tolist(), strict=True):
                i, j = find(i), find(j)
                if i != j:
                    root[max(i, j)] = min(i, j)
    return [(i, find(i)) for i in range(n) if root[i] != i]


def _list_links(most: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        prints = group["print"].to_numpy(np.int64).view(np.uint64)
        near = np.frombuffer(b"".join(group["near"]), np.uint8).reshape(len(prints), -1).astype(np.int16)
        found = links_of(prints, near, most)
        a, b = (np.array([p[i] for p in found], np.int64) for i in (0, 1))
        return pd.DataFrame({"a": prints[a].view(np.int64), "b": prints[b].view(np.int64)})

    return run


def _keys(prints, blocks: int, width: int, choose: int, base: int = 0):
    """An array of (choice, key) for each choice of blocks that agree, from the bits from base up."""
    out = []
    for i, chosen in enumerate(combinations(range(blocks), choose)):
        mask = sum(((1 << width) - 1) << (base + width * j) for j in chosen)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(i).alias("choice"), prints.bitwiseAND(F.lit(mask)).alias("key")))
    return F.array(*out)


def links(prints: DataFrame, *, most: int = 2, hot: int = 1024) -> DataFrame:
    """Links (a, b) of the distinct fingerprints of a pivot_table() that differ in at most `most` bits (up to 2): not all of
    them, but enough to connect all that are connected.

    A list of more than `hot` fingerprints is listed anew under 28 longer keys of 56 bits, so that no list then has more
    than 256: nothing is dropped.
    """
    if not 0 <= most <= 2:
        raise ValueError("most must be 0, 1 or 2")
    listed = prints.select("print", "near", F.inline(_keys(F.col("print"), _BLOCKS, 16, _BLOCKS - 2)))
    counts = listed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = listed.join(counts, ["choice", "key"])
    small = shared.filter(F.col("n") <= hot).select(F.concat_ws(":", "choice", "key").alias("list"), "print", "near")
    # In a large list two of the four 16-bit blocks agree; of the 16 half-bytes at least 14 agree, so some 6 of the other 8 do.
    large = shared.filter(F.col("n") > hot)
    again = []
    for i, chosen in enumerate(combinations(range(_BLOCKS), _BLOCKS - 2)):
        free = [4 * b + q for b in range(_BLOCKS) if b not in chosen for q in range(4)]
        for j, dropped in enumerate(combinations(free, 2)):
            mask = ((1 << 64) - 1) ^ sum(0xF << (4 * q) for q in dropped)
            mask -= (mask >> 63) << 64
            again.append((i, j, mask))
    by_choice = F.create_map(*[x for i in range(6) for x in (F.lit(i), F.array(*[F.lit(m) for c, _, m in again if c == i]))])
    finer = large.select("choice", "print", "near", F.posexplode(by_choice[F.col("choice")]).alias("j", "mask"))
    finer = finer.select(F.concat_ws(":", F.lit("x"), "choice", "j", F.col("print").bitwiseAND(F.col("mask"))).alias("list"), "print", "near")
    # Comparing takes longer than a list's few bytes tell, so the number of tasks is stated.
    tasks = 4 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return small.unionByName(finer).repartition(tasks, "list").groupBy("list").applyInPandas(_list_links(most), "a long, b long").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Each vertex of the edges (a, b) and the smallest vertex of its component: columns node, root.

    Each round takes the smallest label of a node's neighbours and then its label's label, so that chains shorten by half;
    labels are written to the shared folder, and the driver sees only the number of changes.
    """
    both = table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        nearer = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        after = table(nearer.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        labels = after.select("node", "root")
        if after.filter("was != root").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, words: int = 3, most: int = 2, pivots: int = 32) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable).

    A-Z are lower-cased; words are runs of other than space and U+0009 to U+000D; a text of fewer than `words` words is one
    shingle, one without words (null, empty) has fingerprint zero and is linked like any other. Null ids are never the
    smallest unless a component has no other. Repeated rows share all results. An empty table gives an empty result. row_id
    (row_col, or numbers given here) and root (a component's smallest fingerprint) come as well.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    read = docs.select(number.alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = table(read.mapInArrow(_fingerprint_batches(words), "row_id long, doc_id long, print long"), "op9-rows")
    each = table(rows.groupBy("print").agg(F.min("doc_id").alias("low")), "op9-prints")
    rooted = components(links(pivot_table(each, pivots), most=most)).withColumnRenamed("node", "print")
    named = each.join(rooted, "print", "left").select("print", "low", F.coalesce("root", "print").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(named.join(lowest, "root").select("print", "root", "component_id"), "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "row_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with all their columns, one row of each component: the one with the smallest id, null last."""
    row = unused("row", docs)
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = table(near_groups(numbered, row_col=row), "op9-groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first"))
    gone = groups.select(F.col("row_id").alias(row)).join(first.select(F.col("first.row_id").alias(row)), row, "left_anti")
    return numbered.join(sized(gone, "op9-gone"), row, "left_anti").select(*same_columns(docs))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id", "root")
