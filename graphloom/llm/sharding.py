"""Sharding: a uniform shuffle of all rows into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows are written once, so that input partitions and their counts stand. Each shard is a row of cells (ranges of its slots), small
   enough for a task.
2. How many rows of a partition go to which cell is one row of the matrix: a draw without replacement, whose sums by partition and by
   cell are exact. It is drawn by halves, down from all partitions to one, so a task draws its own row and needs no other's.
3. A partition's rows are permuted and dealt to cells by these counts; only then does a row move, once, to its cell.
4. Each cell's rows are permuted again, which numbers their slots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grown, same_columns, table, unused
from .draws import draw_counts


def cell_sizes(rows: int, shards: int, cells: int) -> np.ndarray:
    """Rows of each cell, a row for each shard: the shards' counts, and those of a shard's cells, are at most one apart."""
    share = np.array([rows // shards + (k < rows % shards) for k in range(shards)], np.int64)
    return share[:, None] // cells + (np.arange(cells)[None, :] < share[:, None] % cells)


class Dealer:
    """Which cell each row of a partition goes to; counts are the partitions' rows, sizes the cells'."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, seed: int):
        self.counts, self.sizes, self.seed = counts, sizes, seed
        self.before = np.concatenate([[0], np.cumsum(counts)]).tolist()
        self.drawn: dict[tuple[int, int], np.ndarray] = {}
        self.last: tuple[int, np.ndarray | None] = (-1, None)

    def row(self, part: int) -> np.ndarray:
        """A partition's row of the communication matrix: how many of its rows go to each cell."""
        a, b, here = 0, len(self.counts), self.sizes
        while b - a > 1:
            half = (a + b) // 2
            lower = self.drawn.get((a, b))
            if lower is None:
                lower = draw_counts(here, self.before[half] - self.before[a], [self.seed, a, b])
                if len(self.drawn) < 64:  # the widest ranges come first
                    self.drawn[a, b] = lower
            a, b, here = (a, half, lower) if part < half else (half, b, here - lower)
        return here

    def cells(self, part: int) -> np.ndarray:
        """The cells of a partition's rows, in their order."""
        if self.last[0] != part:
            rng = np.random.default_rng([self.seed, part])
            self.last = part, rng.permutation(np.repeat(np.arange(len(self.sizes)), self.row(part)))
        return self.last[1]


def shuffled(docs: DataFrame, shards: int = 8, *, row_col: str | None = None, cell_bytes: int = 8 << 20, seed: int = 3) -> DataFrame:
    """docs with all their columns and shard (from 0) and slot (from 0, gapless in a shard): a uniform random order of all rows,
    cut into shards whose counts are at most one apart. Any columns may be null; repeated rows are rows of their own; an empty table
    gives an empty result. Columns of docs named shard or slot are replaced. The order depends on the seed and on how the rows lie in
    the input's partitions. Cells have about cell_bytes of the columns that are strings or binary, growing with the root of the input
    beyond 1 TB, so that the messages from partitions to cells grow in proportion to it.

    The driver holds a count for each input partition and each cell; a task holds a number for each row of its partition.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    docs = docs.drop("shard", "slot")
    row, part, at, cell, key = (unused(n, docs) for n in ("row", "part", "at", "cell", "key"))
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()), "op12-rows")
    sized = [F.coalesce(F.octet_length(c), F.lit(0)) for c, (_, kind) in zip(same_columns(docs), docs.dtypes, strict=True) if kind in ("string", "binary")]
    size = sum(sized, F.lit(8 * len(docs.columns)))
    found = numbered.groupBy(F.shiftright(row, 33).alias(part)).agg(F.count("*").alias("n"), F.sum(size).alias("size")).collect()  # a row for each partition
    found = sorted((r[part], r["n"], r["size"]) for r in found)
    rows, total = sum(r[1] for r in found), sum(r[2] for r in found)
    cells = max(1, -(-total // (shards * grown(cell_bytes, total))))
    sizes = cell_sizes(rows, shards, cells)
    starts = np.cumsum(sizes, axis=1) - sizes
    place = {p: i for i, (p, _, _) in enumerate(found)}
    dealer = Dealer(np.array([r[1] for r in found], np.int64), sizes.ravel(), seed)

    @F.pandas_udf("long")
    def to_cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            ids = batch.to_numpy(np.int64)
            out = np.empty(len(ids), np.int64)
            parts = ids >> 33
            for p in np.unique(parts).tolist():
                here = parts == p
                out[here] = dealer.cells(place[p])[ids[here] & ((1 << 33) - 1)]
            yield pd.Series(out)

    # The second permutation is the order of a hash of the row's number.
    moved = numbered.withColumn(cell, to_cell(F.col(row))).withColumn(key, F.xxhash64(F.lit(seed), F.col(row)))
    moved = moved.repartition(int(sizes.size), cell)  # a few cells for each task, whatever number of partitions shuffles have
    place_in = F.row_number().over(Window.partitionBy(cell).orderBy(key, row))
    first = docs.sparkSession.createDataFrame(list(enumerate((starts.ravel() - 1).tolist())), f"{cell} long, {at} long")
    out = moved.withColumn(key, place_in).join(F.broadcast(first), cell)  # a row for each cell
    return out.select(*same_columns(docs), F.expr(f"int({cell} div {cells})").alias("shard"), (F.col(key) + F.col(at)).alias("slot"))


def write_shards(docs: DataFrame, folder: str, shards: int = 8, *, seed: int = 3) -> None:
    """The shards as Parquet, in one folder for each; a file holds whole cells, and slot gives the order of its rows."""
    shuffled(docs, shards, seed=seed).write.partitionBy("shard").parquet(folder)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    placed = shuffled(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
