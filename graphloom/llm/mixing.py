"""Mixing sources to target weights.

1. Each source's documents, in a pseudorandom order, are one stream of words, packed into blocks of a length that is fixed for
   the source: shorter ones where a target is so small that whole blocks would miss it.
2. The mix is a row of slots in shards. How many slots of a shard each source gets is a multinomial draw, given that all shards
   together have each source's slots: drawn by halves, down from the whole row of shards to the single shard, so that a shard
   needs no other shard's draw and knows how many slots of a source lie before it.
3. A source's k-th slot in the whole mix takes the block at position k, round after round, of a pseudorandom permutation of
   the source's block indices, another one in each round; slots and blocks are joined by that index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, numbered_columns, rounds, same_columns, table, unused, utf8, word_bounds
from .draws import draw_counts

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Sources of which the driver keeps a row.
MOST_SOURCES = 1_000_000


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = utf8(batch.column("text"))
        parts = [np.zeros(0, np.int64)]
        for a, b in rounds(np.diff(offsets)):
            parts.append(np.diff(word_bounds(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2]))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row_id", "doc_id", "source", "at", "part")] + [pa.array(np.concatenate(parts), pa.int64())], names=["row_id", "doc_id", "source", "at", "part", "size"])


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Each source's words in a mix of sum(sizes) words, by weight, none above `most` times its size: what is above is
    shared anew by weight among those below, until none is above."""
    out, open_, left = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        full = [left * weights[i] / total > most * sizes[i] for i in open_]
        for i, at_most in zip(open_, full, strict=True):
            out[i] = float(most * sizes[i]) if at_most else left * weights[i] / total
        if not any(full):
            break
        left -= sum(out[i] for i, at_most in zip(open_, full, strict=True) if at_most)
        open_ = [i for i, at_most in zip(open_, full, strict=True) if not at_most]
    return out


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """index through a pseudorandom permutation of 0 to n - 1: a Feistel network over the next even number of bits, walked
    until it lands below n."""
    half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    rng = np.random.default_rng(seed)
    keys = rng.integers(1, 1 << 62, 4, dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for k in keys:
            f = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> np.uint64(32)) & mask)
        return (a << half) | b

    out = once(index.astype(np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def block_length(target: float, most: int) -> int:
    """Words in a source's blocks: `most`, or so few that its target is made up of 32 blocks or more."""
    return max(1, min(most, int(target / 32)))


def shard_draw(shard: int, shards: int, shard_slots: int, slots: np.ndarray, seed: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sources that have slots in a shard, the slots of each before it, and those in it. All shards but the last have shard_slots.

    Only sources that have slots in a range of shards are drawn from, so a small range costs little, however many sources there
    are. seen keeps the widest ranges for the task's next shards.
    """
    some = np.flatnonzero(slots)
    first, last, before, here = 0, shards, np.zeros(len(some), np.int64), slots[some]
    while last - first > 1:
        half = (first + last) // 2
        lower = None if seen is None else seen.get((first, last))
        if lower is None:
            lower = draw_counts(here, (half - first) * shard_slots, [seed, first, last])
            if seen is not None and len(seen) < 64:
                seen[first, last] = lower
        if shard < half:
            last, here = half, lower
        else:
            first, before, here = half, before + lower, here - lower
        has = here > 0
        some, before, here = some[has], before[has], here[has]
    return some, before, here


@dataclass
class Mix:
    """rows: row_id, doc_id, source, size, source_size, target, taken. pieces: row_id, first and last word of a document's
    part of a block (counted from 0, last excluded) and times, how often the mix takes that block (1 or more)."""

    rows: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS, block_words: int = 64, shard_slots: int = 4096, bucket_rows: int = 8192, seed: int = 11) -> Mix:
    """The mix of all of docs that has as many words as docs.

    Sources by code point, null last, have the weights in turn. No block, and so no document, is taken more than `most`
    times. Null and empty texts have size 0 and nothing is taken of them; repeated rows are documents of their own; an empty
    table gives an empty mix. The result depends on ids and texts alone, not on how rows are partitioned: only rows that agree
    in both are told apart by their numbers. The driver and each task hold one row for each source; all else is distributed. There
    can be MOST_SOURCES of them: more, such as hosts, must be grouped before.
    """
    spark = docs.sparkSession
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    text = F.col(text_col).cast("string")
    read = docs.select(number.alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), text.alias("text"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("at"), F.spark_partition_id().alias("part"))
    rows = table(read.mapInArrow(_word_counts, "row_id long, doc_id long, source string, at long, part int, size long"), "op1-sizes")
    by_source = table(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "op1-sources")
    if by_source.count() > MOST_SOURCES:
        raise ValueError(f"there are more than {MOST_SOURCES} sources")
    found = [(r["source"], r["size"], r["rows"]) for r in by_source.collect()]
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-32-be")))
    sizes = [r[1] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    lengths = [block_length(g, block_words) for g in goal]
    blocks = [-(-n // k) for n, k in zip(sizes, lengths, strict=True)]
    slots = np.array([min(most * b, round(g * b / n)) if n else 0 for g, n, b in zip(goal, sizes, blocks, strict=True)], np.int64)
    shards = max(1, -(-int(slots.sum()) // shard_slots))
    sources = spark.createDataFrame(
        [(i, s, n, float(g), int(k), int(b), max(1, -(-r // bucket_rows))) for i, ((s, n, r), g, k, b) in enumerate(zip(found, goal, lengths, blocks, strict=True))],
        "s int, source string, source_size long, target double, length long, blocks long, buckets long",
    )  # a row for each source
    placed = rows.withColumnRenamed("source", "own").join(sources, F.col("own").eqNullSafe(F.col("source"))).drop("own").withColumn("bucket", F.pmod("at", "buckets"))

    # Where each document starts in its source's stream: sums over rows with the same hash in one input partition, which are
    # few even where very many rows are equal, then over those groups within buckets, then over buckets.
    group = ["s", "bucket", "at", "part"]
    within = Window.partitionBy(*group).orderBy("size", "doc_id", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("s", "bucket").orderBy("at", "part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = placed.filter("size > 0")
    groups = filled.groupBy(*group).agg(F.sum("size").alias("n"))
    bases = groups.groupBy("s", "bucket").agg(F.sum("n").alias("n")).select("s", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    firsts = groups.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, ["s", "bucket"]).select(*group, (F.col("base") + F.col("before")).alias("base"))
    starts = filled.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(firsts, group).select("row_id", "s", "size", "length", (F.col("base") + F.col("before")).alias("start"))
    pieces = starts.select("row_id", "s", "size", "length", "start", F.explode(F.expr("sequence(start div length, (start + size - 1) div length)")).alias("block"))
    low, high = F.col("block") * F.col("length") - F.col("start"), (F.col("block") + 1) * F.col("length") - F.col("start")
    pieces = pieces.select("row_id", "s", "block", F.greatest(low, F.lit(0)).alias("first"), F.least(high, "size").alias("last"))

    def slot_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for batch in batches:
            for k in batch["id"].tolist() if slots.sum() else ():
                for s, low, n in zip(*(x.tolist() for x in shard_draw(k, shards, shard_slots, slots, seed, seen)), strict=True):
                    slot, size = np.arange(low, low + n), blocks[s]
                    for turn in range(int(slot[0]) // size, int(slot[-1]) // size + 1):
                        at = slot[slot // size == turn] % size
                        yield pd.DataFrame({"s": np.int32(s), "block": permuted(at, size, seed * 1_000_003 + s * 101 + turn)})

    tasks = min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    times = spark.range(0, shards, 1, tasks).mapInPandas(slot_blocks, "s int, block long").groupBy("s", "block").agg(F.count("*").alias("times"))
    # The rows made of a shard aren't known to Spark, which takes so many for few: no side of this join is to be broadcast.
    taken_pieces = pieces.join(times.hint("merge"), ["s", "block"]).select("row_id", "first", "last", "times")
    taken = taken_pieces.groupBy("row_id").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"))
    result = placed.join(taken, "row_id", "left").select("row_id", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    return Mix(result, taken_pieces)


_WORD = re.compile(WORD_CLASS)


def taken_texts(text: str, parts: list[tuple[int, int, int]]) -> list[str]:
    """The text of each turn that takes something: of turn t, the words of the parts (first, last, times) with times > t.
    A turn that takes all words gives the text unchanged; parts that touch keep the white space between them."""
    parts, out, spans = sorted(parts), [], None
    for turn in range(max(p[2] for p in parts)):
        runs: list[list[int]] = []
        for first, last, times in parts:
            if times > turn and runs and runs[-1][1] == first:
                runs[-1][1] = last
            elif times > turn:
                runs.append([first, last])
        spans = spans or [m.span() for m in _WORD.finditer(text)]
        if runs == [[0, len(spans)]]:
            out.append(text)
        else:
            out.append(" ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs))
    return out


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each document and turn that takes words of it, text those words
    and n_chars its length; documents that the mix takes nothing of have no row."""
    row, held = unused("row", docs), unused("parts", docs)
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    pieces = mix(numbered, row_col=row).pieces
    parts = pieces.groupBy(F.col("row_id").alias(row)).agg(F.collect_list(F.struct("first", "last", "times")).alias(held))
    joined = numbered.join(parts, row).select(*numbered_columns(tuple(docs.columns)), held)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [taken_texts(t, [(p["first"], p["last"], p["times"]) for p in ps]) for t, ps in zip(part.column(at).to_pylist(), part.column(held).to_pylist(), strict=True)]
                rows = pa.array(np.repeat(np.arange(len(texts)), [len(t) for t in texts]))
                columns = [c.take(rows) for c in part.columns[:-1]]
                columns[at] = pa.array([t for ts in texts for t in ts], pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*same_columns(docs)) if "n_chars" in names else out


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).rows.select("doc_id", "size", "source_size", "target", "taken")
