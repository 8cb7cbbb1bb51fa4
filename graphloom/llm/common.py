"""What the training-data operators share: shared storage, chunks of texts, word rules, byte views of Arrow text, Rice coding."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.sources.storage import delete_at_exit, materialize, shared_dir

#: The white space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one round of array work takes; a longer text is taken alone and whole.
ROUND_BYTES = 1 << 21


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def unused(name: str, df: DataFrame) -> str:
    """A column name that df hasn't."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def named(column: str) -> Column:
    """A column by its whole name, which may hold dots or backticks."""
    return F.col("`" + column.replace("`", "``") + "`")


def same_columns(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def numbered_columns(columns: tuple[str, ...]) -> list[Column]:
    """Columns by number: functions over Arrow batches don't take names with dots or backticks."""
    return [named(c).alias(f"c{i}") for i, c in enumerate(columns)]


def with_fields(df: DataFrame, columns: tuple[str, ...], fields: str) -> T.StructType:
    """The schema of some columns of df and of more fields."""
    return T.StructType([*[df.schema[c] for c in columns], *T._parse_datatype_string(fields).fields])


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends here, and lost executors cost no more than a read."""
    return materialize(df, name)


#: Rows of a few longs each that a join may send to all executors: some tens of MB.
BROADCAST_ROWS = 1_000_000


def sized(keys: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of keys (a few longs a row), written and counted: marked for broadcast if it has at most `most` rows; a larger one is
    left to a shuffled join."""
    made = table(keys, name)
    return F.broadcast(made) if made.count() <= most else made


def rounds(lengths: np.ndarray, most: int = ROUND_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each of at most `most` bytes or of one row."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets between them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


#: Bytes of text that a bucket is meant to hold.
BUCKET_BYTES = 256 << 20


def buckets_for(size: int, partitions: int, most: int) -> int:
    """How many buckets hold size bytes: as many as shuffles have partitions, or more where those would hold more than BUCKET_BYTES."""
    return min(most, max(partitions, -(-size // BUCKET_BYTES)))


def bucketed(df: DataFrame, name: str, by: str, size: int) -> DataFrame:
    """df, which holds size bytes of text, as a table in the shared folder in buckets of a column: grouping by that column then moves
    none of its rows. The catalog holds the table only until it is read."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    at = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = buckets_for(size, int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, by).saveAsTable(at, format="parquet")
    delete_at_exit(spark, path)
    made = spark.table(at)
    made.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {at}")  # external: the files stay
    return made


#: A row for each chunk: the ids of its rows, their documents' ids (and which are known), the offsets of their texts, the texts
#: themselves, compressed, a measure of them, and what else is kept of them.
CHUNK = "chunk long, ids binary, docs binary, known binary, at binary, text binary, n long, more binary"


def chunked(docs: DataFrame, name: str, *, id_col: str, text_col: str, row_col: str | None, chunk_bytes: int, size: int, measure: Callable[[np.ndarray, np.ndarray], int] = lambda raw, at: len(raw), more: Callable[[np.ndarray, np.ndarray], bytes] = lambda raw, at: b"") -> DataFrame:
    """docs, whose texts have size bytes, as chunks (CHUNK) of about chunk_bytes or of one text, bucketed by chunk: no text is
    shuffled, now or later."""
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    read = docs.select(number.alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            ids, doc = batch.column("row_id").to_numpy(), batch.column("doc_id")
            known, doc = np.array(doc.is_valid()), doc.fill_null(0).to_numpy()
            for a, b in rounds(np.diff(offsets), chunk_bytes):
                part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                row = (int(ids[a]), ids[a:b].tobytes(), doc[a:b].tobytes(), known[a:b].tobytes(), at.tobytes(), pa.compress(part.tobytes(), "zstd", asbytes=True), measure(part, at), more(part, at))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[c.split()[0] for c in CHUNK.split(", ")])

    return bucketed(read.mapInArrow(run, CHUNK), name, "chunk", size)


def chunk_texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a chunk's texts and the offsets between them."""
    offsets = np.frombuffer(row["at"], np.int64)
    return np.frombuffer(pa.decompress(row["text"], int(offsets[-1]), "zstd", asbytes=True), np.uint8), offsets


def grown(size: int, total: int, beyond: int = 1 << 40) -> int:
    """size, times the square root of what total is of `beyond` bytes: if chunks and owners both grow so, the messages between them
    grow in proportion to the input and not with its square."""
    return int(size * max(1.0, total / beyond) ** 0.5)


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of values[start:end] for each range; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in SPACES]] = True


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words by byte, and the n + 1 offsets of each text's words in them."""
    inside = ~_BREAK[raw]
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    first = first[: len(raw)]
    starts = np.flatnonzero(inside & (~before | first))
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    last = np.zeros(len(raw) + 1, bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(inside & (~after | last[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as Golomb-Rice coded gaps: a header, the unary quotients, then the remainders by plane: whole
    low bytes first, then the bits above them."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    mean = max(1, int(values[-1]) // n)
    k = max(0, mean.bit_length() - 1)
    q = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + n, np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    out = [np.array([n, k, len(unary)], "<u8").tobytes(), np.packbits(unary).tobytes()]
    for j in range(k // 8):
        out.append((gaps >> np.uint64(8 * j)).astype(np.uint8).tobytes())
    for j in range(k - k % 8, k):
        out.append(np.packbits((gaps >> np.uint64(j)).astype(np.uint8) & 1).tobytes())
    return b"".join(out)


def rice_decode(blob: bytes) -> np.ndarray:
    """The values that rice_encode took."""
    if not blob:
        return np.zeros(0, np.uint64)
    n, k, bits = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    at = 24 + (bits + 7) // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, at - 24, 24), count=bits))
    gaps = (np.diff(ones, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    for j in range(k // 8):
        gaps |= np.frombuffer(blob, np.uint8, n, at).astype(np.uint64) << np.uint64(8 * j)
        at += n
    for j in range(k - k % 8, k):
        plane = np.frombuffer(blob, np.uint8, (n + 7) // 8, at)
        gaps |= np.unpackbits(plane, count=n).astype(np.uint64) << np.uint64(j)
        at += len(plane)
    return np.cumsum(gaps, dtype=np.uint64)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the 0 up to n, modulo 2**64."""
    out = np.full(min(n, 4095) + 1, base, np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    if n > 4095:
        steps = np.full(n // 4096 + 1, pow(int(base), 4096, 1 << 64), np.uint64)
        steps[0] = 1
        out = (np.cumprod(steps, dtype=np.uint64)[:, None] * out[None, :]).ravel()[: n + 1]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """64-bit hashes of any ranges of some bytes."""

    def __init__(self, raw: np.ndarray):
        self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * powers(_BASE, len(raw))[:-1], dtype=np.uint64)])
        self.low = powers(_BACK, 4095)
        self.high = powers(np.uint64(pow(int(_BACK), 4096, 1 << 64)), len(raw) // 4096)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = self.low[start & 4095] * self.high[start >> 12]
        return mixed((self.total[end] - self.total[start]) * down + (end - start).astype(np.uint64))
