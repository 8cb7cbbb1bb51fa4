"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by retained offsets.

Pre-tokenisation does what the public pattern does, without a regular expression: every code point gets a class from an
array; each class is a function from a state of a small automaton to the next state; as composing such functions is
associative, the states before all characters are found by a scan in blocks (the function of each block, a doubling scan
over blocks, then all blocks at once from their known states). State and class say where a slice starts. Each slice's
merges are made once and cached.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered_columns, rounds, unused, utf8, with_fields

# Classes of characters. END stands after each text.
LETTER, NUMBER, OTHER, SPACE, BLANK, SHORT, LONG, END = range(8)
# States: what the characters before have come to. CUT2 and CUT1: two or one more character of a contraction to come.
FRESH, AFTER_SPACE, AFTER_BLANK, IN_LETTERS, IN_NUMBERS, IN_OTHERS, CUT2, CUT1 = range(8)
# Unicode white space besides U+0020.
_BLANKS = (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _next_state(state: int, kind: int) -> int:
    if kind == END:
        return FRESH
    if state == CUT2:
        return CUT1
    if state == CUT1:
        return FRESH
    if kind in (SHORT, LONG):
        if state in (AFTER_SPACE, IN_OTHERS):
            return IN_OTHERS
        return CUT1 if kind == SHORT else CUT2
    return {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK}[kind]


def _starts(state: int, kind: int, followed: int) -> bool:
    """Does a slice start at a character? followed: what comes next is not white space and in the same text."""
    if kind == END or state in (CUT2, CUT1):
        return False
    if state == FRESH:
        return True
    if kind in (SPACE, BLANK):
        return bool(followed) if state in (AFTER_SPACE, AFTER_BLANK) else True
    if state in (AFTER_SPACE, AFTER_BLANK):
        return state == AFTER_BLANK
    return {IN_LETTERS: LETTER, IN_NUMBERS: NUMBER, IN_OTHERS: OTHER}[state] != (OTHER if kind in (SHORT, LONG) else kind)


_NEXT = np.array([[_next_state(s, k) for s in range(8)] for k in range(8)], np.uint8)
_START = np.array([[[_starts(s, k, f) for f in range(2)] for k in range(8)] for s in range(8)], bool)


def class_table() -> np.ndarray:
    """The class of every code point: letters and numbers by general category, Unicode white space, others."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            out[c] = LETTER if major == "L" else NUMBER
    out[list(_BLANKS)] = BLANK
    out[32] = SPACE
    return out


def scan(kinds: np.ndarray, width: int = 512) -> np.ndarray:
    """The state before each character, from FRESH, by composing the functions that the characters stand for."""
    n = len(kinds)
    blocks = -(-n // width)
    padded = np.full(blocks * width, END, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in columns:
        whole = _NEXT[column[:, None], whole]
    step = 1
    while step < blocks:
        whole[step:] = np.take_along_axis(whole[step:], whole[:-step], axis=1)
        step *= 2
    state = np.full(blocks, FRESH, np.uint8)
    state[1:] = whole[:-1, FRESH]
    out = np.empty((width, blocks), np.uint8)
    for i, column in enumerate(columns):
        out[i] = state
        state = _NEXT[column, state]
    return out.T.reshape(-1)[:n]


def slices(texts: list[str], classes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts in UTF-8, the n + 1 byte offsets of all slices, and the number of slices of each text."""
    if not texts:
        return b"", np.zeros(1, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), np.uint32)
    stop = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds = classes[code]
    kinds[stop] = END
    marks = np.flatnonzero((code[:-2] == 39) & (kinds[:-2] == OTHER))
    a = np.where(kinds[marks + 1] == END, 0, code[marks + 1])
    b = np.where((a == 0) | (kinds[marks + 2] == END), 0, code[marks + 2])
    kinds[marks[np.isin(a, [ord(c) for c in "stmd"])]] = SHORT
    kinds[marks[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]] = LONG
    blank = (kinds == SPACE) | (kinds == BLANK) | (kinds == END)
    followed = np.zeros(len(kinds), np.uint8)
    followed[:-1] = ~blank[1:]
    start = _START[scan(kinds), kinds, followed]
    size = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    size[stop] = 0
    where = np.cumsum(size) - size
    at = np.flatnonzero(start)
    count = np.diff(np.searchsorted(at, stop), prepend=0)
    return "".join(texts).encode(), np.append(where[at], size.sum()), count


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one slice: of all adjacent pairs, the one of lowest rank, the leftmost of equals, is merged until none is
    left."""
    if piece in ranks:
        return [ranks[piece]]
    return _merge_short(piece, ranks) if len(piece) <= 64 else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge() by looking at all pairs each time."""
    none, get = 1 << 62, ranks.get
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge() with a heap and linked parts, which keeps long slices at n log n."""
    n = len(piece)
    part = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = after[i] if part[i] else n
        if j >= n or len(part[i]) + len(part[j]) != size:
            continue
        part[i], part[j] = part[i] + part[j], b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x in (before[i], i):
            if x >= 0 and after[x] < n and (r := ranks.get(both := part[x] + part[after[x]])) is not None:
                heapq.heappush(heap, (r, x, len(both)))
    return [ranks[p] for p in part if p]


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a .tiktoken file: a line for each token, base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Coder:
    """Encodes and decodes; remembers the merges of up to `most` slices."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray, most: int = 700_000):
        self.ranks, self.classes, self.most = ranks, classes, most
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        self.text: list[str] = []

    def _known(self, piece: bytes) -> int:
        ids = merge(piece, self.ranks)
        self.number[piece] = found = len(self.ids)
        self.ids.append(ids)
        self.text.append(" ".join(map(str, ids)))
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's slices, into self.ids and self.text; good until the next call."""
        if len(self.ids) > self.most:
            self.clear()
        data, at, count = slices(texts, self.classes)
        edges = at.tolist()
        pieces = [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        found = list(map(self.number.get, pieces))
        for i in [i for i, k in enumerate(found) if k is None]:
            k = self.number.get(pieces[i])
            found[i] = self._known(pieces[i]) if k is None else k
        ends = np.cumsum(count).tolist()
        return [found[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def ids_of(self, numbers: list[int]) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, numbers)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """The byte at which each token starts in the text."""
        return np.cumsum(np.concatenate([[0], self.sizes[np.array(ids, np.int64)]]))[:-1]


def _over_texts(docs: DataFrame, ranks_path: str, text_col: str, columns: tuple[str, ...], fields: str, made) -> DataFrame:
    """The columns of docs and what made(coder, texts) gives (a list of Arrow arrays) for rounds of texts."""
    spark = docs.sparkSession
    # The vocabulary and the class table have fixed sizes of one or two MB.
    shared = spark.sparkContext.broadcast({"ranks": load_ranks(ranks_path), "classes": class_table()})
    whole = unused("text", docs)
    read = docs.select(*numbered_columns(columns), F.col(text_col).cast("string").alias(whole))
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        if "coder" not in held:  # one for each worker: later tasks find its cache filled
            held["coder"] = Coder(held["ranks"], held["classes"])
        for batch in batches:
            text = batch.column(whole).fill_null("")
            _, offsets = utf8(text)
            for a, b in rounds(np.diff(offsets)):
                out = made(held["coder"], text.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], *out], names=[*columns, *names])

    return read.mapInArrow(run, with_fields(docs, columns, fields))


def ranks_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    return public_tokenizers.path(name)


def encode(docs: DataFrame, *, ranks_path: str | None = None, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns, then ids and offsets (the byte at which each token starts) of each whole text.

    Null and empty texts have no ids; special tokens are ordinary text; repeated rows stay; an empty table stays empty.
    """

    def made(coder: Coder, texts: list[str]) -> list[pa.Array]:
        ids = [coder.ids_of(k) for k in coder.encode(texts)]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([coder.offsets(i) for i in ids], pa.list_(pa.int64()))]

    return _over_texts(docs, ranks_path or ranks_file(), text_col, columns, "ids array<int>, offsets array<bigint>", made)


def decode(tokens: DataFrame, *, ranks_path: str | None = None, ids_col: str = "ids", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns, then data (the bytes that the ids stand for; null ids count as none)."""
    shared, held = tokens.sparkSession.sparkContext.broadcast(load_ranks(ranks_path or ranks_file())), unused("ids", tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            data = [b"".join(names[i] for i in ids or ()) for ids in batch.column(held).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(data, pa.binary())], names=[*columns, "data"])

    read = tokens.select(*numbered_columns(columns), F.col(ids_col).alias(held))
    return read.mapInArrow(run, with_fields(tokens, columns, "data binary"))


def digests(docs: DataFrame, *, ranks_path: str | None = None, text_col: str = "text", columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """encode() and decode() in one pass, reduced to n_tokens, ids_sha256 and decoded_sha256."""

    def made(coder: Coder, texts: list[str]) -> list[pa.Array]:
        counts, of_ids, of_bytes = [], [], []
        for numbers in coder.encode(texts):
            ids = coder.ids_of(numbers)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(coder.text.__getitem__, numbers)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    return _over_texts(docs, ranks_path or ranks_file(), text_col, columns, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", made)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
