"""Removal of repeated byte strings with suffix arrays that are built by linear grouping.

A window is `length` bytes. Every window has an anchor: of the first `spread` positions in it, the one with the smallest
hash of the 8 bytes there, the leftmost of equals. Equal windows have their anchors at the same place, so only windows whose
anchors have the same bytes after them can be equal. A context is all bytes of an anchor's windows.

1. Texts are packed into chunks. Each chunk sends a hash (the key) of the bytes that all windows of an anchor have in common,
   sorted and Golomb-Rice coded, to owners, which answer with bitmaps of the keys that occur twice.
2. Of those anchors, contexts with the same 128-bit digest become one with a count. A key with a single context needs no more:
   all its windows occur as often as the context.
3. The other contexts are dealt by key. Each part is one suffix array problem over its contexts' bytes, taken in blocks that
   begin at white space and at anchors: suffixes are grouped by their Lyndon prefixes in descending order along
   previous-smaller pointers, and then the order within each group is emitted in one pass, without recursion. A window is the
   suffix that begins at its first block, up to the window's end, and the bytes before that block. Equal windows are neighbours
   in suffix order; bytes decide. A key that very many contexts share is split by ranges of its windows first, and these
   go the same way.
4. The repeated windows go back to all texts that hold their context, and what they cover is cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BREAK, Hashes, chunk_texts, chunked, grown, mixed, rice_decode, rice_encode, rounds, table


def suffix_array(text: list[int]) -> list[int]:
    """The sorted suffixes of integers from 0 up whose last one is smaller than all others and occurs once."""
    n = len(text)
    counts = [0] * (max(text) + 2)
    for c in text:
        counts[c + 1] += 1
    for c in range(1, len(counts)):
        counts[c] += counts[c - 1]
    order, place, group, size = [0] * n, [0] * n, [0] * n, [0] * n
    filled = list(counts)
    for s, c in enumerate(text):
        at = filled[c]
        order[at], place[s], group[s] = s, at, counts[c]
        filled[c] = at + 1
    for first, last in zip(counts, counts[1:], strict=False):
        if last > first:
            size[first] = last - first
    # Groups from the last to the first. A pointer (-2: none yet) goes to the nearest suffix before that is in a lower group.
    smaller = [-2] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for s in order[start:end]:
            if smaller[s] == -2:
                chain, p = [s], s - 1
                while p >= 0 and group[p] >= start:
                    after = smaller[p]
                    if after == -2:  # of this group as well, and so with the same pointer
                        chain.append(p)
                        p -= 1
                    else:
                        p = after
                for c in chain:
                    smaller[c] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + len(chain)
        # Suffixes that more of this group point to come later: they leave their groups first, each time to the group's end.
        by_count: dict[int, list[int]] = {}
        for p, c in pointed.items():
            by_count.setdefault(c, []).append(p)
        for c in range(max(by_count, default=0), 0, -1):
            fresh: dict[int, int] = {}
            for p in by_count.get(c, ()):
                g = group[p]
                size[g] -= 1
                last = g + size[g]
                other = order[last]
                order[place[p]], place[other] = other, place[p]
                order[last], place[p] = p, last
                fresh[g] = fresh.get(g, 0) + 1
            for g, moved in fresh.items():
                new = g + size[g]
                size[new] = moved
                for i in range(new, new + moved):
                    group[order[i]] = new
        end = start
    done = [False] * n
    taken = [0] * n
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            out[g + taken[g]] = s
            taken[g] += 1
            done[s] = True
            s = smaller[s]
    return out


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, spread: int) -> dict[str, np.ndarray]:
    """All anchors of some texts: text (its number), pos, lo and hi (byte positions in raw of the anchor and of the first and
    last window start), key (hash of the bytes that its windows have in common at least)."""
    n = len(raw)
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - length + 1, 0)
    names = ("text", "pos", "lo", "hi", "key")
    if not windows.sum():
        return {c: np.zeros(0, np.uint64 if c == "key" else np.int64) for c in names}
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    gram = np.ndarray(n, "<u8", padded, strides=(1,))  # the 8 bytes from each position
    best = (mixed(gram * _BASE) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    step = 1
    while 2 * step <= spread:
        best = np.minimum(best[:-step], best[step:])
        step *= 2
    if step < spread:
        best = np.minimum(best[: len(best) - (spread - step)], best[spread - step :])
    place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    long = np.flatnonzero(windows)
    begin, stop = offsets[:-1][long], offsets[:-1][long] + windows[long]
    change = np.zeros(n + 1, bool)
    change[1 : len(place)] = place[1:] != place[:-1]
    change[begin] = True
    lo = np.flatnonzero(change)
    of = np.searchsorted(begin, lo, "right") - 1
    inside = (of >= 0) & (lo < stop[of])
    lo, of = lo[inside], of[inside]
    text, pos = long[of], place[lo]
    hi = np.minimum(np.append(lo[1:], n), stop[of]) - 1
    return {"text": text, "pos": pos, "lo": lo, "hi": hi, "key": Hashes(raw).of(pos, pos + length - spread + 1)}


def _digest(before: int, data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(before.to_bytes(8, "little", signed=True) + data, digest_size=size).digest()


def _equal_bytes(raw: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray, width: int) -> np.ndarray:
    """How many of the bytes from x and from y agree, up to `most` (at most width) each."""
    padded = np.concatenate([raw, np.zeros(width, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 1 << 14):
        same = rows[x[a : a + (1 << 14)]] == rows[y[a : a + (1 << 14)]]
        out[a : a + len(same)] = np.minimum(np.where(same.all(axis=1), width, same.argmin(axis=1)), most[a : a + (1 << 14)])
    return out


def repeated_windows(keys: np.ndarray, contexts: list[bytes], before: np.ndarray, counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context (all bytes of an anchor's windows; before: bytes left of the anchor; counts: how often it occurs) a mark
    for each of its windows: does it occur again? Only windows under the same key can be equal; contexts with the same key
    differ, or differ in `before`."""
    n = len(contexts)
    base = np.concatenate([[0], np.cumsum([len(c) for c in contexts])]).astype(np.int64)
    data = b"".join(contexts)
    raw = np.frombuffer(data, np.uint8)
    windows = np.diff(base) - length + 1

    # Symbols: ranks of blocks of bytes, which begin at white space, at contexts and at anchors; 1 after contexts, 0 at the end.
    cut = _BREAK[raw]
    cut[base[:-1] + before] = True
    own = cut[base[:-1]]  # a block that begins only because its context does isn't where equal windows meet
    cut[base[:-1]] = True
    starts = np.flatnonzero(cut)
    owner = np.searchsorted(base, starts, "right") - 1
    blocks = [data[a:b] for a, b in zip(starts.tolist(), np.append(starts[1:], len(raw)).tolist(), strict=True)]
    rank = {x: i for i, x in enumerate(sorted(set(blocks)), 2)}
    at = np.arange(len(starts)) + owner
    symbols = np.ones(len(starts) + n + 1, np.int64)
    symbols[at] = [rank[x] for x in blocks]
    symbols[-1] = 0
    order = np.array(suffix_array(symbols.tolist()), np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))

    # Blocks up to the anchor, those at the same place under the same key together and in suffix order; bytes shared by neighbours.
    ahead = base[owner] + before[owner] - starts
    meets = np.ones(len(starts), bool)
    meets[np.searchsorted(starts, base[:-1])] = own
    some = np.flatnonzero((ahead >= 0) & meets)
    _, kind = np.unique(keys, return_inverse=True)
    kind = kind[owner[some]] * (int(ahead[some].max()) + 1) + ahead[some]
    by = np.lexsort((place[at[some]], kind))
    some, kind = some[by], kind[by]
    rest = base[owner[some] + 1] - starts[some]
    shared = _equal_bytes(raw, starts[some[:-1]], starts[some[1:]], np.minimum(rest[:-1], rest[1:]), length)
    shared = np.concatenate([[0], np.where(kind[1:] == kind[:-1], shared, 0)])
    where = np.empty(len(starts), np.int64)
    where[some] = np.arange(len(some))

    of = np.repeat(np.arange(n), windows)
    start = base[of] + np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(windows)[:-1]]), windows)
    block = np.flatnonzero(meets)[np.searchsorted(starts[meets], start)]
    left = starts[block] - start
    marks = (counts > 1)[of]
    hashes = Hashes(raw)
    for d in np.unique(left).tolist():
        here = np.flatnonzero(left == d)
        run = np.cumsum(shared < length - d)[where[block[here]]]
        head = hashes.of(start[here], start[here] + d)
        by = np.lexsort((head, run))
        x, y = by[:-1], by[1:]
        twin = (run[x] == run[y]) & (head[x] == head[y])
        x, y = here[x[twin]], here[y[twin]]
        twin = _equal_bytes(raw, start[x], start[y], np.full(len(x), d), max(d, 1)) == d
        marks[x[twin]] = marks[y[twin]] = True
    return np.split(marks, np.cumsum(windows)[:-1])


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """The ranges (first, last) of marks that hold."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], marks, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges on one line, united where they overlap or touch."""
    by = np.argsort(start, kind="stable")
    start, far = start[by], np.maximum.accumulate(end[by])
    first = np.flatnonzero(np.append(True, start[1:] > far[:-1])) if len(start) else np.zeros(0, np.int64)
    return start[first], far[np.append(first[1:], len(start)) - 1] if len(start) else far


def _parts(row: dict):
    """Rounds of a chunk's texts: row ids, bytes, offsets."""
    raw, offsets = chunk_texts(row)
    ids = np.frombuffer(row["ids"], np.int64)
    for a, b in rounds(np.diff(offsets)):
        yield ids[a:b], raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _sent(owners: int, bits: int, length: int, spread: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = [anchors(raw, offsets, length, spread)["key"] for _, raw, offsets in _parts(row)]
                found, counts = np.unique(np.concatenate(keys) >> np.uint64(64 - bits), return_counts=True)
                if not len(found):
                    continue
                owner = ((found >> np.uint64(bits - 32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
                out = [(row["chunk"], int(owner[a]), b - a, rice_encode(found[a:b]), np.packbits(counts[a:b] > 1).tobytes()) for a, b in zip(edges, [*edges[1:], len(owner)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "owner", "n", "coded", "local"])

    return run


def _answer(sent: pd.DataFrame) -> pd.DataFrame:
    """One owner's keys that occur twice, for each chunk that holds them, coded as they came."""
    parts = [rice_decode(x) for x in sent["coded"]]
    local = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(sent["local"], sent["n"], strict=True)]
    found, where, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    twice = ((counts > 1) | (np.bincount(where, np.concatenate(local), len(found)) > 0))[where]
    marks = np.split(twice, np.cumsum([len(x) for x in parts])[:-1])
    return pd.DataFrame({"chunk": sent["chunk"], "owner": sent["owner"], "marks": [np.packbits(m).tobytes() for m in marks], "n": sent["n"]})


_FOUND = pa.schema([("chunk", pa.int64()), ("row_id", pa.int64()), ("pos", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("key", pa.int64()), ("full", pa.binary())])


def _repeated(bits: int, length: int, spread: int):
    def run(chunk: pa.Table, marks: pa.Table) -> pa.Table:
        if not len(chunk) or not len(marks):
            return _FOUND.empty_table()
        parts = [(ids, raw, offsets, anchors(raw, offsets, length, spread)) for row in chunk.to_pylist() for ids, raw, offsets in _parts(row)]
        keys = np.unique(np.concatenate([p[3]["key"] for p in parts]) >> np.uint64(64 - bits))
        marks = marks.sort_by("owner")
        twice = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(marks.column("marks").to_pylist(), marks.column("n").to_pylist(), strict=True)]).astype(bool)
        out, number = [], chunk.column("chunk")[0].as_py()
        for ids, raw, offsets, a in parts:
            keep = twice[np.searchsorted(keys, a["key"] >> np.uint64(64 - bits))]
            text, data = a["text"][keep], raw.tobytes()
            pos, lo, hi = (a[c][keep] for c in ("pos", "lo", "hi"))
            full = [_digest(p - x, data[x : y + length]) for p, x, y in zip(pos.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            place = [pa.array(x - offsets[text]) for x in (pos, lo, hi)]
            out.append(pa.Table.from_arrays([pa.array(np.full(len(text), number)), pa.array(ids[text]), *place, pa.array(a["key"][keep].view(np.int64)), pa.array(full, pa.binary())], schema=_FOUND))
        return pa.concat_tables(out)

    return run


_CONTEXT = "key long, full binary, n long, kinds long, before long, bytes binary"
_CONTEXT_ARROW = pa.schema([("key", pa.int64()), ("full", pa.binary()), ("n", pa.int64()), ("kinds", pa.int64()), ("before", pa.int64()), ("bytes", pa.binary())])


def _contexts(length: int):
    def run(chunk: pa.Table, wanted: pa.Table) -> pa.Table:
        if not len(wanted):
            return _CONTEXT_ARROW.empty_table()
        (row,) = chunk.to_pylist()
        raw, offsets = chunk_texts(row)
        start = dict(zip(np.frombuffer(row["ids"], np.int64).tolist(), offsets[:-1].tolist(), strict=True))
        data = raw.tobytes()
        rows = [data[start[r] + lo : start[r] + hi + length] for r, lo, hi in zip(*(wanted.column(c).to_pylist() for c in ("row_id", "lo", "hi")), strict=True)]
        before = wanted.column("pos").to_numpy() - wanted.column("lo").to_numpy()
        return pa.Table.from_arrays([*[wanted.column(c) for c in ("key", "full", "n", "kinds")], pa.array(before), pa.array(rows, pa.binary())], schema=_CONTEXT_ARROW)

    return run


_RANGES = "array<struct<first:bigint,last:bigint>>"


def _judge(length: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        marks = repeated_windows(part["key"].to_numpy(), part["bytes"].tolist(), part["before"].to_numpy(), part["n"].to_numpy(), length)
        runs = [_runs(m) for m in marks]
        return pd.DataFrame({"key": part["key"], "full": part["full"], "runs": [[{"first": a, "last": b} for a, b in r] for r in runs]})[[bool(r) for r in runs]]

    return run


def _split(length: int, width: int):
    """Contexts cut into ranges of `width` windows by their distance to the anchor, under keys of what a range's windows share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                near, far = r.before - (len(r.bytes) - length), r.before
                for q in range(near // width, far // width + 1):
                    first, last = r.before - min(far, q * width + width - 1), r.before - max(near, q * width)
                    common = r.bytes[r.before - q * width : r.before - (q * width + width - 1) + length]
                    key = int.from_bytes(_digest(q, r.key.to_bytes(8, "little", signed=True) + common, 8), "little", signed=True)
                    data = r.bytes[first : last + length]
                    rows.append((r.key, r.full, first, key, _digest(r.before - first, data), r.n, r.before - first, data))
            yield pd.DataFrame(rows, columns=["whole", "whole_full", "shift", "key", "full", "n", "before", "bytes"])

    return run


def _verdicts(counted: DataFrame, length: int, part_rows: int, hot: int, widths: tuple[int, ...]) -> DataFrame:
    """key, full and runs (ranges of windows that occur again) of contexts, which are distinct by key and full. counted is a
    table of them; kinds: how many have the same key."""
    # A context that is alone under its key: all or none of its windows occur again.
    lone = counted.filter("kinds = 1 AND n > 1").select("key", "full", F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.octet_length("bytes") - length).cast("long").alias("last"))).alias("runs"))
    few = counted.filter(F.col("kinds") > 1)
    if widths:
        few = few.filter(F.col("kinds") <= hot)
    parts = max(1, -(-few.count() // part_rows))
    out = few.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).repartition(parts, "part").groupBy("part").applyInPandas(_judge(length), f"key long, full binary, runs {_RANGES}").unionByName(lone)
    many = counted.filter(F.col("kinds") > hot)
    if not widths or many.isEmpty():
        return out
    pieces = table(many.drop("kinds").mapInPandas(_split(length, widths[0]), "whole long, whole_full binary, shift long, key long, full binary, n long, before long, bytes binary"), "op7-pieces")
    distinct = table(pieces.groupBy("key", "full").agg(F.sum("n").alias("n"), F.first("before").alias("before"), F.first("bytes").alias("bytes")), "op7-pieces")
    kinds = distinct.groupBy("key").agg(F.count("*").alias("kinds"))
    finer = _verdicts(table(distinct.join(kinds, "key"), "op7-pieces"), length, part_rows, hot, widths[1:])
    shifted = F.transform("runs", lambda r: F.struct((r["first"] + F.col("shift")).alias("first"), (r["last"] + F.col("shift")).alias("last")))
    return out.unionByName(pieces.select("whole", "whole_full", "shift", "key", "full").join(finer, ["key", "full"]).select(F.col("whole").alias("key"), F.col("whole_full").alias("full"), shifted.alias("runs")))


_OUT = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _cut(length: int):
    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        if not len(chunk):
            return _OUT.empty_table()
        (row,) = chunk.to_pylist()
        raw, offsets = chunk_texts(row)
        ids, sizes = np.frombuffer(row["ids"], np.int64), np.diff(offsets)
        docs = pa.array(np.frombuffer(row["docs"], np.int64), mask=~np.frombuffer(row["known"], bool))
        # All texts of the chunk on one line, a byte apart, so that ranges of different texts never touch.
        line = offsets[:-1] + np.arange(len(sizes))
        runs = found.column("runs").combine_chunks()
        many = np.diff(runs.offsets.to_numpy())
        by = np.argsort(ids)
        at = by[np.searchsorted(ids[by], found.column("row_id").to_numpy())] if len(found) else np.zeros(0, np.int64)
        base = np.repeat(line[at] + found.column("lo").to_numpy(), many)
        start, end = united(base + runs.flatten().field("first").to_numpy(), base + runs.flatten().field("last").to_numpy() + length)
        of = np.searchsorted(line, start, "right") - 1
        start, end = start - line[of], end - line[of]
        edge = np.searchsorted(of, np.arange(len(sizes) + 1))
        spans = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["start", "end"]))
        data, kept = raw.tobytes(), []
        for i, first in enumerate(offsets[:-1].tolist()):
            cuts = [first, *(first + np.stack([start[edge[i] : edge[i + 1]], end[edge[i] : edge[i + 1]]], axis=1).ravel()).tolist(), int(offsets[i + 1])]
            kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)))
        return pa.Table.from_arrays([pa.array(ids), docs, pa.array(sizes), spans, pa.array(kept, pa.binary())], schema=_OUT)

    return run


def cut_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, spread: int = 150, chunk_bytes: int = 16 << 20, owner_rows: int = 1_000_000, part_rows: int = 4_000, hot: int = 4_000, widths: tuple[int, ...] = (16, 1)) -> DataFrame:
    """row_id, doc_id, n_bytes, spans and kept of each row of docs: every byte of the UTF-8 text that a string of `length` bytes
    covers which also starts anywhere else, in the same or another text, is cut out. spans: the maximal ranges cut, by byte;
    kept: the other bytes.

    Strings are judged on the texts as they come; overlaps count; matches never cross texts. Null and empty texts have no
    bytes; copies and repeated rows all lose what they share; an empty table gives an empty result; other columns are not read.
    Ids become longs. A key that more than `hot` different contexts share is split into ranges of widths[0] windows, each under
    a key of its own, and what is still so common into ranges of widths[1]; the last width must be 1, where each key has one
    context. Ranges go through suffix arrays like any other context.
    """
    if not 8 <= spread <= length - 8:
        raise ValueError("spread must lie between 8 and length - 8")
    if not widths or widths[-1] != 1 or max(widths) > length - 8:
        raise ValueError("widths must end with 1 and lie below length - 8")
    total = docs.select(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    rows = chunked(docs, "op7-chunks", id_col=id_col, text_col=text_col, row_col=None, chunk_bytes=grown(chunk_bytes, total), size=total)
    owners = max(8, -(-total // (spread // 2 * grown(owner_rows, total))))  # there is an anchor in about every spread / 2 bytes
    bits = min(64, max(32, max(1, total).bit_length() + 12))
    sent = rows.mapInArrow(_sent(owners, bits, length, spread), "chunk long, owner int, n int, coded binary, local binary")
    marks = sent.groupBy("owner").applyInPandas(_answer, "chunk long, owner int, marks binary, n int")
    found = rows.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_repeated(bits, length, spread), "chunk long, row_id long, pos long, lo long, hi long, key long, full binary")
    found = table(found, "op7-anchors")

    # first() takes all its values of a group from one row, whichever it is: equal contexts have equal bytes.
    contexts = found.groupBy("key", "full").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("chunk", "row_id", "pos", "lo", "hi")])
    contexts = table(contexts, "op7-contexts")
    keys = contexts.groupBy("key").agg(F.count("*").alias("kinds"))
    # Only contexts that share their key need their bytes; those alone under it have been counted already.
    lone = contexts.filter("n > 1").join(keys.filter("kinds = 1"), "key").select("key", "full", F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.col("hi") - F.col("lo")).alias("last"))).alias("runs"))
    wanted = contexts.join(keys.filter("kinds > 1"), "key").select("chunk", "row_id", "pos", "lo", "hi", "key", "full", "n", "kinds")
    context = rows.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(_contexts(length), _CONTEXT)
    verdicts = _verdicts(table(context, "op7-bytes"), length, part_rows, hot, widths).unionByName(lone)
    gone = found.join(verdicts, ["key", "full"]).select("chunk", "row_id", "lo", "runs")
    return rows.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(_cut(length), "row_id long, doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
