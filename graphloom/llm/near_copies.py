"""One text of each group of near copies (Jaccard similarity of five-word shingle sets), found by SimHash and pivots.

1. Each text gives its set of shingle hashes; equal sets become one. Each shingle is hashed to 512 bits; the text's fingerprint
   is their majority (SimHash), in which sets with a similarity of 0.8 differ by 15 % of the bits, unrelated ones by half.
2. Pivots are reference fingerprints. A text's distance to one is the sum of the Hamming distances of its shingles' hashes to it:
   distances to majorities alone would tell less, as those forget how clear each bit was. In 64 tables of three groups of 32
   pivots and their complements, a text is listed under the nearest one of each group. Two sets with a similarity of 0.8 meet in
   no list with a probability of 0.0005, more similar ones with less.
3. In a list each text's nearest one by its fingerprint is a candidate; pairs beyond the bits that near copies differ by are
   discarded. The similarity of the candidates of a text that are nearest over all lists is computed from both whole texts; only
   pairs that reach the bound are linked. So rows grow with the sets and not with their pairs.
4. The lists that the links leave in more than one component are compared in blocks, each set with all sets of other
   components, and the whole texts of those that may be alike decide. Components then hold every link within a list.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.storage import scratch

from .common import Hashes, mixed, rounds, same_columns, sized, table, unused, utf8, word_bounds
from .simhash import components

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bits of a fingerprint, pivots of a group (their complements count too), and the probability that two sets with a similarity of
#: 0.8 are nearest to the same one (measured by test_nearest_pivots).
_BITS, _PIVOTS, _SAME = 512, 32, 0.484
_XOR = np.random.default_rng(17).integers(1, 1 << 63, _BITS // 64 + 2, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Near copies differ in more of the 128 bits that lists hold with a probability under 1e-5.
_FAR_SHORT = 44
#: Sets of a list of which all are compared with each other in one task.
_HOT = 1024
#: A byte's bits as the bytes of a long.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 8).copy().view(np.uint64).ravel()


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, text by text, and the n + 1 offsets of each text's. A-Z are lower-cased; a text
    of fewer than `words` words is one shingle, one without words has none."""
    raw = _LOWER[raw]
    starts, ends, at = word_bounds(raw, offsets)
    word = Hashes(raw).of(starts, ends)
    n = np.diff(at)
    shingles = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(n)), shingles)
    first = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(shingles.sum())
    last = np.repeat(at[1:], shingles)
    h = np.zeros(len(first), np.uint64)
    for k in range(words):
        inside = first + k < last
        h[inside] = mixed(h[inside] * _STEP + word[first[inside] + k] + np.uint64(k + 1))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.searchsorted(owner[new], np.arange(len(n) + 1))


def clear_bits(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set of shingle hashes (offsets at; none is empty) and each of _BITS bits: how many of the shingles' hashes have it
    set, less those that haven't."""
    n = np.diff(at)
    parts = -(-n // 255)  # of at most 255 hashes: eight counts fit into a long
    own = np.concatenate([[0], np.cumsum(parts)])
    cut = np.repeat(at[:-1] - 255 * own[:-1], parts) + 255 * np.arange(own[-1])
    out = np.empty((len(n), _BITS), np.int32)
    for k in range(_BITS // 64):
        octets = mixed(h ^ _XOR[k]).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, j]], cut).view(np.uint8).reshape(-1, 8)
            at_bit = 64 * k + 8 * j
            out[:, at_bit : at_bit + 8] = np.add.reduceat(lanes, own[:-1], axis=0, dtype=np.int32)
    return 2 * out - n[:, None].astype(np.int32)


def shape(sets: int) -> tuple[int, int]:
    """How many tables of how many groups of pivots list so many sets: lists hold some hundred unrelated ones at most, and 0.0005 of
    the pairs with a similarity of 0.8 meet in none."""
    groups = 3 + max(0, math.ceil((math.log2(max(sets, 1)) - 26) / math.log2(2 * _PIVOTS)))
    return math.ceil(math.log(0.0005) / math.log(1 - _SAME**groups)), groups


def pivot_prints(tables: int, groups: int, seed: int = 7) -> np.ndarray:
    """Reference fingerprints, a column each: -1 is a clear bit."""
    return (2 * np.random.default_rng(seed).integers(0, 2, (_BITS, tables * groups * _PIVOTS), dtype=np.int8) - 1).astype(np.float32)


def nearest_pivots(clear: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each row of clear_bits() and each group: the nearest pivot, or _PIVOTS more if its complement is nearest.

    The shingles of a set are at a distance of (n * _BITS - clear @ pivot) / 2 from a pivot, and of what is left of n * _BITS
    from its complement.
    """
    balance = (clear.astype(np.float32) @ pivots).reshape(len(clear), -1, _PIVOTS)
    first = np.abs(balance).argmax(axis=2)
    return first + _PIVOTS * (np.take_along_axis(balance, first[:, :, None], 2)[:, :, 0] < 0)


def _signature_batches(words: int, tables: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = pivot_prints(tables, groups)
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in rounds(np.diff(offsets)):
                h, at = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                n = np.diff(at)
                some = np.flatnonzero(n)
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys, cells, sketch = np.zeros((len(n), tables), np.int64), np.zeros((len(n), tables), np.uint32), np.zeros((len(n), _BITS // 8), np.uint8)
                if len(some):
                    one[some], two[some] = (np.add.reduceat(mixed(h ^ x), at[:-1][some]) for x in _XOR[-2:])
                for c in range(0, len(some), 256):
                    part = some[c : c + 256]
                    low = at[part[0]]
                    clear = clear_bits(h[low : at[part[-1] + 1]], np.append(at[part], at[part[-1] + 1]) - low)
                    near = nearest_pivots(clear, pivots).reshape(len(part), tables, groups)
                    key = np.broadcast_to(np.arange(tables), (len(part), tables))
                    for g in range(groups):
                        key = key * (2 * _PIVOTS) + near[:, :, g]
                    cells[part] = key % (1 << 31)
                    # Sets lie in a list by size: the last 16 bits are 256 times its logarithm.
                    keys[part] = (key << 16) + (256 * np.log2(n[part])).astype(np.int64)[:, None]
                    sketch[part] = np.packbits(clear > 0, axis=1)
                columns = [batch.column(c).slice(a, b - a) for c in ("row_id", "doc_id")]
                columns += [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(n.astype(np.int64))]
                columns += [pa.array(list(keys), pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(x)) for x in sketch[:, :16].copy().view(np.int64).T)]
                columns += [pa.array([s.tobytes() for s in x], pa.binary()) for x in (sketch, cells)]
                yield pa.RecordBatch.from_arrays(columns, names=["row_id", "doc_id", "one", "two", "n", "keys", "print_a", "print_b", "sketch", "cells"])

    return run


def far(n: np.ndarray) -> np.ndarray:
    """Near copies, the smaller of n shingles, differ in more bits of their fingerprints with a probability under 1e-7: a bit differs
    with one of 0.152 in large sets, of more in small ones, in which votes are often equal."""
    p = 0.155 + 0.16 / np.maximum(n, 4)
    return np.ceil(_BITS * p + 5.5 * np.sqrt(_BITS * p * (1 - p))).astype(np.int64)


def _pairs_at(keys: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of a list whose sizes are within the bound, by their distance in the order of keys, up to _HOT."""
    reach, at = math.ceil(-256 * math.log2(least)) + 1, np.arange(len(keys))
    for step in range(1, _HOT + 1):
        at = at[at + step < len(keys)]
        at = at[keys[at + step] - keys[at] <= np.minimum(reach, 0xFFFF - (keys[at] & 0xFFFF))]
        if not len(at):
            return
        yield at, at + step


def _lengths(keys: np.ndarray) -> np.ndarray:
    """For each row the length of its list."""
    length = np.diff(np.append(np.flatnonzero(np.diff(keys >> 16, prepend=(keys[:1] >> 16) - 1)), len(keys)))
    return np.repeat(length, length)


def _may_meet(lists: dict[str, np.ndarray], least: float) -> pa.RecordBatch:
    """Of whole lists, the sets that have one in their list that may be alike by 128 bits; all of a list longer than _HOT."""
    keys, prints = lists["key"], np.stack([lists["print_a"], lists["print_b"]], axis=1).view(np.uint64)
    marked = _lengths(keys) > _HOT
    for x, y in _pairs_at(keys, least):
        good = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int64) <= _FAR_SHORT
        marked[x[good]] = marked[y[good]] = True
    return pa.RecordBatch.from_arrays([pa.array(lists[c][marked]) for c in ("key", "node")], names=["key", "node"])


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first table in which two sets (rows of cells) are listed together: only there are they compared."""
    return (a == b).argmax(axis=1)


def nearest(before: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """Places of rows that have one before them that may be alike, each with its nearest one."""
    some = np.flatnonzero(bits < _BITS)
    return list(zip(before[some].tolist(), some.tolist(), strict=True))


def _meet(lists: dict[str, np.ndarray], least: float) -> pa.RecordBatch:
    """Of whole lists, the sets that have one that may be alike by all bits and whose first list with it is this one: the list's
    number of such sets, the place among them, the nearest before. Of a longer list than _HOT all sets come."""
    keys, node, n = lists["key"], lists["node"], lists["n"]
    sketch, cells = (np.frombuffer(b"".join(lists[c]), t).reshape(len(keys), -1) for c, t in (("sketch", np.uint64), ("cells", np.uint32)))
    length = _lengths(keys)
    marked, before, bits = length > _HOT, np.zeros(len(keys), np.int64), np.full(len(keys), _BITS, np.int64)
    for x, y in _pairs_at(keys, least):
        differ = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
        good = differ <= far(np.minimum(n[x], n[y]))
        x, y, differ = x[good], y[good], differ[good]
        good = first_shared(cells[x], cells[y]) == lists["place"][x]
        x, y, differ = x[good], y[good], differ[good]
        marked[x] = marked[y] = True
        nearer = differ < bits[y]
        before[y[nearer]], bits[y[nearer]] = x[nearer], differ[nearer]
    near, told = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
    for x, y in nearest(before, bits):
        near[y], told[y] = node[x], bits[y]
    kept = np.cumsum(marked) - marked
    start = np.flatnonzero(np.diff(keys >> 16, prepend=(keys[:1] >> 16) - 1))
    each = np.repeat(start, length[start])
    size = np.append(kept, marked.sum())[each + length] - kept[each]
    columns = {"key": keys >> 16, "place": lists["place"], "node": node, "size": size, "rank": kept - kept[each], "near": near, "bits": told}
    return pa.RecordBatch.from_arrays([pa.array(c[marked]) for c in columns.values()], names=list(columns))


def _by_list(compare: Callable[[dict[str, np.ndarray], float], pa.RecordBatch], least: float):
    """compare() over whole lists from batches in the order of key, of which a list may span several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def compared() -> pa.RecordBatch:
            return compare({c: np.concatenate([x[c] for x in held]) for c in held[0]}, least)

        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            own = now["key"] >> 16
            if not len(own):
                continue
            cut = int(np.searchsorted(own, own[-1]))  # the last list may go on
            if held and (cut or held[-1]["key"][-1] >> 16 != own[-1]):
                held.append({c: x[:cut] for c, x in now.items()})
                yield compared()
                held, now = [], {c: x[cut:] for c, x in now.items()}
            held.append(now)
        if held:
            yield compared()

    return run


def _sets(column: pa.Array, words: int) -> list[np.ndarray]:
    raw, offsets = utf8(column)
    h, at = shingle_sets(raw, offsets, words)
    return np.split(h, at[1:-1])


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _alike(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                keep = [_similar(x, y, least) for x, y in zip(_sets(part.column("text_a"), words), _sets(part.column("text_b"), words), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def _across(group: pd.DataFrame, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of sets of different roots that may be alike, by their sizes and fingerprints, and have this list first."""
    sketch, cells = (np.frombuffer(b"".join(group[c]), t).reshape(len(group), -1) for c, t in (("sketch", np.uint64), ("cells", np.uint32)))
    n, root, place = group["n"].to_numpy(np.int64), group["root"].to_numpy(np.int64), group["place"].iloc[0]
    for a in range(0, len(group), 64):
        rows = slice(a, a + 64)
        may = (root[rows, None] != root) & (np.minimum(n[rows, None], n) >= least * np.maximum(n[rows, None], n))
        may &= np.arange(a, a + len(may))[:, None] < np.arange(len(group))
        x, y = np.nonzero(may)
        x += a
        good = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64) <= far(np.minimum(n[x], n[y]))
        x, y = x[good], y[good]
        good = first_shared(cells[x], cells[y]) == place
        yield x[good], y[good]


def _apart(least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        marked = np.zeros(len(group), bool)
        for x, y in _across(group, least):
            marked[x] = marked[y] = True
        return group.loc[marked]

    return run


def _last_links(words: int, least: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        node, above = group["node"].tolist(), {r: r for r in group["root"].tolist()}
        root, texts, sets, found = group["root"].tolist(), group["text"].tolist(), {}, []

        def find(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = _sets(pa.array([texts[i]], pa.string()), words)[0]
            return sets[i]

        for x, y in _across(group, least):
            for i, j in zip(x.tolist(), y.tolist(), strict=True):
                a, b = find(root[i]), find(root[j])
                if a != b and _similar(of(i), of(j), least):
                    above[max(a, b)] = min(a, b)
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype="int64")

    return run


def _tasks(df: DataFrame, each: int = 4) -> int:
    """Comparing takes longer than a list's few bytes tell, so the number of tasks is stated: `each` for a shuffle partition."""
    return each * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def last_links(shared: DataFrame, each: DataFrame, rooted: DataFrame, texts: DataFrame, words: int, least: float, tasks: int = 4, block: int = 512) -> DataFrame:
    """Links (a, b) of the lists (shared_lists()) whose sets have more than one root in rooted (node,
    root; others are their own): not all of them, but enough to connect all that a list's links connect. texts: row_id, text.

    A list is compared in pairs of blocks of `block` sets. A pair of blocks first tells which sets have one of another root
    that may be alike; only their texts are read, and compared until their roots are one.
    """
    long = shared.select("key", "place", "node", "size", "rank").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = long.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    blocks, own = F.expr(f"(size - 1) div {block}"), F.expr(f"rank div {block}")
    dealt = long.join(apart, "key", "left_semi").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int"))))
    dealt = dealt.filter((F.col("own") != F.col("other")) | (F.col("size") <= block)).join(each.select("node", "n", "sketch", "cells"), "node")
    dealt = dealt.select("key", F.least("own", "other").cast("long").alias("x"), F.greatest("own", "other").cast("long").alias("y"), "place", "node", "n", "root", "sketch", "cells")
    by, schema = ["key", "x", "y"], "key long, x long, y long, place long, node long, n long, root long, sketch binary, cells binary"
    marked = table(dealt.repartition(_tasks(shared, tasks), *by).groupBy(*by).applyInPandas(_apart(least), schema), "near-apart")
    read = marked.join(texts.select(F.col("row_id").alias("node"), "text"), "node")
    return read.repartition(_tasks(shared, tasks), *by).groupBy(*by).applyInPandas(_last_links(words, least), "a long, b long")


def shared_lists(each: DataFrame, least: float) -> DataFrame:
    """Of each list the sets that may be like another one in it and meet it in no earlier table: key, place (the table), node, size
    (how many they are), rank (among them), near (the nearest before it, -1 if there is none) and bits (by how many they differ).
    each: node, n, keys, print_a, print_b, sketch, cells.

    Sets of a longer list than _HOT all come, each compared with the next ones by size; last_links() has what this leaves.
    """
    listed = each.select("node", "print_a", "print_b", F.explode("keys").alias("key"))
    dealt = listed.repartition(_tasks(each), F.shiftright("key", 16)).sortWithinPartitions("key", "node")
    some = table(dealt.mapInArrow(_by_list(_may_meet, least), "key long, node long"), "near-meet")
    place = F.expr("array_position(keys, key) - 1").cast("long").alias("place")
    told = some.join(each.select("node", "n", "keys", "sketch", "cells"), "node").select("key", place, "node", "n", "sketch", "cells")
    dealt = told.repartition(_tasks(each), F.shiftright("key", 16)).sortWithinPartitions("key", "node")
    return table(dealt.mapInArrow(_by_list(_meet, least), "key long, place long, node long, size long, rank long, near long, bits long"), "near-lists")


def candidates(shared: DataFrame, most: int = 2) -> DataFrame:
    """Distinct pairs (a, b) of nodes that may be alike: each set with the `most` nearest that its lists tell of."""
    best = F.slice(F.sort_array(F.collect_set(F.struct("bits", "near"))), 1, most)
    told = shared.filter("near >= 0").groupBy("node").agg(best.alias("best")).select("node", F.explode("best.near").alias("near"))
    return told.select(F.least("node", "near").alias("a"), F.greatest("node", "near").alias("b")).distinct()


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """docs with all their columns, one row of each component of texts whose sets of `words`-word shingles have a Jaccard
    similarity of at least `least`: the one with the smallest id, null last.

    Words are runs of other than space and U+0009 to U+000D, A-Z lower-cased. Texts without words (null, empty) are alike; an
    empty table gives an empty result.
    """
    row = unused("row", docs)
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    with scratch(docs.sparkSession) as made:
        read = numbered.select(F.col(row).alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        tables, groups = shape(numbered.count())
        rows = table(read.mapInArrow(_signature_batches(words, tables, groups), "row_id long, doc_id long, one long, two long, n long, keys array<long>, print_a long, print_b long, sketch binary, cells binary"), "near-rows")
        named = table(rows.groupBy("one", "two").agg(F.min("row_id").alias("node")), "near-sets")
        each = rows.select(F.col("row_id").alias("node"), "n", "keys", "print_a", "print_b", "sketch", "cells").join(named.select("node"), "node", "left_semi").filter("n > 0")
        shared = shared_lists(each, least)
        pairs = table(candidates(shared), "near-pairs")
        wanted = sized(pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct(), "near-wanted")
        texts = table(read.join(wanted, "row_id", "left_semi").select("row_id", "text"), "near-texts")
        joined = pairs.join(texts.select(F.col("row_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("row_id").alias("a"), F.col("text").alias("text_a")), "a")
        links = table(joined.select("a", "b", "text_a", "text_b").mapInArrow(_alike(words, least), "a long, b long"), "near-links")
        rooted = components(links)
        more = table(last_links(shared, each, rooted, read, words, least), "near-last")
        if not more.isEmpty():
            rooted = components(links.unionByName(more))
        groups = rows.select("row_id", "doc_id", "one", "two").join(named, ["one", "two"]).join(rooted, "node", "left").select("row_id", "doc_id", F.coalesce("root", "node").alias("root"))
        groups = table(groups, "near-groups")
        first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first"))
        gone = groups.select(F.col("row_id").alias(row)).join(first.select(F.col("first.row_id").alias(row)), row, "left_anti")
        gone = sized(gone, "near-gone")
        made.pop()  # only the rows that go are read from here on
    return numbered.join(gone, row, "left_anti").select(*same_columns(docs))
