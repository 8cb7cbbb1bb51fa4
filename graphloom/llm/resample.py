"""Importance resampling towards a target: documents are weighed by how much commoner their features are in the target's texts.

1. Each task keeps a trie of the words of its texts: a path of one or two words is a feature, and its node holds the feature's
   count and the state of its CRC, from which a child's CRC goes on. A full trie gives its counts to the buckets and starts anew.
2. The buckets' totals of all tasks are summed; a bucket's gain is the logarithm of its share in the target over that in the corpus.
3. Each task walks its texts through a trie whose nodes have gains attached; a document's weight is the mean gain of its path's nodes.
4. Gumbel noise that depends on the id alone is added, and the highest scores are drawn: that is sampling without replacement by weight.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.ranges import placed

from .common import ROUND_BYTES, rounds, same_columns, sized, table, unused, utf8

BUCKETS = 10_000
#: A-Z become a-z; all ASCII but letters and digits separates words; other bytes belong to words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


class _Ids(dict):
    """Numbers words in the order in which they come."""

    def __init__(self):
        self.spelled: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        self.spelled.append(word)
        return found


class WordTrie:
    """Runs of up to `longest` words as paths of a trie; a node is a number, with its bucket, its CRC state and its count."""

    def __init__(self, longest: int = 2, buckets: int = BUCKETS, most: int = 1 << 18):
        self.longest, self.buckets, self.most = longest, buckets, most
        self.totals = np.zeros(buckets, np.int64)
        self._empty()

    def _empty(self) -> None:
        self.words = _Ids()
        self.children: dict[int, int] = {}
        self.crc: list[int] = []
        self.counts = np.zeros(1024, np.int64)

    def _child(self, code: int) -> int:
        """The node below a node (its number and one, shifted; 0 for the root) by a word's number."""
        node = self.children.get(code)
        if node is None:
            above, word = code >> 32, self.words.spelled[code & 0xFFFFFFFF]
            self.children[code] = node = len(self.crc)
            self.crc.append(zlib.crc32(b" " + word, self.crc[above - 1]) if above else zlib.crc32(word))
        return node

    def walk(self, texts: list[list[bytes]], starts: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each depth: the distinct nodes, and for each feature in order the position of its node among them and its text's number.
        Features start at the first `starts` words of a text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ids = np.fromiter((self.words[w] for t in texts for w in t), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(texts)), sizes)
        end = np.repeat(np.cumsum(sizes), sizes)
        at = np.flatnonzero(end - np.arange(len(ids)) > np.repeat(sizes - starts, sizes))
        codes = ids[at]
        for depth in range(1, self.longest + 1):
            found, where = np.unique(codes, return_inverse=True)
            nodes = np.fromiter(map(self._child, found.tolist()), np.int64, len(found))
            yield nodes, where, owner[at]
            goes_on = at + depth < end[at]
            above, at = nodes[where[goes_on]], at[goes_on]
            codes = ((above + 1) << 32) | ids[at + depth]

    def _bucket(self, nodes: np.ndarray | slice) -> np.ndarray:
        return np.array(self.crc[nodes] if isinstance(nodes, slice) else [self.crc[n] for n in nodes.tolist()], np.int64) % self.buckets

    def count(self, texts: list[list[bytes]], starts: list[int]) -> None:
        for nodes, where, _ in self.walk(texts, starts):
            if len(self.crc) > len(self.counts):
                self.counts = np.concatenate([self.counts, np.zeros(len(self.crc), np.int64)])
            self.counts[nodes] += np.bincount(where, minlength=len(nodes))
        if len(self.crc) > self.most:
            self.flush()

    def flush(self) -> None:
        """Gives the nodes' counts to their buckets and forgets the nodes: memory stays bounded and nothing is lost."""
        np.add.at(self.totals, self._bucket(slice(None)), self.counts[: len(self.crc)])
        self._empty()

    def score(self, texts: list[list[bytes]], starts: list[int], gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and the sum of their gains, for each text."""
        count, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for nodes, where, owner in self.walk(texts, starts):
            count += np.bincount(owner, minlength=len(texts))
            # Sums of gains stay far below 2**53, so they are exact as doubles.
            total += np.bincount(owner, gains[self._bucket(nodes)][where], len(texts)).astype(np.int64)
        if len(self.crc) > self.most:
            self._empty()
        return count, total


def _texts(column: pa.Array, longest: int) -> Iterator[tuple[int, list[list[bytes]], list[int]]]:
    """The first row of a round, the words of its whole texts, and how many of a text's words start features. A text longer than a
    round comes in pieces, each with the words after it that its last features need."""
    raw, offsets = utf8(column)
    for a, b in rounds(np.diff(offsets), ROUND_BYTES):
        data = raw[offsets[a] : offsets[b]].tobytes().translate(_WORDS)
        at = (offsets[a : b + 1] - offsets[a]).tolist()
        if len(data) <= ROUND_BYTES:
            texts = [data[x:y].split() for x, y in zip(at, at[1:], strict=False)]
            yield a, texts, [len(t) for t in texts]
            continue
        held: list[bytes] = []
        cut = 0
        while cut < len(data):
            end = data.find(b" ", cut + ROUND_BYTES)
            words, cut = data[cut : end if end >= 0 else len(data)].split(), end if end >= 0 else len(data)
            if held and len(words) >= longest:
                yield a, [held + words[: longest - 1]], [len(held)]
                held = []
            held += words
        yield a, [held], [len(held)]


def bucket_totals(docs: DataFrame, *, text_col: str = "text", longest: int = 2, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all of docs each bucket holds. What tasks send and the driver gets is bounded by the number of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(longest, buckets)
        for batch in batches:
            for _, texts, starts in _texts(batch.column("text"), longest):
                trie.count(texts, starts)
        trie.flush()
        some = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(trie.totals[some])], names=["bucket", "n"])

    read = docs.select(F.col(text_col).cast("string").alias("text"))
    out = np.zeros(buckets, np.int64)
    for r in read.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: floor(1000 ln of the ratio of its smoothed shares), in doubles."""
    all_corpus, all_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _scorer(gains: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(longest, len(gains))
        for batch in batches:
            words, features, gained = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, texts, starts in _texts(batch.column("text"), longest):
                count, total = trie.score(texts, starts, gains)
                for held, more in ((words, starts), (features, count), (gained, total)):
                    held[a : a + len(texts)] += more
            weight = gained // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(weight)], names=["row_id", "doc_id", "n_words", "n_features", "weight"])

    return run


def importance(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", row_col: str | None = None, share: int = 25, least_words: int = 20, longest: int = 2, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """One row for each row of docs: row_id, doc_id, n_words, n_features, weight, score and rank (from 1; null if it isn't drawn).

    A-Z are lower-cased, words are runs of letters and digits of ASCII and of all other characters; features are all runs of 1 to
    `longest` words, repeats counted. Null, empty and wordless texts have no features and weight 0. Of the N rows of at least
    least_words words, floor(share * N / 100) are drawn, the highest scores first, ties by the smaller id, null last; rows that agree
    in id and score are ranked in any order. A null id counts as an empty one in the noise. Repeated rows are rows of their own. An
    empty table gives an empty result, an empty target has equal shares in all buckets. Other columns are not read.
    """
    gains = gains_of(bucket_totals(docs, text_col=text_col, longest=longest, buckets=buckets), bucket_totals(target, text_col=target_col, longest=longest, buckets=buckets))
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    read = docs.select(number.alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weighed = read.mapInArrow(_scorer(gains, longest), "row_id long, doc_id long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = table(weighed.withColumn("score", (F.col("weight") + noise).cast("long")), "op11-scores")
    draws = share * scored.filter(F.col("n_words") >= least_words).count() // 100
    order = [F.col("n_words") < least_words, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_id")]
    place = F.col("place")
    return placed(scored, order).select("row_id", "doc_id", "n_words", "n_features", "weight", "score", F.when(place <= draws, place).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, *, share: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """The rows of docs that are drawn, with all their columns."""
    row = unused("row", docs)
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    drawn = importance(numbered, target, row_col=row, share=share, least_words=least_words, seed=seed).filter("rank IS NOT NULL")
    return numbered.join(sized(drawn.select(F.col("row_id").alias(row)), "op11-drawn"), row, "left_semi").select(*same_columns(docs))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    found = importance(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS MATERIALIZED (
  SELECT kind, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS MATERIALIZED (
  SELECT kind, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS MATERIALIZED (SELECT kind, r, f, count(*) AS n FROM features GROUP BY ALL),
named AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(f), (2 * i + 1)::BIGINT, 2))::BIGINT),
                            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), steps),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM counted JOIN named USING (f) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM buckets),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM buckets, totals),
summed AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM counted JOIN named USING (f) JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY r),
weighed AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(floor(total / n), 0)::BIGINT AS weight,
         ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM words LEFT JOIN summed USING (r) WHERE kind = 'd'),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id, r) AS place, count(*) FILTER (n_words >= 20) OVER () AS many FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 25 * many // 100 THEN place END AS rank FROM placed
"""
