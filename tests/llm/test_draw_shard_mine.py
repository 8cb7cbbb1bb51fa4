import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import draws, hard_negatives, resample, sharding

# 11 importance resampling

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return words, words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]


def weighed(docs, target):
    """Every row's words, features, weight and score, one feature at a time."""
    def totals(texts):
        out = Counter()
        for t in texts:
            out.update(zlib.crc32(f) % 10000 for f in features(t)[1])
        return out

    s, t = totals(x for _, x in docs), totals(target)
    big_s, big_t = float(sum(s.values()) + 10000), float(sum(t.values()) + 10000)
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * big_s / ((s[b] + 1.0) * big_t))) for b in range(10000)}
    for d, x in docs:
        words, found = features(x)
        weight = sum(gain[zlib.crc32(f) % 10000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        yield d, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


TARGET = ["alpha of the tion", None, "", "漢字 Beta gamma the of the", "é é"]


def test_importance(spark, docs, none):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    want = list(weighed([(r["doc_id"], r["text"]) for r in docs.collect()], TARGET))
    rows = resample.importance(docs, target).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in rows) == Counter(want)
    order = sorted((-s, d is None, d or 0) for d, n, _, _, s in want if n >= 20)
    drawn = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in rows if r["rank"] is not None)
    assert [x[0] for x in drawn] == list(range(1, 25 * len(order) // 100 + 1)) and [x[1:] for x in drawn] == order[: len(drawn)]
    kept = resample.resampled(docs, target)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in rows if r["rank"] is not None)
    assert resample.importance(none, target).count() == 0
    again = resample.importance(docs, none.select("text"), share=100, least_words=0).collect()
    assert sorted(r["rank"] for r in again) == list(range(1, len(again) + 1))


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_trie_in_pieces_and_flushes(longest, monkeypatch):
    import pyarrow as pa

    texts = ["a b c d e f g h " * 40, None, "A a-b", "x" * 300, "one two three " * 7, "a"]
    monkeypatch.setattr(resample, "ROUND_BYTES", 16)
    trie = resample.WordTrie(longest, 97, most=3)
    words = np.zeros(len(texts), np.int64)
    for a, parts, starts in resample._texts(pa.array(texts), longest):
        trie.count(parts, starts)
        words[a : a + len(starts)] += starts
    trie.flush()
    want = Counter()
    for t in texts:
        ws = features(t)[0]
        want.update(zlib.crc32(b" ".join(ws[i : i + k])) % 97 for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    assert {i: n for i, n in enumerate(trie.totals.tolist()) if n} == dict(want) and words.tolist() == [len(features(t)[0]) for t in texts]


# Draws


@pytest.mark.parametrize(("good", "bad", "left"), [(60, 90, 70), (1000, 50, 400), (500, 800, 45), (5, 100, 50), (7, 0, 3)])
def test_large_draws_follow_the_law(good, bad, left):
    """The sampler for large populations, held against exact probabilities of small ones."""
    rng, n = np.random.default_rng(1), 20_000
    got = Counter(draws.hypergeometric(rng, good, bad, left) for _ in range(n))
    chi, free = 0.0, 0
    for x in range(left + 1):
        p = n * math.comb(good, x) * math.comb(bad, left - x) / math.comb(good + bad, left)
        assert p > 0 or not got[x]
        if p >= 5:
            chi, free = chi + (got[x] - p) ** 2 / p, free + 1
    assert chi < free + 5 * math.sqrt(2 * free) + 5


def test_log_ratio_of_large_populations():
    good, bad, left = 10**12, 3 * 10**12, 7 * 10**11
    mode = (left + 1) * (good + 1) // (good + bad + 2)
    for d in (1000, -700):
        low, high = sorted((mode, mode + d))
        steps = math.fsum(math.log1p(((good - y) * (left - y) - (y + 1) * (bad - left + y + 1)) / ((y + 1) * (bad - left + y + 1))) for y in range(low, high))
        assert abs(draws.log_ratio(good, bad, left, mode, mode + d) - math.copysign(1, d) * steps) < 1e-9


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=9), st.integers(0, 100), st.integers(0, 9))
def test_counts_add_up(counts, share, seed):
    counts = np.array(counts, np.int64)
    left = int(counts.sum()) * share // 100
    got = draws.draw_counts(counts, left, [seed])
    assert got.sum() == left and (got >= 0).all() and (got <= counts).all() and (got == draws.draw_counts(counts, left, [seed])).all()


# 12 sharding


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=9), st.integers(1, 5), st.integers(1, 4))
def test_matrix_has_exact_sums(counts, shards, cells):
    sizes = sharding.cell_sizes(sum(counts), shards, cells)
    assert sizes.sum() == sum(counts) and np.ptp(sizes.sum(axis=1)) <= 1 and np.ptp(sizes, axis=1).max() <= 1
    dealer = sharding.Dealer(np.array(counts), sizes.ravel(), 5)
    dealt = [dealer.cells(i) for i in range(len(counts))]
    assert [len(d) for d in dealt] == counts
    assert (np.bincount(np.concatenate(dealt).astype(int), minlength=sizes.size) == sizes.ravel()).all()


def test_rows_are_uniform_over_cells():
    """Each row of each partition reaches each cell equally often, over seeds."""
    counts, sizes = np.array([3, 5, 4]), np.array([4, 4, 4])
    seen = np.zeros((12, 3))
    for seed in range(3000):
        dealer = sharding.Dealer(counts, sizes, seed)
        seen[np.arange(12), np.concatenate([dealer.cells(i) for i in range(3)])] += 1
    assert abs(seen / 3000 - 1 / 3).max() < 0.05


def check_shards(rows, many, shards):
    by = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(shards)}
    assert len(rows) == many and all(v == list(range(many // shards + (k < many % shards))) for k, v in by.items())


@pytest.mark.parametrize(("shards", "cell_bytes"), [(1, 1 << 20), (3, 500), (70, 1 << 20)])
def test_shards(docs, none, shards, cell_bytes):
    out = sharding.shuffled(docs, shards, cell_bytes=cell_bytes)
    rows = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"]
    check_shards(rows, docs.count(), shards)
    assert Counter(tuple(r)[:-2] for r in rows) == Counter(tuple(r) for r in docs.collect())
    assert sharding.shuffled(none, shards).count() == 0


def test_shards_of_clashing_names_and_reruns(spark, tmp_path):
    df = spark.range(0, 900, 1, 5).select(F.col("id").alias("a.b"), F.lit("x").alias("__row"), F.lit(None).cast("string").alias("slot"), F.col("id").alias("doc`id"))
    one, two = (sorted(tuple(r) for r in sharding.shuffled(df, 7, cell_bytes=3000).collect()) for _ in range(2))
    assert one == two and sorted(r[0] for r in one) == list(range(900))
    order = [r[0] for r in sorted(one, key=lambda r: (r[-2], r[-1]))]
    assert abs(np.corrcoef(order, np.arange(900))[0, 1]) < 0.12
    sharding.write_shards(df, str(tmp_path / "out"), 7)
    read = spark.read.parquet(str(tmp_path / "out"))
    check_shards(read.collect(), 900, 7)


# 13 hard negatives


def plain_mining(rows, positives=5, negatives=3):
    """Every pair, in Python's integers."""
    good = [(i, d, lab, [math.floor(256 * x) for x in v]) for i, (d, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, d, lab, v in good:
        if d is None or d % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), e is None, e or 0, lab == other) for j, e, other, w in good if i != j]
        for p in sorted(x for x in scored if x[3])[:positives]:
            low = [n for n in sorted(x for x in scored if not x[3]) if 50 * -p[0] <= 100 * -n[0] <= 95 * -p[0]]
            for rank, n in enumerate(low[:negatives], 1):
                yield d, None if p[1] else p[2], rank, None if n[1] else n[2], -p[0], -n[0]


def mine(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row_id", F.lit("x")).withColumn("a.b", F.lit(1))
    return Counter(tuple(r) for r in hard_negatives.hard_negatives(df.repartition(3), **more).collect())


def vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width)) * np.linspace(2, 0.05, width)
    return [(int(i), [float(np.float32(x)) for x in centres[i % 4] + spread * rng.normal(size=width) * np.linspace(0.5, 0.1, width)], int(i % 3)) for i in range(n)]


@pytest.mark.parametrize(("width", "blocks"), [(12, 7), (1, 50), (3, 400)])
def test_mining(spark, width, blocks):
    rows = vectors(260, width, 3)
    assert mine(spark, rows, anchor_block=3, row_block=blocks) == Counter(plain_mining(rows))


def test_mining_odd_rows(spark):
    rows = vectors(60, 6, 4) + [(None, [0.5] * 6, 0), (None, [0.5] * 6, 1), (50, [0.5] * 6, 1), (50, [0.5] * 6, 1), (7, None, 1), (8, [0.1, None, 1.0, 1.0, 1.0, 1.0], 1), (9, [float("nan")] * 6, 1), (11, [float("-inf")] * 6, 1), (12, [1.0] * 6, None), (13, [], 0), (14, [0.25], 0), (100, [0.0] * 6, 2), (150, [0.5] * 6, 9)]
    rows += [(1000 + i, [0.375] * 6, i % 3) for i in range(40)]
    assert mine(spark, rows, row_block=20) == Counter(plain_mining(rows))
    assert not mine(spark, [])
    assert not mine(spark, [(1, [1.0], 2)])
    with pytest.raises(Exception, match="too large"):
        mine(spark, [(0, [1e30], 2)])


def test_bounds_discard_most_pairs_and_no_hit():
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(500, 32)) * np.linspace(300, 3, 32)).round().astype(np.int64)
    axes = np.linalg.eigh(rows.T @ rows / 500.0)[1][:, ::-1]
    pruner = hard_negatives.Pruner(axes, rows[:40], rows)
    scores = rows[:40] @ rows.T
    low = np.sort(scores, axis=1)[:, -5]
    i, j, got = pruner.survivors(slice(0, 500), low, np.full(40, 1 << 60), np.ones(scores.shape, bool))
    assert (scores[i, j] == got).all() and set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(scores >= low[:, None])), strict=True))
    assert pruner.seen[0] == 20_000 and pruner.seen[-2] < 2_000
