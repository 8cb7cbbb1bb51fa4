import contextlib
import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import bpe, common, exact_dedup, language_id, license_scan, lm_score, mixing, near_copies, quality, simhash, suffix_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# Shared parts


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**60 - 1)))
def test_rice(values):
    values = np.array(sorted(set(values)), np.uint64)
    assert (common.rice_decode(common.rice_encode(values)) == values).all()


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("ab \n\té漢", max_size=9), max_size=6))
def test_word_bounds(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
    starts, ends, at = common.word_bounds(raw, offsets)
    found = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert [found[a:b] for a, b in zip(at, at[1:], strict=False)] == [WORD.findall(t) for t in texts]


def test_rounds_keep_long_rows_whole():
    assert list(common.rounds(np.array([5, 1, 99, 1, 1]), 6)) == [(0, 2), (2, 3), (3, 5)] and list(common.rounds(np.array([], int))) == []


# 1 mixing


def hand_targets(sizes):
    """Weights 5, 2, 1 in turn: a source is full if even with all below it full its share is more than 3 times its size."""
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    order = sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: sizes[i] / weights[i])
    out, left, total = [0.0] * len(sizes), sum(sizes), sum(weights[i] for i in order)
    for i in order:
        out[i] = min(left * weights[i] / total, 3 * sizes[i])
        left, total = left - out[i], total - weights[i]
    return out


def check_mix(rows):
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    goal = hand_targets([sum(r["size"] for r in by[s]) for s in names])
    for s, g in zip(names, goal, strict=True):
        assert all(r["source_size"] == sum(x["size"] for x in by[s]) and abs(r["target"] - g) < 1e-6 and r["taken"] <= 3 * r["size"] for r in by[s])
        assert abs(sum(r["taken"] for r in by[s]) - g) <= max(1, g / 10)
    assert abs(sum(goal) - total) < 1e-6


def test_mixing(docs, none):
    rows = mixing.mix(docs).rows.collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((d, len(WORD.findall(t or ""))) for d, t in pairs(docs))
    check_mix(rows)
    again = mixing.mix(docs.repartition(5)).rows.collect()
    key = lambda rs: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rs)
    assert key(rows) == key(again)
    assert mixing.mix(none).rows.count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and mixing.mixed(none).count() == 0
    taken = defaultdict(int)
    for r in out.collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    want = defaultdict(int)
    for r in rows:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in want.items() if v} == dict(taken)


def test_targets_reshare():
    assert mixing.targets([10, 1000, 1000], [5, 2, 1]) == [30.0, 1980 * 2 / 3, 660.0]
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0] and mixing.targets([], []) == []
    assert mixing.targets([7], [5]) == [7.0]


@settings(deadline=None, max_examples=40)
@given(st.integers(1, 700), st.integers(0, 99))
def test_permutation(n, seed):
    assert sorted(mixing.permuted(np.arange(n), n, seed).tolist()) == list(range(n))


@pytest.mark.parametrize(("sources", "words"), [(60, 50), (9, 90), (3, 5000)])
def test_small_sources_reach_their_targets(spark, sources, words):
    rows = [(i, " ".join(["w"] * words), f"s{i:02}") for i in range(sources)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_slots=64).rows.collect()
    check_mix(got)
    if sources == 60:  # by hand: 3,000 words by weight are 93.75, 37.5 and 18.75 for the sources of each weight
        assert {round(r["target"], 6) for r in got} == {93.75, 37.5, 18.75} and abs(sum(r["taken"] for r in got) - 3000) <= 60


def test_equal_rows_without_id(spark):
    rows = [(None, "a b c", "s")] * 500 + [(None, "d e", "t"), (7, "x " * 900, "t")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table.repartition(4), bucket_rows=10).rows.collect()
    check_mix(got)
    again = mixing.mix(table.repartition(2), bucket_rows=10).rows.collect()
    assert Counter((r["size"], r["taken"]) for r in got) == Counter((r["size"], r["taken"]) for r in again)


def test_shard_draws_are_multinomial_given_totals():
    slots = np.array([400, 100, 30, 0])

    def draw(k, seed=11, seen=None):
        out = np.zeros((2, 4), np.int64)
        some, *rest = mixing.shard_draw(k, 9, 60, slots, seed, seen)
        out[:, some] = rest
        return out

    parts = [draw(k) for k in range(9)]
    assert sum(n for _, n in parts).tolist() == slots.tolist() and [int(n.sum()) for _, n in parts] == [60] * 8 + [50]
    for k in range(1, 9):  # a source that a shard hasn't is not in its row
        assert all(parts[k][0][s] == sum(p[1][s] for p in parts[:k]) for s in range(4) if parts[k][1][s])
    seen = {}
    assert all((draw(k, seen=seen) == parts[k]).all() for k in (0, 5, 8, 0))
    first = np.array([draw(0, seed)[1] for seed in range(400)])
    assert abs(first.mean(axis=0) - slots * 60 / 530).max() < 1 and first[:, 0].std() > 2


def test_draws_at_any_size():
    """A mix of 10**13 slots is drawn like one of a few: counts scatter as the law says, at each level."""
    slots, shards, each = np.array([6 * 10**12, 4 * 10**12 - 7, 7]), 1 << 20, -(-(10**13) // (1 << 20))
    z = []
    for seed in range(60):
        some, before, here = mixing.shard_draw(5, shards, each, slots, seed)
        assert here.sum() == each and (before + here <= slots[some]).all()
        z.append((dict(zip(some.tolist(), here.tolist(), strict=True))[0] - 0.6 * each) / (each * 0.24) ** 0.5)
    assert abs(np.mean(z)) < 0.5 and 0.7 < np.std(z) < 1.4


def test_many_sources():
    """Targets of very many sources, and a shard's draw that costs as much as the shard has."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 10**6, 20_000).tolist()
    began = time.perf_counter()
    got = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert np.allclose(got, hand_targets(sizes)) and time.perf_counter() - began < 2


def test_taken_texts():
    assert mixing.taken_texts("a  b\tc d", [(0, 2, 2), (2, 4, 1)]) == ["a  b\tc d", "a  b"]
    assert mixing.taken_texts("a b c d", [(0, 1, 1), (3, 4, 1)]) == ["a d"]


# 2 exact dedup


@pytest.mark.parametrize("small", [False, True])
def test_exact(docs, none, small):
    sizes = {"chunk_bytes": 3000, "owner_rows": 3, "spare_bits": 0, "broadcast_rows": 0} if small else {}  # few bits: chance collisions must be cleared
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs, **sizes).collect())
    groups = defaultdict(list)
    for d, t in pairs(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((d, t))
    want = Counter()
    for norm, rows in groups.items():
        rows.sort(key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for i, (d, _) in enumerate(rows):
            want[d, rows[0][0], len(rows), i == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert got == want
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups) and exact_dedup.keep_first(none).count() == 0


def test_exact_moves_no_text_but_suspects(spark, monkeypatch):
    """All texts stay in their chunks, whatever the number of suspects; only those that a bitmap marks come out."""
    made, out = [], []
    monkeypatch.setattr(exact_dedup, "chunked", lambda *a, f=exact_dedup.chunked, **k: made.append(f(*a, **k)) or made[-1])
    monkeypatch.setattr(exact_dedup, "_suspects", lambda bits, f=exact_dedup._suspects: out.append(f(bits)) or out[-1])
    rows = [(i, f"text {i % 900}") for i in range(1000)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), broadcast_rows=0)
    assert Counter(r["group_size"] for r in got.collect()) == {1: 800, 2: 200}
    plan = made[0].groupBy("chunk").agg(F.first("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and len(out) == 1


# 3 quality rules


def plain_quality(t):
    t = t or ""
    words = WORD.findall(t)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n, chars, symbols, twice = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
    base = n < 50 or 100 * len(covered) > 50 * n
    upper, letters = sum(c.isupper() for c in t), sum(c.isalpha() for c in t)
    bad = 10 * symbols > n or 5 * t.count("!") > n or 2 * upper > letters or 10 * twice > 3 * len(lines) or 2 * chars < 5 * n or chars > 12 * n
    bad = bad or 10 * len(re.findall("[0-9]", t)) > 3 * chars or 10 * len(re.findall("https?://", t)) > n or 20 * sum(len(w) >= 60 for w in words) > n or 10 * len(re.findall(r"\.\.\.\n", t)) > 3 * len(lines)
    return n, chars, symbols, twice, len(covered), base, not base and not bad


def test_quality(spark, docs, none):
    extra = spark.createDataFrame([(200, "a b c " * 30), (201, "A B! " * 60), (202, "same line here\n" * 40), (203, "x y\n\n \nx y\n z"), (204, "# " * 70), (205, "12 ab 345 " * 30), (206, "see http://x.y and " * 20), (207, ("word and " * 9 + "z" * 70 + " ") * 6), (208, "some line that goes on and...\n" + "and another that ends there\n" * 1 + "\n".join(f"more of it {i} again..." for i in range(20)))], "doc_id long, text string")
    more = docs.select("doc_id", "text").unionByName(extra)
    got = Counter((r["doc_id"], *list(r)[1:]) for r in quality.judged(more).collect())
    assert got == Counter((d, *plain_quality(t)) for d, t in pairs(more))
    assert quality.judged(none).count() == 0 and quality.judged(docs.withColumn("n_words", F.lit("x"))).count() == docs.count()
    assert sorted(quality.order_of(more.select("doc_id", "text"), quality.RULES)) == sorted(quality.RULES)
    assert quality.judged(docs, rules={}).filter("kept = base_failed").count() == 0


def test_order_of_rules_is_conditional():
    """b rejects most for its cost; then c, whose rows b leaves, comes before a, most of whose rows b has taken."""
    rejected, cost = {0b000: 50, 0b011: 40, 0b010: 10, 0b001: 2, 0b100: 8}, {"a": 1.0, "b": 1.0, "c": 1.0}
    assert quality.best_order(list("abc"), rejected, cost) == ["b", "c", "a"]
    assert quality.best_order(list("abc"), rejected, cost | {"b": 100.0}) == ["a", "c", "b"]
    assert quality.best_order(list("abc"), {0: 5}, cost | {"c": 0.5}) == ["c", "a", "b"]
    assert quality.expected_cost(list("bca"), list("abc"), rejected, cost) == 110 + 60 + 52


def test_measured_rules(spark):
    """A rule that costs much and one that costs little are told apart, and every sampled row is counted."""
    texts = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(400)) + ("!" * 90 if i % 4 == 0 else "")) for i in range(200)], "doc_id long, text string")
    rules = {"dear": lambda: F.regexp_count("text", F.lit(r"\p{L}+\p{N}+\p{L}+\p{N}+q")) > 0, "cheap": lambda: F.col("n_words") > 10**6, "marks": quality.RULES["exclamations"]}
    rejected, cost = quality.measured(texts, rules)
    assert sum(rejected.values()) == 200 and {bits: n for bits, n in rejected.items() if bits} == {0b100: 50}
    assert cost["dear"] > cost["cheap"] and quality.best_order(list(rules), rejected, cost)[0] == "marks"


# 4 WARC


def test_warc(spark, tmp_path):
    long = "<p>é</p>" * 40
    rows = [(3, "http://a", long), (1, "http://b\r\nX: y", long), (2, None, long), (5, "u", "short"), (4, "u", "short"), (6, "u", None), (None, "u", long), (7, "u", "z" * 3_000_000), (3, "http://a", long), (8, "u", "end\r\n\r\nWARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write(pages, f"file://{tmp_path}/w", file_bytes=2000)
    got = warc.read(index, range_bytes=1500, gap=10).collect()
    want = Counter()
    for i, (p, _, h) in enumerate(rows):
        data = (h or "").encode()
        again = h == long and i != 1
        want[p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)
    some = warc.read(index.filter("page_id IN (5, 7)")).collect()
    assert {r["page_id"] for r in some} == {5, 7}
    empty = spark.createDataFrame([], pages.schema)
    assert warc.read(warc.write(empty)).count() == 0


# 5 license scans


def plain_aligned(template, text):
    """The same alignment by recursion, the longest increasing run by trying all predecessors (ties: smallest values, from the end)."""
    a, b, c, d = 0, len(template), 0, len(text)
    out = []
    while a < b and c < d and template[a] == text[c]:
        out.append((a, c))
        a, c = a + 1, c + 1
    while a < b and c < d and template[b - 1] == text[d - 1]:
        b, d = b - 1, d - 1
        out.append((b, d))
    one = [(i, j) for j in range(c, d) for i in range(a, b) if template[i] == text[j] and template[a:b].count(text[j]) == 1 and text[c:d].count(text[j]) == 1]
    length = []
    for i, p in enumerate(one):
        length.append(1 + max((length[k] for k in range(i) if one[k][0] < p[0]), default=0))
    kept, most, before = [], max(length, default=0), len(one)
    while most:
        before = min((i for i in range(before) if length[i] == most and (not kept or one[i][0] < kept[0][0])), key=lambda i: one[i][0])
        kept.insert(0, one[before])
        most -= 1
    if kept:
        edges = [(a - 1, c - 1), *kept, (b, d)]
        for (i, j), (k, m) in zip(edges, edges[1:], strict=False):
            out += [(i + 1 + x, j + 1 + y) for x, y in plain_aligned(template[i + 1 : k], text[j + 1 : m])]
        out += kept
    return sorted(out)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from("abcdef"), max_size=8), st.lists(st.sampled_from("abcdefg"), max_size=12))
def test_alignment(template, text):
    got = license_scan.aligned(template, text)
    assert all(template[i] == text[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))
    assert got == plain_aligned(template, text)


NOISE = " ".join(f"w{i}" for i in range(200))
#: Notices and near misses, labelled by hand.
LABELLED = [
    ("Released under the MIT License.", ["MIT"]),
    ("released  UNDER\nthe mit license! " * 3, ["MIT"]),
    ("Released under the MIT Licence", ["MIT"]),
    ("It is made available under the terms of the MIT License, as is.", ["MIT"]),
    ("SPDX-License-Identifier: MIT", ["MIT"]),
    ("a driving license issued at MIT", []),
    ("license the under released mit", []),
    ("The MIT campus is under the old bridge. License plates are made there.", []),
    ("Released under the BSD License.", ["BSD"]),
    ("Released under the 3-Clause BSD License", ["BSD-3-Clause"]),
    ("under the BSD 2-Clause License", ["BSD-2-Clause"]),
    ("released under the old license of 1990", []),
    ("Released under the Apache License 2.0", ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 1.1.", ["Apache-1.1"]),
    ("Licensed under the Apache License, Version 3.0.", []),
    ("SPDX-License-Identifier: Apache-2.0", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("GNU General Public License, version 2", []),
    ("This work is licensed under the GNU General Public License, version 2", ["GPL-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 2.1.", ["LGPL-2.1"]),
    ("This work is licensed under the GNU Affero General Public License, version 3.", ["AGPL-3.0"]),
    ("This work is licensed under the GNU Free Documentation License, version 3.", []),
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("Licensed under CC BY-ND 4.0.", ["CC-BY-ND-4.0"]),
    ("Licensed under CC BY-NC-SA 4.0.", ["CC-BY-NC-SA-4.0"]),
    ("Licensed under CC BY-NC 3.0.", []),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("This work is licensed under a Creative Commons Zero License.", []),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["MPL-2.0"]),
    ("Released under the MIT License. Parts are licensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
    (f"Released under the MIT License. {NOISE} Licensed under CC BY 4.0. {NOISE} under the MIT License", ["CC-BY-4.0", "MIT"]),
    (f"Released under {NOISE} the MIT {NOISE} License", []),
    ("", []),
    (None, []),
]


def found_in(scanner, text):
    return sorted(m.license for m in scanner.scan(text))


@pytest.fixture(scope="module")
def scanner():
    return license_scan.Scanner(license_scan.TEMPLATES, 0.8)


@pytest.mark.parametrize(("text", "licenses"), LABELLED)
def test_labelled_notices(scanner, text, licenses):
    assert found_in(scanner, text) == licenses
    if text:
        assert found_in(scanner, f"{NOISE} {text} {NOISE}") == licenses


def bare(notice):
    return notice.replace("[", "").replace("]", "")


def between(template, extra):
    """A template's words with more words before some of them, but none within a phrase."""
    inside = {i for a, b in template.must for i in range(a + 1, b)}
    return " ".join(f"{'' if i in inside else extra(i)} {w}" for i, w in enumerate(template.words))


def test_whole_license_texts(scanner):
    """Each full text is its own license and no other, also with a word altered, cut into numbered lines, or far into a book."""
    rng = np.random.default_rng(6)
    for name, texts in license_scan.TEXTS.items():
        for t in texts:
            assert found_in(scanner, bare(t)) == [name]
            assert [(m.coverage, m.first) for m in scanner.scan(f"{NOISE} {bare(t)}")] == [(1.0, 200)]
            known = license_scan.Template.of(name, t)
            assert found_in(scanner, between(known, lambda i: f"{i}" if i % 8 == 0 else "")) == [name]
            free = [i for i in range(len(known.words)) if not any(a <= i < b for a, b in known.must)]
            some = set(rng.choice(free, max(1, len(known.words) // 8), replace=False).tolist())
            altered = " ".join("zq" if i in some else w for i, w in enumerate(known.words))
            stray = " ".join(known.words[i] for i in sorted(some))
            assert name in found_in(scanner, f"{stray} {NOISE} {altered} {NOISE} {stray}")


def test_a_notice_over_much_text():
    """What lies between the words of a long notice costs, but there is no window that ends it."""
    ws = bare(license_scan.TEXTS["MIT"][0]).split()
    wide = between(license_scan.Template.of("MIT", license_scan.TEXTS["MIT"][0]), lambda i: f"x{i} | y{i} z")  # four times as long
    far = " ".join(ws[:40]) + f" {NOISE} " + " ".join(ws[40:])  # a page in the middle costs 25 words
    scanner = license_scan.Scanner({"MIT": license_scan.TEXTS["MIT"][0]}, 0.8)
    assert found_in(scanner, wide) == ["MIT"] and found_in(scanner, far) == ["MIT"]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.sampled_from("abcdefxyz"), max_size=60))
def test_matches_hold_what_they_say(text):
    scanner = license_scan.Scanner({"t": "a [b c] d e", "u": "f a b a [c] b d"}, 0.6)
    for m in scanner.scan(" ".join(text)):
        t = next(t for t in scanner.templates if t.license == m.license)
        inside = text[m.first : m.last + 1]
        phrase = [t.words[i] for i in range(*t.must[0])]
        assert any(inside[i : i + len(phrase)] == phrase for i in range(len(inside)))
        assert m.matched >= 0.6 * len(t.words) and m.last - m.first + 1 >= m.matched and len(inside) - m.matched <= 8 * len(t.words)


def test_licenses(spark, docs, none):
    rows = [(i, t) for i, (t, _) in enumerate(LABELLED)]
    got = {r["doc_id"]: sorted(m["license"] for m in r["matches"]) for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(LABELLED)}
    assert license_scan.licenses(none).count() == 0 and license_scan.licenses(docs.withColumn("matches", F.lit(1))).count() == docs.count()


def test_one_license_for_each_notice(spark, scanner):
    """Each line of the documents that names a license gives that one and no other."""
    rows = pairs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    known = {"MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0", "General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0", "Creative Commons Attribution 4.0": "CC-BY-4.0"}
    seen = 0
    for _, t in rows:
        want = sorted(name for line, name in known.items() if line in (t or ""))
        assert found_in(scanner, t) == want
        seen += len(want)
    assert seen > 30


# 6 byte-level BPE


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.ranks_file()), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.load_ranks(bpe.ranks_file()), bpe.class_table(), 500)


@settings(deadline=None, max_examples=300)
@given(texts=st.lists(st.text(st.sampled_from("ab'srtemdvl 'D\n\t\r.!19é٣漢 \x1c\0😀"), max_size=30) | st.text(max_size=20), max_size=5))
def test_bpe(texts, coder, reference):
    ids = [coder.ids_of(n) for n in coder.encode(texts)]
    assert ids == [reference.encode_ordinary(t) for t in texts]
    for t, i in zip(texts, ids, strict=True):
        assert coder.decode(i) == t.encode()
        at = coder.offsets(i).tolist()
        assert [coder.decode(i[k : k + 1]) for k in range(len(i))] == [t.encode()[a:b] for a, b in zip(at, [*at[1:], len(t.encode())], strict=False)]


def test_bpe_all_characters(coder, reference):
    texts = ["a" + c * 2 + "1" + c + " " + c for c in map(chr, range(0x3200)) if not 0xD800 <= ord(c) < 0xE000] + ["x" * 4000, "ab" * 3000, " " * 999, "''''s"]
    assert [coder.ids_of(n) for n in coder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_scan_by_steps():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        kinds = rng.integers(0, 8, n).astype(np.uint8)
        state, want = bpe.FRESH, []
        for k in kinds.tolist():
            want.append(state)
            state = bpe._next_state(state, k)
        assert bpe.scan(kinds).tolist() == want


def test_bpe_tables(docs, none, reference):
    rows = bpe.digests(docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in rows) == Counter((d, len(reference.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in pairs(docs))
    assert Counter(r["ids_sha256"] for r in rows) == Counter(hashlib.sha256(" ".join(map(str, reference.encode_ordinary(t or ""))).encode()).hexdigest() for _, t in pairs(docs))
    encoded = bpe.encode(docs, columns=("doc_id", "text"))
    back = bpe.decode(encoded, columns=("text",)).collect()
    assert all(r["data"] == (r["text"] or "").encode() for r in back) and bpe.digests(none).count() == 0 and bpe.encode(none).count() == 0


# 7 suffix-array dedup


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(text):
    text = [*text, 0]
    assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def plain_cut(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", mark)]
        out.append((tuple(spans), bytes(x for x, y in zip(b, mark, strict=True) if not y)))
    return out


@pytest.mark.parametrize("options", [{}, {"hot": 0}, {"length": 40, "spread": 20, "part_rows": 5, "hot": 1}, {"length": 30, "spread": 8, "hot": 2, "owner_rows": 10, "chunk_bytes": 500}, {"chunk_bytes": 1}])
def test_cut_repeats(docs, options):
    texts = [(t or "").encode() for _, t in pairs(docs)]
    want = Counter((b, *x) for b, x in zip(texts, plain_cut(texts, options.get("length", 200)), strict=True))
    rows = suffix_dedup.cut_repeats(docs, **options).collect()
    assert sorted(map(repr, (r["n_bytes"] for r in rows))) == sorted(map(repr, map(len, texts)))
    got = Counter((len_, spans, kept) for len_, spans, kept in ((r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in rows))
    assert got == Counter((len(b), s, k) for (b, s, k), n in want.items() for _ in range(n))


def test_cut_one_passage_in_many_contexts(spark, monkeypatch):
    """A passage that 300 texts share, each with other text around it, so that keys have up to 300 contexts: split twice."""
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(f"{x:x}" for x in rng.integers(0, 1 << 30, n))
    passage, edge = text(60), text(3)
    rows = [(i, f"{text(30)} {edge if i % 3 else ''} {passage}{'x' * (i % 5)}{text(30)}") for i in range(300)]
    rows += [(900, "q" * 700), (901, " " * 450), (902, "漢" * 200 + "z" + "漢" * 150)]
    made = []
    monkeypatch.setattr(suffix_dedup, "_split", lambda length, width, f=suffix_dedup._split: made.append(width) or f(length, width))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in suffix_dedup.cut_repeats(table, hot=50).collect()}
    assert made == [16, 1] and got == {d: x for (d, _), x in zip(rows, plain_cut([t.encode() for _, t in rows], 200), strict=True)}


def test_cut_given_texts(spark):
    rows = pairs(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    want = {d: (len(b), sum(y - x for x, y in s), len(s), hashlib.sha256(k).hexdigest()) for (d, _), b, (s, k) in zip(rows, [(t or "").encode() for _, t in rows], plain_cut([(t or "").encode() for _, t in rows], 200), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.op7_suffix_dedup(spark, "/root/testdata/sf0.001").collect()} == want


def test_cut_nothing(none, spark):
    assert suffix_dedup.cut_repeats(none).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.cut_repeats(none, length=20, spread=19)


# 8 language-model scoring


@pytest.mark.parametrize(("order", "least"), [(1, 1), (2, 2), (3, 1), (3, 2)])
def test_lm(docs, none, order, least):
    texts = [(d, WORD.findall(t or "")) for d, t in pairs(docs)]
    counts = [Counter(tuple(w[i : i + k]) for _, w in texts for i in range(len(w) - k + 1)) for k in range(order + 1)]
    total = sum(len(w) for _, w in texts)

    def score(words, i, k):
        gram = tuple(words[i - k + 1 : i + 1])
        if k == 1:
            return np.log(counts[1][gram] / total)
        return np.log(counts[k][gram] / counts[k - 1][gram[:-1]]) if counts[k][gram] >= least else np.log(0.4) + score(words, i, k - 1)

    want = Counter((d, len(w), round(sum(score(w, i, min(order, i + 1)) for i in range(len(w))), 5)) for d, w in texts)
    got = Counter((r["doc_id"], r["n_words"], round(r["log_score"], 5) + 0.0) for r in lm_score.lm_scores(docs, order=order, least=least, chunk_bytes=3000, owner_rows=100).collect())
    assert got == want and lm_score.lm_scores(none, order=order).count() == 0


def test_lm_query_takes_trigrams(spark, tmp_path):
    rows = [(1, "a b c"), (2, "a b c"), (3, "a b d"), (4, "x b c")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["log_score"] for r in lm_score.op8_lm_score(spark, str(tmp_path)).collect()}
    assert got[1] == round(np.log(3 / 12) + np.log(3 / 3) + np.log(2 / 3), 4)


def test_lm_moves_no_texts(spark, docs, monkeypatch):
    made = []
    monkeypatch.setattr(lm_score, "chunked", lambda *a, f=lm_score.chunked, **k: made.append(f(*a, **k)) or made[-1])
    lm_score.lm_scores(docs).count()
    plan = made[0].groupBy("chunk").agg(F.first("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# 9 SimHash


def plain_print(t):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, most):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= most:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_simhash(docs, none):
    rows = [(d, plain_print(t)) for d, t in pairs(docs)]
    roots = plain_components({p for _, p in rows}, 2)
    low = {}
    for d, p in rows:
        if d is not None:
            low[roots[p]] = min(d, low.get(roots[p], d))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_groups(docs).collect())
    assert got == Counter((d, f"{p:016x}", low.get(roots[p])) for d, p in rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots.values()))
    assert simhash.near_groups(none).count() == 0 and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_links(spark, hot):
    rng = np.random.default_rng(2)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)}
    for p in list(prints)[:25]:  # balls and chains around some of them
        for _ in range(8):
            p ^= (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) if rng.random() < 0.7 else 1 << int(rng.integers(64))
            prints.add(p)
    far = list(prints)[0]
    prints |= {far ^ 0b111, far ^ (0b111 << 30)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = simhash.pivot_table(spark.createDataFrame([(p,) for p in signed], "print long"))
    edges = simhash.links(table, hot=hot)
    bits = lambda x: x % (1 << 64)
    plain = plain_components(prints, 2)
    assert all(plain[bits(r["a"])] == plain[bits(r["b"])] and r["a"] != r["b"] for r in edges.collect())
    row = table.first()
    assert list(row["near"]) == [(bits(row["print"]) ^ int(p)).bit_count() for p in simhash.pivot_prints()]
    roots = {bits(r["node"]): bits(r["root"]) for r in simhash.components(edges).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for p in prints:
        mine[roots.get(p, p)].add(p)
    for p, r in plain_components(prints, 2).items():
        theirs[r].add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_pivots_discard_no_link():
    rng = np.random.default_rng(5)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 63, 40, dtype=np.uint64), np.array([7, 7 ^ 3, 7 ^ 5, 0], np.uint64)]))
    found = simhash.links_of(prints, simhash.distances(prints, simhash.pivot_prints()), 2, block=8)
    linked = {(i, j) for i in range(len(prints)) for j in range(i) if np.bitwise_count(prints[i] ^ prints[j]) <= 2}
    assert linked and {(max(x, y), min(x, y)) for x, y in found} <= {(i, j) for i in range(len(prints)) for j in range(i)}
    root = plain_components({int(p) for p in prints}, 2)
    assert len(found) == len(prints) - len(set(root.values())) and all(root[int(prints[x])] == root[int(prints[y])] for x, y in found)


def test_long_chain(spark):
    rows = [(i, i + 1) for i in range(200)] + [(500, 501)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert set(got.values()) == {0, 500} and len(got) == 203


# Near copies by Jaccard similarity (the pipeline's stage)


def plain_shingles(t):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows, least=0.8):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= least * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        low[find(i)] = min(key, low.get(find(i), key))
    return Counter(None if none else d for none, d in low.values())


def test_near_copies(spark, docs, none):
    import corpus_pipeline

    rng = np.random.default_rng(8)
    rows = []
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(30, 400)))]
        for _ in range(30 if base == 0 else 4):  # one list longer than those whose pairs are all taken
            copy = list(words)
            for i in rng.integers(0, len(copy), int(rng.integers(0, 1 + len(copy) // 40))):
                copy[i] = f"e{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(copy)))
    plain = plain_kept(rows)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert Counter(r["doc_id"] for r in got.collect()) == plain and 40 <= sum(plain.values()) < len(rows) - 60
    assert Counter(r["doc_id"] for r in near_copies.keep_one(docs).collect()) == plain_kept(pairs(docs))
    assert near_copies.keep_one(docs).columns == docs.columns and near_copies.keep_one(none).count() == 0


@pytest.mark.parametrize("block", [512, 7])
def test_near_copies_in_long_lists(spark, monkeypatch, block):
    """Texts of which most pairs are a little below the bound: each list's nearest pairs leave links between their groups."""
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 3000, 300)]
    rows = []
    for _ in range(70):
        copy = list(base)
        for i in rng.integers(0, len(copy), int(rng.integers(2, 9))):
            copy[i] = f"e{rng.integers(1 << 30)}"
        rows.append((len(rows), " ".join(copy)))
    plain = plain_kept(rows)
    monkeypatch.setattr(near_copies, "nearest", lambda sketch, least: [])  # as if the nearest pairs had told of no link
    monkeypatch.setattr(near_copies.last_links, "__defaults__", (8, block))
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(r["doc_id"] for r in got.collect()) == plain and 1 <= sum(plain.values()) < 60


def test_lists_of_nearest_pivots():
    """A list's pivots are the nearest by Hamming distances, counted one by one; sets with a similarity of 0.8 meet in some list."""
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 4, 300, 700)]
    at = np.cumsum([0, *map(len, sets)])
    clear = near_copies.clear_bits(np.concatenate(sets), at)
    tables, groups = near_copies.shape(1000)
    pivots = near_copies.pivot_prints(tables, groups)
    near = near_copies.nearest_pivots(clear, pivots)
    assert near.shape == (4, tables * groups) and tables * groups > 100
    for h, bits, found in zip(sets, clear, near, strict=True):
        words = np.concatenate([common.mixed(h ^ x).view(np.uint8).reshape(-1, 8) for x in near_copies._XOR[:-2]], axis=1)
        hashed = np.unpackbits(words, axis=1)
        assert (bits == 2 * hashed.sum(axis=0, dtype=np.int64) - len(h)).all()
        for g in range(5):
            group = pivots[:, 32 * g : 32 * g + 32].T > 0
            far = np.array([(hashed != p).sum() for p in [*group, *~group]])
            assert far[found[g]] == far.min()
    lost = pairs = 0
    for n in (4, 40, 400):
        both = [rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64) for _ in range(300)]
        less, more = (near_copies.clear_bits(np.concatenate([x[:k] for x in both]), k * np.arange(301)) for k in (n, n + n // 4))
        a, b = (near_copies.nearest_pivots(x, pivots).reshape(300, tables, groups) for x in (less, more))
        lost, pairs = lost + 300 - int((a == b).all(axis=2).any(axis=1).sum()), pairs + 300
        assert (((less > 0) != (more > 0)).sum(axis=1) <= near_copies.far(np.full(300, n))).all()
    assert lost <= 0.005 * pairs


def test_lists_over_batches():
    """Lists may span batches; a pair is told of only in the first table that lists it, and each set but the first with its nearest."""
    rng = np.random.default_rng(9)
    sketch = np.repeat(rng.integers(0, 1 << 63, (8, 8), dtype=np.uint64), 5, axis=0)
    key = np.repeat(np.arange(8), 5) * (1 << 16) + 2048
    cells = np.repeat(np.arange(8, dtype=np.uint32), 5)[:, None] + np.zeros((1, 3), np.uint32)
    for place, rows in ((0, 40), (1, 0)):
        columns = {"key": key, "place": np.full(40, place), "node": np.arange(40), "n": np.full(40, 256)}
        made = pa.table({**columns, "sketch": [x.tobytes() for x in sketch], "cells": [x.tobytes() for x in cells]})
        for size in (1, 3, 7, 40):
            out = pa.Table.from_batches(near_copies._by_list(near_copies._meet, 0.8)(iter(made.to_batches(max_chunksize=size)))).to_pylist()
            assert len(out) == rows and sum(r["near"] >= 0 for r in out) == rows * 4 // 5
            assert all(r["size"] == 5 and r["rank"] == r["node"] % 5 and (r["near"] < 0 or r["near"] // 5 == r["node"] // 5) for r in out)


def test_candidates_of_many_copies(spark, monkeypatch):
    """Candidates grow with the sets of a group of near copies, not with their pairs."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 3000, 200)]
    rows = []
    for i in range(300):
        copy = list(base)
        copy[int(rng.integers(200))] = f"e{i}"
        rows.append((i, " ".join(copy)))
    seen, inner = {}, near_copies.table

    def noted(df, name):
        seen[name] = inner(df, name)
        return seen[name]

    monkeypatch.setattr(near_copies, "scratch", lambda spark: contextlib.nullcontext([None]))
    monkeypatch.setattr(near_copies, "table", noted)
    assert [r["doc_id"] for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()] == [0]
    assert 299 <= seen["near-pairs"].count() <= 600


def test_near_copies_of_given_texts(spark):
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert Counter(r["doc_id"] for r in near_copies.keep_one(full).collect()) == plain_kept(pairs(full))


# 10 language ID


def test_language(spark, docs, none):
    full = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op10_language_id(spark, "/root/testdata/sf0.01").join(full.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = out.filter("lang = lang_pred").count()
    assert right >= 0.98 * out.count() > 100
    model = language_id.fit([("en", "the and of that with"), ("de", "der und das mit für")])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.languages(docs, model).collect()}
    assert got[4] == ("und", 0.0) and got[5][0] == got[6][0] == got[11][0] == "und" and got[16][0] == "und"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(model, ["und das der", "that with the"])[0] == ["de", "en"]
    assert language_id.languages(none, model).count() == 0 and language_id.predict(language_id.fit([]), ["a"]) == (["und"], [0.0])
    assert language_id.keep_known(docs).columns == docs.columns and language_id.keep_known(none).count() == 0


def test_filter_corrects_for_false_positives(monkeypatch):
    rng = np.random.default_rng(3)
    text = lambda letters, n: "".join(rng.choice(list(letters), n))
    monkeypatch.setattr(language_id, "log2_cells", lambda most: 10)
    model = language_id.fit([("a", text("abcd", 5000)), ("b", text("wxyz", 50))])
    share = language_id.shares(model, [text("mnop", 3000)])[0]
    assert model.rates[0] > 0.1 and share[0] < 0.1


def test_sample_is_bounded(docs, spark):
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    assert language_id.training_rows(docs, most=5).count() <= 5 and language_id.training_rows(docs).count() == labelled.count()
    rows = [(r["lang"], r["text"]) for r in labelled.collect()]
    one, two = language_id.fit(rows), language_id.learned(docs)
    assert one.langs == two.langs and (one.cells == two.cells).all() and (one.rates == two.rates).all()
    long = spark.createDataFrame([(1, "a b " * 3000 + "qqqq", "x"), (2, "c d", "y")], "doc_id long, text string, lang string")
    assert language_id.shares(language_id.learned(long), ["qqqq"])[0].tolist() == [1.0, 0.0]


def test_filters_equal_sets_of_ngrams():
    """Against exact sets: the share of a text's n-grams that a language has, whichever word of the cells holds it."""
    rng = np.random.default_rng(4)
    text = lambda j, n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz")[j % 20 : j % 20 + 6], n))
    rows = [(f"l{j:02}", text(j, 200)) for j in range(70)]
    model = language_id.fit(rows)
    grams = lambda t: [b for raw in [language_id.prepared([t])[0].tobytes()] for b in (raw[i : i + 4] for i in range(len(raw) - 3))]
    sets = {lang: set(grams(t)) for lang, t in rows}
    tests = [text(j, 60) for j in range(0, 70, 7)] + ["", "z"]
    want = [[sum(g in sets[lang] for g in grams(t)) / max(1, len(grams(t))) for lang in model.langs] for t in tests]
    assert len(model.cells) == 2 and abs(language_id.shares(model, tests) - np.array(want)).max() < 0.02


def test_many_languages(spark):
    letters = [chr(0x4E00 + 50 * j) + chr(0x4E01 + 50 * j) + chr(0x4E02 + 50 * j) for j in range(65)]
    rows = [(i, " ".join([letters[i % 65]] * 9), f"l{i % 65:02}") for i in range(650)] + [(1000 + i, f"plain words {i}", "en") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.keep_known(table).count() == len(rows)
    found = language_id.languages(table, language_id.learned(table), columns=("lang",)).filter("lang = lang_pred").count()
    assert found == len(rows)


def test_rare_languages_are_learned_and_kept(spark):
    rows = [(i, f"the word {i} and that of it", "en") for i in range(3000)] + [(5000 + i, "ένα κείμενο στα ελληνικά", "el") for i in range(6)]
    rows += [(6000, "слово само", "ru"), (6001, "12 !?", "ru"), (6002, None, "ru"), (6003, "ქართული ენა", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = Counter(r["lang"] for r in language_id.training_rows(table, most=300).collect())
    assert sample["el"] == 6 and sum(sample.values()) <= 300 and sample["en"] == 100
    kept = {r["doc_id"] for r in language_id.keep_known(table).collect()}
    assert kept >= set(range(3000)) | set(range(5000, 5006)) | {6000} and not kept & {6001, 6002, 6003}
    plain = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in language_id.keep_known(plain).collect()} == {d for d, _, _ in rows} - {6001, 6002}


# Shared by all


def test_columns_with_dots_and_backticks(spark, docs):
    """Columns of any name go through every stage that returns whole rows."""
    odd = docs.withColumn("a.b", F.lit("x")).withColumn("c`d", F.col("doc_id")).withColumn("__text", F.lit(1))
    for stage in (language_id.keep_known, exact_dedup.keep_first, near_copies.keep_one, simhash.keep_one, mixing.mixed):
        out = stage(odd)
        assert out.columns == odd.columns and all(r["a.b"] == "x" and r["c`d"] == r["doc_id"] for r in out.collect())
    names = ("doc_id", "a.b", "c`d", "__text")
    assert bpe.digests(odd, columns=names).columns[:4] == list(names) and bpe.digests(odd, columns=names).count() == odd.count()
    assert bpe.decode(bpe.encode(odd, columns=names), columns=names).count() == odd.count()


def test_buckets_grow_with_the_input():
    assert common.buckets_for(10**9, 200, 100_000) == 200
    assert common.buckets_for(100 << 40, 200, 1_000_000) == 409_600 and common.buckets_for(100 << 40, 200, 100_000) == 100_000


def test_archive_of_many_terabytes(spark):
    """An index that names 20 TB gives a bounded number of tasks, each of a bounded number of records."""
    assert warc.tasks_for(0, 1 << 20) == (1 << 20, 1) and warc.tasks_for(10 << 20, 1 << 20) == (1 << 20, 10)
    size, tasks = warc.tasks_for(20 << 40, 1 << 20)
    assert tasks <= warc.MOST_TASKS and size * tasks >= 20 << 40
    row = [(1, 0, "u", "response", "d", "file:///no", 0, 20 << 40)]
    plan = warc.read(spark.createDataFrame(row, warc.INDEX))
    assert plan.columns[0] == "page_id"  # planned, without a driver that runs out of memory


def test_a_page_that_very_many_share(spark):
    html = ["x" * 200] * 900 + ["y" * 150] * 3 + [f"z{i}" * 80 for i in range(100)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(6)
    rows = {r["page_id"]: r["refers_to"] for r in warc.read(warc.write(pages, hot_share=0.01)).collect()}
    assert rows == {i: 0 if 0 < i < 900 else 900 if 900 < i < 903 else None for i in range(len(html))}
