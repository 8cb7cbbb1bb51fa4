"""License scans by patience alignment.

A notice is known by phrases that it must hold word for word, such as the license's name and version; without one of them in the text
there is no match. Each occurrence of the phrase that the text has least often is the first anchor of an alignment. On both sides of
it, words that occur once in the text there and once in the template are anchors; the longest run of anchors in the same order in
both (a longest increasing subsequence) is kept; the gaps between them are aligned the same way, where more words are unique. The
share of a template's words that are aligned is its coverage.

In a whole book the words of any short notice can be found in order, pages apart. So what is aligned counts only as far as it goes on
gaining, outwards from the phrase: each aligned word is worth one, each word of the text between two of them costs an eighth. No word
further away than nine times the template's words can gain anything, whatever else is aligned, so no more of the text is looked at.
Of matches that overlap, the one with the most words stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rounds, utf8

# Notices of public licenses. What stands in brackets must be there word for word.
NAMES = {
    "MIT": ("MIT License",),
    "Apache-1.1": ("Apache License 1.1", "Apache License, Version 1.1", "Apache Software License 1.1"),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD": ("BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL v3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL v3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
}
CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "[Redistribution and use in source and binary forms], with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = f"{_BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to [endorse or promote products] derived from this software without specific prior written permission."
_MIT = "[Permission is hereby granted], free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, [sublicense], and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
TEXTS = {
    "MIT": (
        _MIT,
        f"{_MIT} THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": ("Licensed under the [Apache License], Version [2.0] (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",),
    "BSD": (_BSD,),
    "BSD-2-Clause": (_BSD_2, f"{_BSD_2} {_WARRANTY}"),
    "BSD-3-Clause": (f"{_BSD_2} {_NO_NAMES}", f"{_BSD_2} {_NO_NAMES} {_WARRANTY}"),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the [GNU General Public License] as published by the Free Software Foundation; either [version 2] of the License, or (at your option) any later version.",),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public License] as published by the Free Software Foundation, either [version 3] of the License, or (at your option) any later version.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License] as published by the Free Software Foundation; either [version 2.1] of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License] as published by the Free Software Foundation, either [version 3] of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the [GNU Affero General Public License] as published by the Free Software Foundation, either [version 3] of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the [Mozilla Public License], v. [2.0]. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "ISC": ("[Permission to use, copy, modify, and/or distribute this software] for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to [alter it and redistribute it freely], subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",),
}


def notices() -> dict[str, tuple[str, ...]]:
    """By license: its texts, short notices that name it, and its identifier."""
    out = {name: [f"under the [{n}]" for n in names] for name, names in NAMES.items()}
    for kind, long in CC_KINDS.items():
        out[f"CC-{kind}-4.0"] = [f"under [CC {kind} 4.0]", f"under the [CC {kind} 4.0]", f"under a [Creative Commons {long} 4.0] International License", f"under the [Creative Commons {long} 4.0] International License"]
    for name in out:
        out[name] = [*TEXTS.get(name, ()), *out[name], f"[SPDX-License-Identifier: {name}]"]
    return {name: tuple(t) for name, t in out.items()}


TEMPLATES = notices()
#: What a word of the text between two aligned words costs.
GAP = 1 / 8
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores; a licence is a license."""
    return [w.replace("licence", "license") if "licence" in w else w for w in _WORD.findall(text.lower())]


@dataclass
class Template:
    """A notice's words and the ranges of those that must be there word for word."""

    license: str
    words: list[str]
    must: list[tuple[int, int]]

    @staticmethod
    def of(license: str, notice: str) -> Template:
        out = Template(license, [], [])
        for k, part in enumerate(re.split(r"[\[\]]", notice)):
            start = len(out.words)
            out.words += words(part)
            if k % 2 and len(out.words) > start:
                out.must.append((start, len(out.words)))
        if not out.words:
            raise ValueError("a template has no word")
        return out


def increasing(values: list[int]) -> list[int]:
    """The positions of a longest strictly increasing subsequence: of equally long ones the one with the smallest last value, then
    with the smallest value that can stand before it, and so on."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
        before[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(template: list[str], text: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions (in template, in text) of words that the alignment matches, ascending in both."""
    out, todo = [], [(0, len(template), 0, len(text))]
    while todo:
        a, b, c, d = todo.pop()
        # Equal words at the edges of a gap are matched first, as between anchors they belong to them.
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(template[a:b]), Counter(text[c:d])
        where = {w: i for i, w in enumerate(template[a:b], a) if ours[w] == 1 and theirs[w] == 1}
        anchors = [(where[w], j) for j, w in enumerate(text[c:d], c) if w in where]
        kept = [anchors[i] for i in increasing([i for i, _ in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def gaining(pairs: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Those of the aligned pairs around start to end (of pairs) that go on gaining, outwards."""

    def reach(order: list[tuple[int, int]], at: int) -> int:
        best = total = 0.0
        far = 0
        for k, (_, j) in enumerate(order, 1):
            total += 1 - GAP * (abs(j - at) - 1)
            if total > best:
                best, far = total, k
            at = j
        return far

    left = reach(pairs[:start][::-1], pairs[start][1])
    right = reach(pairs[end:], pairs[end - 1][1])
    return pairs[start - left : end + right]


@dataclass(frozen=True)
class Match:
    license: str
    coverage: float
    first: int
    last: int
    matched: int


class Scanner:
    """Finds templates in texts. A template without phrases in brackets must hold its first word."""

    def __init__(self, templates: dict[str, str | tuple[str, ...]], least: float):
        self.templates = [Template.of(name, t) for name, ts in sorted(templates.items()) for t in ([ts] if isinstance(ts, str) else ts)]
        for t in self.templates:
            t.must = t.must or [(0, 1)]
        self.least = least
        self.all = frozenset(w for t in self.templates for w in t.words)

    @staticmethod
    def occurrences(phrase: list[str], text: list[str], places: dict[str, list[int]]) -> list[int]:
        """Where the text has the phrase word for word; looked for at the places of its rarest word."""
        k = min(range(len(phrase)), key=lambda i: len(places.get(phrase[i], ())))
        return [p - k for p in places.get(phrase[k], ()) if p >= k and text[p - k : p - k + len(phrase)] == phrase]

    def matches(self, t: Template, text: list[str], places: dict[str, list[int]]) -> Iterator[Match]:
        """The template's matches, one at most for each occurrence of its rarest phrase."""
        n = len(t.words)
        if any(w not in places for a, b in t.must for w in t.words[a:b]):
            return
        found = [self.occurrences(t.words[a:b], text, places) for a, b in t.must]
        k = min(range(len(found)), key=lambda i: len(found[i]))
        if not all(found):
            return
        (a, b), reach = t.must[k], round(n / GAP) + n
        size = b - a
        for i, p in enumerate(found[k]):
            low = max(found[k][i - 1] + size if i else 0, p - reach)
            high = min(found[k][i + 1] if i + 1 < len(found[k]) else len(text), p + size + reach)
            low, high = min(low, p), max(high, p + size)
            before = [(x, y + low) for x, y in aligned(t.words[:a], text[low:p])]
            after = [(x + b, y + p + size) for x, y in aligned(t.words[b:], text[p + size : high])]
            pairs = gaining([*before, *((a + j, p + j) for j in range(size)), *after], len(before), len(before) + size)
            where = dict(pairs)
            whole = all(c in where and all(where.get(x) == where[c] + x - c for x in range(c, d)) for c, d in t.must)
            if whole and len(pairs) / n >= self.least:
                yield Match(t.license, len(pairs) / n, pairs[0][1], pairs[-1][1], len(pairs))

    def scan(self, text: str | None) -> list[Match]:
        """The best match of each license that is found, the best coverage first, then the most words."""
        found = words(text or "")
        places: dict[str, list[int]] = {}
        for i, w in enumerate(found):
            if w in self.all:
                places.setdefault(w, []).append(i)
        kept: list[Match] = []
        ends: list[int] = []  # of kept, which don't overlap and are sorted by place
        for m in sorted((m for t in self.templates for m in self.matches(t, found, places)), key=lambda m: (-m.matched, -m.coverage, m.first, m.license)):
            i = bisect_left(ends, m.first)
            if i == len(kept) or kept[i].first > m.last:
                kept.insert(i, m)
                ends.insert(i, m.last)
        best: dict[str, Match] = {}
        for m in sorted(kept, key=lambda m: (-m.coverage, -m.matched, m.first)):
            best.setdefault(m.license, m)
        return sorted(best.values(), key=lambda m: (-m.coverage, -m.matched, m.license))


_MATCH = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def licenses(docs: DataFrame, *, templates: dict[str, str | tuple[str, ...]] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and matches (license, coverage, first_word, last_word; the best first) of each row's whole text.

    templates: notices by license, with the phrases in brackets that they must hold. A template is a match if it holds them and at
    least `least` of its words are aligned; of overlapping matches the one with the most words stays, of a license the best. Null, empty and wordless texts have no matches;
    repeated rows stay; an empty table gives an empty result; other columns are not read.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            _, offsets = utf8(text)
            for a, b in rounds(np.diff(offsets)):
                found = [[{"license": m.license, "coverage": m.coverage, "first_word": m.first, "last_word": m.last} for m in scanner.scan(t)] for t in text.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(found, pa.list_(_MATCH))], names=["doc_id", "matches"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(run, "doc_id long, matches array<struct<license:string,coverage:double,first_word:bigint,last_word:bigint>>")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    found = licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.get("matches", F.lit(0))
    return found.select("doc_id", best["license"].alias("license"), F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"), best["first_word"].alias("first_word"), best["last_word"].alias("last_word"), F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"))
