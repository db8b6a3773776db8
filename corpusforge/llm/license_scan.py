"""License scan by patience alignment.

A template is a license text or notice. Words that are unique to both template and text
are paired, the longest increasing subsequence of the pairs anchors the alignment, and
the gaps between anchors are aligned in the same way; a gap without unique words is
settled by a longest common subsequence, which the window's size bounds. A hit covers at
least ``COVERAGE`` of the template's words, all of a notice of fewer than ``SHORT``,
where one word tells one license from another, with at most ``SLACK`` times as many
words of text. Of hits that overlap, the one with the most words wins.

Where to align follows from the words alone: a hit has so many of the template's words,
each as often as there, in a window of ``SLACK`` times its length. Texts, and then
windows, that have too few cannot hold a hit; all others are aligned. No word is asked
for by name, so an edit anywhere costs no more than its words.

Everything happens where the text is read: no shuffle, and texts are read whole.

Defined results: null and empty texts have no hits; null ids pass through; repeated
rows give repeated hits; of overlapping hits with as many words the better covered, then
the earlier, then the first by name counts; an empty table gives an empty result; other
columns are ignored. Words are runs of letters and digits, compared in lower case.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE, SLACK, SHORT = 0.8, 1.6, 20
WORD = re.compile(r"[^\W_]+")

_AS_IS = (
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
    "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. " + _AS_IS
)
_ISC_TAIL = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the "
    "Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it "
    "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "{0}General Public License for more details."
)

#: name -> text
TEMPLATES = {
    "MIT-notice": "Released under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0",
    "all-rights-reserved": "All rights reserved",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. " + _ISC_TAIL
    ),
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_TAIL,
    "Zlib": (
        'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages '
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
        "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
        "under copyright law."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "GPL-2.0-header": _GNU.format("", "2"),
    "GPL-3.0-header": _GNU.format("", "3"),
    "LGPL-3.0-header": _GNU.format("Lesser ", "3"),
    "AGPL-3.0-header": _GNU.format("Affero ", "3"),
}


def words_of(text: str) -> list[str]:
    return [m.group().lower() for m in WORD.finditer(text)]


def longest_increasing(seq: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = []
    for k, x in enumerate(seq):
        p = bisect_left(tops, x)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(x), at.append(k)
        else:
            tops[p], at[p] = x, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def common_subsequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[str], b: list[str], i: int = 0, j: int = 0) -> list[tuple[int, int]]:
    """Pairs (position in a, position in b) of aligned equal words, rising in both."""
    if not a or not b:
        return []
    place_a, place_b = ({w: k for k, w in enumerate(x)} for x in (a, b))
    count_a, count_b = ({} for _ in range(2))
    for x, c in ((a, count_a), (b, count_b)):
        for w in x:
            c[w] = c.get(w, 0) + 1
    shared = [w for w in a if count_a[w] == 1 and count_b.get(w) == 1]
    if not shared:
        return [(i + p, j + q) for p, q in common_subsequence(a, b)] if count_a.keys() & count_b.keys() else []
    anchors = [shared[k] for k in longest_increasing([place_b[w] for w in shared])]
    out, last_a, last_b = [], 0, 0
    for w in anchors:
        p, q = place_a[w], place_b[w]
        out += patience(a[last_a:p], b[last_b:q], i + last_a, j + last_b)
        out.append((i + p, j + q))
        last_a, last_b = p + 1, q + 1
    return out + patience(a[last_a:], b[last_b:], i + last_a, j + last_b)


class Scanner:
    """Finds templates in texts. ``often[t, w]``: how often word w is in template t."""

    def __init__(self, templates: dict = TEMPLATES):
        self.names, self.words = list(templates), [words_of(t) for t in templates.values()]
        self.ids = {w: k for k, w in enumerate(sorted({w for t in self.words for w in t}))}
        self.often = np.zeros((len(self.words), len(self.ids) + 1), np.int32)
        for k, t in enumerate(self.words):
            for w in t:
                self.often[k, self.ids[w]] += 1
        self.need = np.array([len(t) if len(t) < SHORT else math.ceil(COVERAGE * len(t) - 1e-9) for t in self.words])

    def scan(self, text: str | None) -> list[tuple[str, int, int, float, int]]:
        """(template, start, end, coverage, matched words) of each hit, by start; code points, end exclusive."""
        words = [w.lower() for w in WORD.findall(text or "")]
        if not words:
            return []
        none, get = len(self.ids), self.ids.get
        own = np.array([get(w, none) for w in words], np.int64)
        have = np.minimum(np.bincount(own, minlength=none + 1), self.often).sum(axis=1)
        found = [h for t in np.flatnonzero(have >= self.need) for h in self._hits(int(t), own, words)]
        if not found:
            return []
        spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
        found.sort(key=lambda h: (-h[0], -h[1], h[3], h[2]))
        starts: list[int] = []
        ends: dict[int, int] = {}
        hits = []
        for matched, share, name, a, b in found:
            # Hits that are taken lie apart, so only the last that starts before b can overlap.
            k = bisect_left(starts, b + 1)
            if not k or ends[starts[k - 1]] < a:
                starts.insert(k, a)
                ends[a] = b
                hits.append((name, spans[a][0], spans[b][1], share, matched))
        return sorted(hits, key=lambda h: h[1])

    def _hits(self, t: int, own: np.ndarray, words: list[str]):
        """(matched, coverage, name, first, last word) of template ``t`` where a window has words enough."""
        template, need = self.words[t], self.need[t]
        n, widest, step = len(template), int(SLACK * len(template)), max(1, len(template) // 8)
        places = np.flatnonzero(self.often[t][own] > 0)
        # Words of the template in the window that starts at each of them.
        enough = np.searchsorted(places, places + widest + step) - np.arange(len(places)) >= need
        limit, free = Counter(template), 0
        for at in places[enough].tolist():
            if at < free:
                continue
            free = at + step
            bag = Counter(w for w in words[at : at + widest + step] if w in limit)
            if sum(min(c, limit[w]) for w, c in bag.items()) < need:
                continue
            lo = max(0, at - n // 2)
            pairs = self._tight(patience(template, words[lo : at + widest + step + n // 2]), n)
            if len(pairs) < need:
                continue
            a, b = lo + pairs[0][1], lo + pairs[-1][1]
            if b - a + 1 <= max(SLACK * n, n + 2):
                yield len(pairs), len(pairs) / n, self.names[t], a, b
                free = max(free, b + 1)

    @staticmethod
    def _tight(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """Without matches at the ends that lie far from the rest."""
        gap = 3 + n // 4
        while len(pairs) > 1 and pairs[1][1] - pairs[0][1] > gap + pairs[1][0] - pairs[0][0]:
            pairs = pairs[1:]
        while len(pairs) > 1 and pairs[-1][1] - pairs[-2][1] > gap + pairs[-1][0] - pairs[-2][0]:
            pairs = pairs[:-1]
        return pairs


def find_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict | None = None) -> DataFrame:
    """(doc_id, license, start, end, coverage, matched_words): a row for each hit."""
    scanner = Scanner(templates or TEMPLATES)
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def work(batches):
        for b in batches:
            rows = [(i.as_py(), *h) for i, t in zip(b.column(0), b.column(1)) for h in scanner.scan(t.as_py())]
            if rows:
                kinds = (b.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "license", "start", "end", "coverage", "matched_words"])

    found = slim.mapInArrow(work, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, license string, start long, `end` long, coverage double, matched_words long")
    return found.withColumnRenamed("doc_id", doc_id)


def op6_license_scan(spark, sf_dir):
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
