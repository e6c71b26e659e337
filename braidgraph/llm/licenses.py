"""License scans by patience alignment.

Texts and templates are sequences of lower-case words. A template can only reach the coverage asked for if that share of its
words occurs in the text at all, which rules nearly every template out for nearly every text and loses none. For
the rest, the text's places of template words are cut into stretches where more than `widest_gap` other words stand between two of them (the template's
length less 10 words, so that a notice of a dozen words must stand unbroken), and windows of a stretch are aligned: words unique to
both sides anchor them, their longest increasing subsequence is kept, and the gaps between anchors are
aligned in the same way (common ends first; small gaps without unique words by longest common subsequence).
Only words of the template take room in a window, so words put in between don't push others out; a window has room for 1.2 templates,
or for 2 where none of these is a find. A window whose alignment covers at least `coverage` percent of the template is a find, at the start that
aligns most words; what lies before and behind it in the stretch is searched again. A license is thus found with any number of insertions of
up to `widest_gap` words each, as long as they hold no more words of the template than the template itself.

Defined results: null and empty texts give no find; null doc_ids and repeated rows are scanned row by row; where finds of
several templates overlap, the one with more aligned words stays (ties: the template's order); an empty table gives
an empty result. Only the two named columns are read. Templates are a fixed list, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.common import arrow_schema, tidied

FINDS = "doc_id long, license string, start long, end long, n_aligned long, n_template long, coverage double"
COVERAGE = 80
#: Gaps of at most so many words on both sides, without unique words, are aligned by dynamic programming.
SMALL = 48
_word = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Texts and notices of public licenses.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "lgpl-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "all-rights-reserved": "All rights reserved.",
}


def folded(text: str) -> str:
    """Lower case, place by place (characters whose lower case is longer stay as they are)."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[str]:
    return _word.findall(folded(text))


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence (piles of patience sorting)."""
    tops: list[int] = []
    pile: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(pile[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        pile[k : k + 1] = [i]
    out, i = [], pile[-1] if pile else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of two short lists."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of aligned places, rising on both sides."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        unique = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        if unique:
            anchors = [unique[k] for k in rising([j for _, j in unique])]
            out += anchors
            for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
                work.append((i + 1, k, j + 1, m))
        elif a1 - a0 <= SMALL and b1 - b0 <= SMALL:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, words_of(text)
        self.known = frozenset(self.words)
        self.times = Counter(self.words)

    def reach(self, present: set[str]) -> int:
        """Words of the template that an alignment could cover at most."""
        return sum(n for w, n in self.times.items() if w in present)


def widest_gap(size: int) -> int:
    """Other words that may stand between two neighbouring words of a find."""
    return max(1, size - 10)


def scan(text: str | None, templates: list[Template], coverage: int = COVERAGE) -> list[tuple[str, int, int, int, int]]:
    """(license, start, end, aligned words, template words) of a text's finds, by place; code points."""
    if not text:
        return []
    lower = folded(text)
    words = _word.findall(lower)
    present = set(words)
    likely = [t for t in templates if 100 * t.reach(present) >= coverage * len(t.words)]
    if not likely:
        return []
    finds, spans = [], [m.span() for m in _word.finditer(lower)]
    for order, t in enumerate(likely):
        size, gap = len(t.words), widest_gap(len(t.words))
        places = [i for i, w in enumerate(words) if w in t.known]
        held = [words[i] for i in places]
        cuts = [0, *(k for k in range(1, len(places)) if places[k] - places[k - 1] > gap + 1), len(places)]
        stretches = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        while stretches:  # a stretch may hold a text several times, or common words before it
            low, high = stretches.pop()
            if 100 * t.reach(set(held[low:high])) < coverage * size:
                continue
            found = _best(held, low, high, t, coverage, size + size * (100 - coverage) // 100 + 2) or _best(held, low, high, t, coverage, 2 * size)
            if found:
                first, last, aligned = found
                finds.append((aligned, order, t.name, places[first], places[last], size))
                stretches += [(low, first), (last + 1, high)]
    finds.sort(key=lambda f: (-f[0], f[1], f[3]))
    kept: list[tuple] = []
    for f in finds:
        if all(f[4] < k[3] or f[3] > k[4] for k in kept):
            kept.append(f)
    return sorted((name, spans[first][0], spans[last][1], aligned, size) for aligned, _, name, first, last, size in kept)


def _best(held: list[str], low: int, high: int, t: Template, coverage: int, width: int) -> tuple[int, int, int] | None:
    """Best window of `width` among those that start before the end of the first one whose alignment covers enough: (first place, last
    place, aligned words), with most aligned words, then fewest places in all. held: the text's words that the template knows."""
    size = len(t.words)
    #: A find must hold one of the first words of the template; which can be missing: so many.
    heads = set(t.words[: size * (100 - coverage) // 100 + 1])
    best: tuple[int, int, int] | None = None
    inside: Counter[str] = Counter()
    end, upto, reach = high - 1, low, 0  # reach: words that held[start:upto] and the template have in common, each as often as both
    for start in range(low, high):
        if start > end or (best and best[2] == size):
            break
        while upto < min(high, start + width):
            w = held[upto]
            inside[w] += 1
            reach += inside[w] <= t.times[w]
            upto += 1
        if held[start] in heads and 100 * reach >= coverage * size and not (best and reach < best[2]):
            pairs = patience(held[start:upto], t.words)
            if 100 * len(pairs) >= coverage * size:
                first, last = start + pairs[0][0], start + pairs[-1][0]
                if best is None:
                    end = last
                if best is None or (len(pairs), best[1] - best[0]) > (best[2], last - first):
                    best = first, last, len(pairs)
        w = held[start]
        reach -= inside[w] <= t.times[w]
        inside[w] -= 1
    return best


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: int = COVERAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """FINDS: one row for each license text or notice found in each row of docs."""
    known = [Template(k, v) for k, v in (templates or TEMPLATES).items()]
    schema = arrow_schema(FINDS)

    def run(batches):
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(i, name, a, b, n, size, n / size) for name, a, b, n, size in scan(t.as_py(), known, coverage)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(run), FINDS)
