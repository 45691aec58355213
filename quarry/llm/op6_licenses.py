"""Licence scan by patience alignment.

A text is aligned with a licence template by patience: words that are unique both in
the text and in the template are anchors, the longest increasing subsequence of them is
kept, and the gaps between them are aligned in the same way, after the equal words at
their ends; a gap without anchors is done. The share of the template's words that are
aligned is its coverage. A template fits from ``COVERAGE`` on; one of fewer than ``SHORT``
words, where a single word tells one licence from another, only as a whole.

Before the alignment a bound tells which templates can fit at all: a text has no more
aligned words than words in common, each counted as often as it is in both. Fits are
sought first close to the template's rarest words, and then in all that is left of the
text between them. The aligned words make up at least ``DENSITY`` of the stretch that
they lie in, so that words strewn over a long text are no licence. Each document is
looked at by itself, in one pass and without a shuffle.

Defined cases: a null text or one without words has no licence and coverage 0; repeated
rows are scanned each; every place of every template is a row of its own, except those
whose words a fit of more words holds (then of higher coverage, of the longer template,
of the first name); other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices

COVERAGE, DENSITY, SHORT = 0.8, 0.1, 20
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

# Notices and texts of public licences.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "LGPL-2.1 header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "LGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC0-1.0 statement": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}

# The conditions of Creative Commons licences, and how versions name their reach.
CONDITIONS = {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-ND": "-NoDerivatives", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
REACH = {"3.0": "Unported", "4.0": "International"}


def _creative_commons() -> dict[str, str]:
    out = {}
    for short, full in CONDITIONS.items():
        for version, reach in REACH.items():
            named = full if version == "4.0" else full.replace("NoDerivatives", "NoDerivs")
            out[f"CC-BY{short}-{version} notice"] = f"Licensed under CC BY{short} {version}."
            out[f"CC-BY{short}-{version} statement"] = f"This work is licensed under a Creative Commons Attribution{named} {version} {reach} License."
    return out


TEMPLATES |= _creative_commons()


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _unique(xs: list, low: int, high: int) -> dict:
    n, at = Counter(xs[low:high]), {}
    for i in range(low, high):
        if n[xs[i]] == 1:
            at[xs[i]] = i
    return at


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of ``pairs``, in order of their first number, with rising second numbers."""
    tops, back, at = [], [], []
    for k, (_, j) in enumerate(pairs):
        i = bisect_left(tops, j)
        tops[i : i + 1] = [j]
        at[i : i + 1] = [k]
        back.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Places (in a, in b) of the words that patience alignment matches, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al == ah or bl == bh:
            continue
        in_a, in_b = _unique(a, al, ah), _unique(b, bl, bh)
        anchors = _increasing(sorted((i, in_b[w]) for w, i in in_a.items() if w in in_b))
        if not anchors:
            continue
        out += anchors
        edges = [(al - 1, bl - 1), *anchors, (ah, bh)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


class Scanner:
    """Templates as word lists, and the search of a text for them."""

    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = [(name, w, Counter(w)) for name, w in sorted(((n, words(t)) for n, t in templates.items()), key=lambda x: (-len(x[1]), x[0]))]
        self.known = frozenset().union(*(c for _, _, c in self.templates))

    def least(self, template: list[str]) -> float:
        """How many words of a template a fit has at least."""
        return self.coverage * len(template) if len(template) >= SHORT else len(template)

    def windows(self, text: list[str], template: list[str], n: Counter) -> tuple[list[tuple[int, int]], list[int]]:
        """Stretches of the text, of up to three template lengths, in which the template could lie
        whole: an anchor there is unique even if the word occurs again far away. And the places of
        the words that each fit must have one of, the rarest first."""
        rare = Counter(w for w in text if w in n)
        marks = sorted(n, key=lambda w: (rare[w], w))
        allowed = len(template) - int(-(-self.least(template) // 1))
        left, out = allowed, []
        for w in marks:  # without all of these words the rest can't reach the coverage
            out += [i for i, x in enumerate(text) if x == w] if rare[w] else []
            left -= n[w]
            if left < 0:
                break
        size, merged = len(template), []
        for i in sorted(out):
            low, high = max(0, i - size), min(len(text), i + size + 1)
            if merged and low <= merged[-1][1] and high - merged[-1][0] <= 3 * size:
                merged[-1][1] = high
            else:
                merged.append([low, high])
        return [tuple(x) for x in merged], out

    def places(self, text: list[str], template: list[str], n: Counter) -> list[list[int]]:
        """The aligned places in the text of each fit of the template; fits don't overlap."""
        out = self.near(text, template, n)
        todo = [(a, b) for a, b in zip([0, *(x[-1] + 1 for x in out)], [*(x[0] for x in out), len(text)], strict=True)]
        while todo:  # what is left between fits is aligned as a whole
            low, high = todo.pop()
            part = text[low:high]
            held = Counter(w for w in part if w in n)
            if sum(min(k, held[w]) for w, k in n.items()) < self.least(template):
                continue
            at = [low + a for a, _ in aligned(part, template)]
            if self.fits(at, template):
                insort(out, at)
                todo += [(low, at[0]), (at[-1] + 1, high)]
        return out

    def fits(self, at: list[int], template: list[str]) -> bool:
        return len(at) >= self.least(template) and len(at) >= DENSITY * (at[-1] - at[0] + 1)

    def near(self, text: list[str], template: list[str], n: Counter) -> list[list[int]]:
        """Fits in the stretches around the template's marks.

        Where a mark is unique in its stretch the whole stretch is aligned; where it recurs, as with
        copies side by side, first what the template's length leaves around it."""
        stretches, marks = self.windows(text, template, n)
        lows, size, tried, out = [x[0] for x in stretches], len(template), set(), []
        offsets: dict = {}
        for k, w in enumerate(template):
            offsets.setdefault(w, []).append(k)
        for i in marks:
            k = bisect_right(out, [i])
            before, after = out[k - 1][-1] + 1 if k else 0, out[k][0] if k < len(out) else len(text)
            if before > i or k < len(out) and after == i:
                continue
            k = bisect_right(lows, i)
            while k and stretches[k - 1][1] <= i:
                k -= 1
            wide = stretches[k - 1] if k else (i, i + 1)
            tight = [(i - o - size // 4, i - o + size + size // 4) for o in offsets[text[i]]]
            for low, high in [wide] if text[max(wide[0], before) : min(wide[1], after)].count(text[i]) == 1 else [*tight, wide]:
                low, high = max(low, before), min(high, after)
                if (low, high) in tried:
                    continue
                tried.add((low, high))
                at = [low + a for a, _ in aligned(text[low:high], template)]
                if self.fits(at, template):
                    insort(out, at)
                    break
        return out

    def found(self, text: str | None) -> tuple[int, list[tuple[str, float, int, int]]]:
        """The number of words, and (name, coverage, first and last aligned word) of every place of every
        template that fits, in order. A fit is left out if its words belong to a fit of more words."""
        seen = words(text)
        n, fits = Counter(w for w in seen if w in self.known), []
        for name, template, own in self.templates if n else ():
            if sum(min(k, n[w]) for w, k in own.items()) >= self.least(template):
                fits += [(at, len(at) / len(template), name) for at in self.places(seen, template, own)]
        fits.sort(key=lambda x: (-len(x[0]), -x[1]))
        taken: dict[int, set] = {}
        out = []
        for k, (at, share, name) in enumerate(fits):
            over = Counter(y for i in at for y in taken.get(i, ()))
            if max(over.values(), default=0) < self.coverage * len(at):
                out.append((name, share, at[0], at[-1]))
                for i in at:
                    taken.setdefault(i, set()).add(k)
        return len(seen), sorted(out, key=lambda x: x[2:])


def licenses(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, n_words, license, coverage, first_word, last_word of every licence found in each row; one
    row with license null where none fits."""
    shared = spark.sparkContext.broadcast(Scanner(templates or TEMPLATES, coverage))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch in slices(batches):
            at, rows = [], []
            for k, t in enumerate(batch.column("text").to_pylist()):
                n, found = shared.value.found(t)
                for x in found or [(None, 0.0, None, None)]:
                    at.append(k)
                    rows.append((n, *x))
            n, name, share, first, last = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["doc_id", "n_words", "license", "coverage", "first_word", "last_word"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_words long, license string, coverage double, first_word long, last_word long")
