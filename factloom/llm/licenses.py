"""Licence scans by patience alignment.

A text and a licence template are aligned on the words that stand once in both: the longest increasing
subsequence of their places gives anchors, and the gaps between neighbouring anchors are aligned in the same way,
as are the ends.  Where a text repeats a template's words, few or none stand once in it, or the anchors lie far apart; then
the longest common subsequence of the template and any stretch of STRETCH times its length is found exactly, and taken
if it is longer.  Coverage is the share of the template's words that are aligned.

An alignment counts if it spans a stretch at most, holds every word that names the licence and its version, and spans none
of the words that name another: a shared phrase isn't a licence.

A template is tried only where it can reach the coverage asked for: an alignment can't hold a word more often than
both sides do, so the sum of these smaller counts bounds it from above, and nothing is lost by the check.  Each
text is scanned whole, on its own; there is no shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
COVERAGE = 0.8
#: Length of the stretches of a text that are aligned on their own, in lengths of the template, and two words more.
STRETCH = 1.25

@dataclass(frozen=True)
class Template:
    text: str
    must: tuple[str, ...] = ()  # words that have to be aligned
    without: tuple[str, ...] = ()  # words that may not stand in between


_NOT_GPL = ("lesser", "library", "affero")

# The wording of public licence texts, of the headers that they ask for, and of notices that refer to them.
TEMPLATES = {
    "AGPL-3.0 header": Template(
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        ("affero", "3"),
    ),
    "AGPL-3.0 notice": Template("This work is licensed under the GNU Affero General Public License, version 3.", ("affero", "general", "3")),
    "Apache-2.0 header": Template(
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache", "2.0"),
    ),
    "Apache-2.0 notice": Template("Licensed under the Apache License, Version 2.0.", ("apache", "license", "2.0")),
    "BSD-2-Clause": Template(
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        "\"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS "
        "OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        without=("neither", "endorse"),
    ),
    "BSD-3-Clause": Template(
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, "
        "BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
        "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        ("neither", "endorse"),
    ),
    "BSD notice": Template("Released under the BSD License.", ("bsd", "license")),
    "CC-BY-4.0 notice": Template("Licensed under CC BY 4.0.", ("cc", "by", "4.0"), ("nc", "sa", "nd")),
    "CC-BY-NC-4.0 notice": Template("Licensed under CC BY-NC 4.0.", ("cc", "by-nc", "4.0")),
    "CC-BY-SA-4.0 notice": Template("Licensed under CC BY-SA 4.0.", ("cc", "by-sa", "4.0")),
    "GPL-2.0 header": Template(
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("gnu", "general", "2"),
        _NOT_GPL,
    ),
    "GPL-2.0 notice": Template("This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "2"), _NOT_GPL),
    "GPL-3.0 header": Template(
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        ("gnu", "general", "3"),
        _NOT_GPL,
    ),
    "GPL-3.0 notice": Template("This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "3"), _NOT_GPL),
    "ISC": Template(
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS "
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
        "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1 header": Template(
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        ("lesser", "2.1"),
    ),
    "LGPL-2.1 notice": Template("This work is licensed under the GNU Lesser General Public License, version 2.1.", ("lesser", "general", "2.1")),
    "LGPL-3.0 notice": Template("This work is licensed under the GNU Lesser General Public License, version 3.", ("lesser", "general", "3")),
    "MIT": Template(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT notice": Template("Released under the MIT License.", ("mit", "license")),
    "MPL-2.0 header": Template(
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla", "2.0"),
    ),
    "MPL-2.0 notice": Template("Licensed under the Mozilla Public License, Version 2.0.", ("mozilla", "public", "2.0")),
    "Unlicense": Template(
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": Template(
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(values: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before.append(top_at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[k], top_at[k] = v, i
    out, at = [], top_at[-1] if top_at else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """(place in the text, place in the template) of the aligned words, both increasing."""
    matched = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a >= b or c >= d:
            continue
        wanted = set(template[c:d])
        once: dict[str, int] = {}
        for i in range(a, b):
            if text[i] in wanted:
                once[text[i]] = -1 if text[i] in once else i
        counts = Counter(template[c:d])
        pairs = [(once[template[j]], j) for j in range(c, d) if counts[template[j]] == 1 and once.get(template[j], -1) >= 0]
        chain = [pairs[k] for k in increasing([i for i, _ in pairs])]
        if not chain:
            continue
        matched += chain
        edges = [(a - 1, c - 1), *chain, (b, d)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(matched)


def common(words: Sequence[str], at: Mapping[str, int], full: int) -> list[int]:
    """Bits after each word: a longest common subsequence of the words so far and the template's first j words has as many words as zeros are in the low j bits.

    at: the template's places of each word as bits; full: all its bits.
    """
    out, bits = [], full
    for w in words:
        both = bits & at[w]
        bits = ((bits + both) | (bits - both)) & full
        out.append(bits)
    return out


def bits_of(template: Sequence[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for j, w in enumerate(template):
        out[w] = out.get(w, 0) | 1 << j
    return out


def reach_of(template: Sequence[str]) -> int:
    """Words of a stretch."""
    return int(STRETCH * len(template)) + 2


def densest(words: Sequence[str], template: Sequence[str], least: int, counts_as: Callable[[list[tuple[int, int]]], bool] = lambda pairs: True) -> list[tuple[int, int]]:
    """The longest alignment of at least `least` words (1 or more) with a stretch of the text that counts, in as few words as end it first; empty if there is none.

    Stretches begin at any word of the template.  The sum over words of the smaller count bounds a stretch's alignment.
    """
    counts, at, full = Counter(template), bits_of(template), (1 << len(template)) - 1
    places = [i for i, w in enumerate(words) if w in counts]
    seen = [words[i] for i in places]
    reach = reach_of(template)
    have: Counter[str] = Counter()
    bound = b = 0
    tries = []
    for a, i in enumerate(places):
        while b < len(places) and places[b] < i + reach:
            have[seen[b]] += 1
            bound += have[seen[b]] <= counts[seen[b]]
            b += 1
        if bound >= least:
            tries.append((-bound, a, b))
        bound -= have[seen[a]] <= counts[seen[a]]
        have[seen[a]] -= 1
    best: list[tuple[int, int]] = []
    for bound, a, b in sorted(tries):
        if -bound <= max(len(best), least - 1):
            break
        n = len(template) - common(seen[a:b], at, full)[-1].bit_count()
        if n > max(len(best), least - 1) and counts_as(pairs := _aligned(places, seen, a, b, template, n)):
            best = pairs
    return best


def _aligned(places: Sequence[int], seen: Sequence[str], a: int, b: int, template: Sequence[str], best: int) -> list[tuple[int, int]]:
    """A longest alignment, of `best` words, of the stretch seen[a:b], in as few words as end it first."""
    at, full = bits_of(template), (1 << len(template)) - 1
    size = lambda bits: len(template) - bits.bit_count()
    b = a + 1 + next(k for k, bits in enumerate(common(seen[a:b], at, full)) if size(bits) == best)
    a = b - 1 - next(k for k, bits in enumerate(common(seen[a:b][::-1], bits_of(template[::-1]), full)) if size(bits) == best)
    steps = [full, *common(seen[a:b], at, full)]
    length = lambda k, j: j - (steps[k] & ((1 << j) - 1)).bit_count()
    pairs, k, j = [], b - a, len(template)
    while k and j:
        if seen[a + k - 1] == template[j - 1]:
            k, j = k - 1, j - 1
            pairs.append((places[a + k], j))
        elif length(k - 1, j) >= length(k, j - 1):
            k -= 1
        else:
            j -= 1
    return pairs[::-1]


class Scanner:
    def __init__(self, templates: Mapping[str, Template], coverage: float) -> None:
        self.coverage = coverage
        self.templates = [(name, words_of(t.text), t) for name, t in sorted(templates.items())]
        self.counts = [Counter(w) for _, w, _ in self.templates]
        self.words = set().union(*self.counts) if self.counts else set()

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, float, int, int, int]]]:
        """(words, [(template, coverage, aligned words, first and last place in the text)]), all templates that are covered enough."""
        words = words_of(text or "")
        have = Counter(filter(self.words.__contains__, words))
        found = []
        for (name, template, rules), counts in zip(self.templates, self.counts, strict=True):
            if not template or not all(map(have.__contains__, rules.must)) or sum(min(n, have[w]) for w, n in counts.items()) < self.coverage * len(template):
                continue
            pairs = self.best(words, template, rules)
            if len(pairs) >= self.coverage * len(template):
                found.append((name, len(pairs) / len(template), len(pairs), pairs[0][0], pairs[-1][0]))
        return len(words), found

    def best(self, words: list[str], template: list[str], rules: Template) -> list[tuple[int, int]]:
        """The alignment with the whole text, or with a stretch of it if that covers enough, and more."""
        must, without, reach = set(rules.must), set(rules.without), reach_of(template)

        def counts_as(pairs: list[tuple[int, int]]) -> bool:
            first, last = pairs[0][0], pairs[-1][0]
            return last - first < reach and must <= {words[i] for i, _ in pairs} and without.isdisjoint(words[first : last + 1])

        pairs = align(words, template)
        if pairs and not counts_as(pairs):
            pairs = []
        if len(pairs) == len(template):
            return pairs
        return densest(words, template, max(1, len(pairs) + 1, math.ceil(self.coverage * len(template))), counts_as) or pairs


def scan_licenses(docs: DataFrame, templates: Mapping[str, Template] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, license, coverage, n_aligned, first_word, last_word, found; one row for each row of docs.

    found lists all templates whose share of aligned words is at least coverage, by name; license is the one with the
    most aligned words, the first by name among equals, null if there is none.  Words are runs of a-z and 0-9, with
    single dots, apostrophes and hyphens inside, in lower case.  Null and empty texts have no words.  Rows that share a
    doc_id are scanned each; other columns are ignored.  No rows give no rows.
    """
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    n, found = scanner.scan(text)
                    top = max(found, key=lambda x: x[2], default=(None, None, None, None, None))
                    rows.append((n, *top, [x[0] for x in found]))
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))],
                    ["doc_id", "n_words", "license", "coverage", "n_aligned", "first_word", "last_word", "found"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, license string, coverage double, n_aligned bigint, first_word bigint, last_word bigint, found array<string>"
    ).withColumn("coverage", F.round("coverage", 6))
