"""License scans by patience alignment.

Words that are unique in both a text and a template are anchors; the longest increasing subsequence of anchors is kept
and the gaps between are aligned the same way. Where a gap has no anchor, equal words at its ends are matched, and what is
between by a longest common subsequence, whatever its size. Coverage is the share of the template's words that are matched in order.

A template is only aligned where it can reach the wanted coverage: where the text has enough of its words, counted with
their multiplicity, in a stretch that is long enough for a match with as many words put in as density allows. That bound
drops no match.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import NOT_WORD, WordHasher, groups

#: Notices and opening passages of public licences, as their publishers word them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT full text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "ISC full text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
        "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause full text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD-3-Clause full text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
        "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright "
        "notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works "
        "are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "LGPL-2.1-or-later notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0-or-later notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU Affero General Public License for more details."
    ),
    "GPL-2.0-or-later notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "GPL-3.0-or-later notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details."
    ),
    "CC-BY-4.0 line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}


@dataclass(frozen=True)
class Settings:
    """coverage: the least share of a template's words. density: the least share of matched words between the first and
    last matched word of the text."""

    coverage: float = 0.8
    density: float = 0.5

    def stretch(self, n: int) -> tuple[int, int]:
        """Words of a stretch of text that is aligned with a template of n words, and words from one stretch to the next:
        every span of n / density words lies whole in a stretch."""
        step = max(1, n // 2)
        return math.ceil(n / self.density) + step, step


def _unique(x: list[int], low: int, high: int) -> dict[int, int]:
    seen: dict[int, int] = {}
    for k in range(low, high):
        seen[x[k]] = -1 if x[k] in seen else k
    return {w: k for w, k in seen.items() if k >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs (sorted by the first) in which the second rises: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for k, (_, b) in enumerate(pairs):
        p = bisect.bisect_left(tops, b)
        below.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[p], piles[p] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = below[k]
    return out[::-1]


def _common(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """A longest common subsequence of a[a0:a1] and b[b0:b1].

    The length for the first i words of a rises by 0 or 1 with each word of b; a row of bits says where it does not rise,
    and a row follows from the one before by one addition of whole numbers. All rows are kept for the way back: that is a
    bit for each pair of words.
    """
    at: dict[int, int] = {}
    for j in range(b0, b1):
        at[b[j]] = at.get(b[j], 0) | 1 << (j - b0)
    full = (1 << (b1 - b0)) - 1
    rows = [full]
    for i in range(a0, a1):
        flat = rows[-1]
        hit = flat & at.get(a[i], 0)
        rows.append(((flat + hit) | (flat - hit)) & full)
    out, i, j = [], a1 - a0, b1 - b0
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((a0 + i, b0 + j))
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of matched words of a and b, both rising."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        mine, theirs = _unique(a, a0, a1), _unique(b, b0, b1)
        anchors = _increasing(sorted((k, theirs[w]) for w, k in mine.items() if w in theirs))
        if not anchors:
            out += _common(a, b, a0, a1, b0, b1)
            continue
        i, j = a0, b0
        for x, y in anchors:
            out.append((x, y))
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        todo.append((i, a1, j, b1))
    return sorted(out)


def alignments(words: list[int], template: list[int], s: Settings = Settings()) -> list[tuple[float, int, int, int]]:
    """(coverage, matched, first word, end word) of each stretch of words that reaches density; stretches overlap so that
    every copy as thin as density allows lies whole in one of them."""
    n, out = len(template), []
    length, step = s.stretch(n)
    for at in range(0, max(1, len(words) - math.floor(s.coverage * n) + step), step):
        pairs = patience(words[at : at + length], template)
        if not pairs:
            continue
        first, end = at + pairs[0][0], at + pairs[-1][0] + 1
        if len(pairs) >= s.density * (end - first):
            out.append((len(pairs) / n, len(pairs), first, end))
    return out


def align(words: list[int], template: list[int], s: Settings = Settings()) -> tuple[float, int, int, int]:
    """The one of alignments() with the largest coverage."""
    return max(alignments(words, template, s), key=lambda x: x[0], default=(0.0, 0, 0, 0))


def apart(found: list[tuple]) -> list[tuple]:
    """Of matches (matched, coverage, -template, first, end) that overlap the better one stays; in order of places."""
    kept: list[tuple] = []
    ends: list[int] = []
    firsts: list[int] = []
    for m in sorted(set(found), key=lambda m: (-m[0], -m[1], -m[2], m[3])):
        k = bisect.bisect_left(ends, m[3] + 1)
        if k == len(ends) or firsts[k] >= m[4]:
            ends.insert(k, m[4])
            firsts.insert(k, m[3])
            kept.insert(k, m)
    return kept


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (doc_id, license, coverage, n_matched, first_word, end_word, n_words, matches).

    matches are all (license, coverage, n_matched, first_word, end_word) that reach coverage and density, in order of
    their places; of those that overlap the one with most matched words is given. The other columns are of the best.

    license is the template with most matched words among those that reach coverage and density (ties: the larger
    coverage, then the first of the templates); null, with coverage 0 and no places, where none does. Words are runs of
    ASCII digits and letters and of anything outside ASCII, A-Z as a-z. The whole text is looked at, however long; only
    stretches that may match are aligned. Null and wordless texts have no license; repeated rows get the same answer; an
    empty table gives no rows. Other columns of docs are not looked at, and none of theirs is returned, so names that
    clash do no harm. Memory of an alignment is a bit for each pair of words of a stretch and its template.
    """
    s, fields = settings, ("license", "coverage", "n_matched", "first_word", "end_word")

    def look(batches):
        hasher = WordHasher(NOT_WORD)
        h, offsets = hasher.words(list(templates.values()))
        vocabulary = np.unique(h)
        own = np.searchsorted(vocabulary, h)
        known = [own[offsets[k] : offsets[k + 1]].tolist() for k in range(len(templates))]
        names, empty = list(templates), len(vocabulary)
        counts = np.stack([np.bincount(t, minlength=empty) for t in known]) if known else np.zeros((0, 0), np.int64)
        sizes = np.array([len(t) for t in known])

        def may(x: np.ndarray, t: int) -> list[tuple[int, int]]:
            """Stretches that hold enough of the template's words, joined where they meet."""
            n = int(sizes[t])
            length, step = s.stretch(n)
            mine = np.flatnonzero(counts[t][np.minimum(x, empty - 1)] * (x < empty) > 0)
            found: list[tuple[int, int]] = []
            for block in np.unique(np.concatenate([mine // step - k for k in range(-(-length // step) + 1)])) if len(mine) else ():
                at = int(block) * step
                if at < 0:
                    continue
                inside = mine[np.searchsorted(mine, at) : np.searchsorted(mine, at + length)]
                if len(inside) < s.coverage * n or np.minimum(np.bincount(x[inside], minlength=empty), counts[t]).sum() < s.coverage * n:
                    continue
                if found and found[-1][1] >= at:
                    found[-1] = (found[-1][0], at + length)
                else:
                    found.append((at, at + length))
            return found

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, to in groups(texts):
                h, offsets = hasher.words(texts[at:to])
                place = np.minimum(np.searchsorted(vocabulary, h), empty - 1) if empty else np.zeros(len(h), np.int64)
                x = np.where(vocabulary[place] == h, place, empty) if empty else place
                rows = []
                for k in range(to - at):
                    own = x[offsets[k] : offsets[k + 1]]
                    inside = own[own < empty]
                    hits = []
                    if len(inside):
                        bound = np.minimum(np.bincount(inside, minlength=empty), counts).sum(axis=1)
                        for t in np.flatnonzero((bound >= s.coverage * sizes) & (sizes > 0)):
                            for low, high in may(own, t):
                                hits += [(n, cover, -int(t), low + first, low + end) for cover, n, first, end in alignments(own[low:high].tolist(), known[t], s) if cover >= s.coverage]
                    hits = [(names[-t], cover, n, first, end) for n, cover, t, first, end in apart(hits)]
                    best = max(hits, key=lambda m: (m[2], m[1], -names.index(m[0])), default=(None, 0.0, 0, None, None))
                    rows.append((*best, len(own), [dict(zip(fields, m)) for m in hits]))
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                kinds += (pa.list_(pa.struct(list(zip(fields, kinds)))),)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], ["doc_id", *fields, "n_words", "matches"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    one = "license string, coverage double, n_matched bigint, first_word bigint, end_word bigint"
    matches = ", ".join(f.replace(" ", ": ") for f in one.split(", "))
    return rows.mapInArrow(look, f"doc_id {kind}, {one}, n_words bigint, matches array<struct<{matches}>>")
