"""License scans by patience alignment.

A text's words and a license's are aligned on words that are unique in both: the longest increasing
subsequence of their places gives the anchors, the gaps between anchors are aligned in the same way,
and a gap without anchors by its longest common subsequence. A license is found where its aligned words
cover enough of it. A place of a license spans at most `spread` times its words, which is what makes it
one: further apart, common words stand in any order somewhere. Only spans that hold as many of a license's
words as the coverage takes, each as often as the license does at most, are aligned; no other span could
reach it. The names and numbers in a license tell it from others: each of its NAMES must be aligned, and no
word may be put in beside one, as in "the new MIT License"; any other word may be changed, left out or
added as far as the coverage allows. Where places of several licenses overlap, the one with most aligned
words stays: a notice of version 3 isn't one of version 2 as well.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import common_subsequence
from .vectors import LETTERS, groups_of, hashed_words

COVERAGE, SPREAD = 0.8, 1.5
#: Words that name a license or say which of its kind it is; numbers do so too.
NAMES = set("""mit apache bsd isc zlib gnu general lesser affero mozilla mpl creative commons attribution noncommercial sharealike
noderivatives cc by nc sa nd""".split())

# Notices and license texts, as published.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-notice": "Released under the BSD License.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nc-4.0-sentence": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0-sentence": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""",
    "isc-whole": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "lgpl-header": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "agpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
        FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "bsd-conditions": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its
        contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE
        IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
}


def template_words(text: str) -> list[int]:
    return hashed_words([text.lower().encode()], LETTERS)[0].tolist()


def names_in(text: str) -> frozenset[int]:
    """The names and numbers of a template, as template_words has its words."""
    words = re.findall(r"[^\W_]+", text.lower())
    return frozenset(w for x in words if x in NAMES or x.isdigit() for w in template_words(x))


def well_named(pairs: list[tuple[int, int]], template: list[int], names: frozenset[int]) -> bool:
    """Whether all names are aligned and no word is put in beside one."""
    if names - {template[i] for i, _ in pairs}:
        return False
    return not any(q[0] == p[0] + 1 and q[1] > p[1] + 1 and (template[p[0]] in names or template[q[0]] in names) for p, q in zip(pairs, pairs[1:]))


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below: list[int] = []
    for i, p in enumerate(places):
        k = bisect.bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            piles.append(i)
        else:
            tops[k], piles[k] = p, i
        below.append(piles[k - 1] if k else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), ascending in both."""
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
        anchors = [unique[k] for k in increasing([j for _, j in unique])]
        if not anchors:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:])]
    return sorted(out)


def span_of(size: int, spread: float = SPREAD) -> int:
    """Words that a place of a template spans at most."""
    return int(size * spread) + 2


def most_aligned(own: np.ndarray, kind: np.ndarray, begin: np.ndarray, counts: np.ndarray, span: int) -> np.ndarray:
    """For each place in own, how many words of the template can be aligned within the span from there.

    own: ascending places of the template's words; kind: which word each is; begin: where its text begins;
    counts: how often the template holds each word. A word counts as often as both hold it, so a place
    counts for the starts after its word's counts-th place before it.
    """
    order = np.argsort(kind, kind="stable")
    k, p = kind[order], own[order]
    before = np.arange(len(p)) - counts[k]
    earlier = np.maximum(before, 0)
    same = (before >= 0) & (k[earlier] == k)
    first = np.maximum(np.where(same, p[earlier], -1), np.maximum(p - span, begin[order] - 1)) + 1
    change = np.bincount(np.searchsorted(own, first), minlength=len(own) + 1)
    change[1:] -= 1  # each place counts up to the start that it is itself
    return np.cumsum(change[:-1])


def places_of(
    starts: list[int], most: list[int], words: np.ndarray, template: list[int], least: float, spread: float = SPREAD, names: frozenset[int] = frozenset(),
) -> list[tuple[float, int, int]]:
    """(coverage, first word, last word) of each place of a template.

    starts: ascending places where enough of the template's words follow within its span; most: how many
    of them can be aligned.
    """
    m, span = len(template), span_of(len(template), spread)
    out: list[tuple[float, int, int]] = []
    whole = np.array(template, np.uint64)
    k = 0
    while k < len(starts):
        best, group = None, starts[k]
        # a stray word may come before the place: of the starts within one span, the best alignment counts
        while k < len(starts) and starts[k] < group + span and not (best and best[0] == m):
            first = starts[k]
            part = words[first:min(len(words), first + span)]
            # no alignment is longer than the longest common subsequence, which is soon known
            if (best is None or most[k] > best[0]) and common_subsequence(whole, part) >= max(least * m, best[0] + 1 if best else 0):
                pairs = patience(template, part.tolist())
                if len(pairs) >= least * m and (best is None or len(pairs) > best[0]) and well_named(pairs, template, names):
                    best = (len(pairs), first + pairs[0][1], first + pairs[-1][1])
            k += 1
        if best:
            out.append((best[0] / m, best[1], best[2]))
            while k < len(starts) and starts[k] <= best[2]:
                k += 1
    return out


def apart(found: list[tuple[int, str, float, int, int]]) -> list[tuple[int, str, float, int, int]]:
    """(aligned words, license, coverage, first, last) without those that overlap a better one: more aligned
    words, then a shorter place, then a higher coverage, then the name."""
    out: list[tuple[int, str, float, int, int]] = []
    taken: list[tuple[int, int]] = []
    for f in sorted(found, key=lambda f: (-f[0], f[4] - f[3], -f[2], f[1], f[3])):
        at = bisect.bisect_left(taken, (f[3], f[4]))
        if (at == 0 or taken[at - 1][1] < f[3]) and (at == len(taken) or f[4] < taken[at][0]):
            taken.insert(at, (f[3], f[4]))
            out.append(f)
    return out


def _scan(templates: dict[str, list[int]], names: dict[str, frozenset[int]], least: float, spread: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(np.array([w for t in templates.values() for w in t] or [0], np.uint64))
        counts = {name: np.bincount(np.searchsorted(known, np.array(t, np.uint64)), minlength=len(known)) for name, t in templates.items() if t}
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for base, texts in groups_of(batch.column(1).to_pylist(), 1 << 20):
                words, offsets = hashed_words(texts, LETTERS)
                if not len(words):
                    continue
                at = np.minimum(np.searchsorted(known, words), len(known) - 1)
                hits = np.flatnonzero(known[at] == words)
                of = at[hits]
                text_of = np.searchsorted(offsets, hits, "right") - 1
                places: dict[int, list] = {}
                for name, count in counts.items():
                    size = len(templates[name])
                    chosen = count[of] > 0
                    own, text = hits[chosen], text_of[chosen]
                    most = most_aligned(own, of[chosen], offsets[text], count, span_of(size, spread))
                    enough = np.flatnonzero(most >= least * size)
                    own, text, most = own[enough], text[enough], most[enough]
                    for t in np.unique(text).tolist():
                        a, b = np.searchsorted(text, [t, t + 1])
                        found = places_of((own[a:b] - offsets[t]).tolist(), most[a:b].tolist(), words[offsets[t]:offsets[t + 1]], templates[name], least, spread, names[name])
                        places.setdefault(t, []).extend((round(c * size), name, c, first, last) for c, first, last in found)
                for t in sorted(places):
                    kept: dict[str, list] = {}
                    for _, name, c, first, last in apart(places[t]):
                        kept.setdefault(name, []).append((-c, first, last))
                    for name, found in sorted(kept.items()):
                        c, first, last = min(found)
                        out.append((ids[base + t], name, -c, len(found), first, last))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], k) for n, k in enumerate(kinds)], ["doc_id", "license_id", "coverage", "n_places", "first_word", "last_word"])

    return run


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", spread: float = SPREAD,
) -> DataFrame:
    """(doc_id, license_id, coverage, n_places, first_word, last_word): a row for each row of docs and license in it.

    coverage, first_word and last_word are of the place that covers most, the first of equal ones; words
    are runs of letters and digits, counted from 0. templates: texts by name, TEMPLATES if none are given.
    Defined results: null and empty texts and templates without words are found nowhere; texts of any length
    are scanned whole; of licenses that overlap in as many words the shorter place stays, then what it covers more of, then the first
    name; repeated rows are found each; an empty table gives an empty one;
    other columns are ignored.
    """
    texts = TEMPLATES if templates is None else templates
    known, names = ({name: f(text) for name, text in texts.items()} for f in (template_words, names_in))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(known, names, least, spread), "doc_id long, license_id string, coverage double, n_places long, first_word long, last_word long")


def without_licenses(docs: DataFrame, licenses: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs under none of the named licenses, with all their columns. Each row is judged by its own text: ids,
    null or repeated, don't matter."""
    templates = {k: TEMPLATES[k] for k in licenses}
    known, names = ({name: f(text) for name, text in templates.items()} for f in (template_words, names_in))
    at, scan = docs.columns.index(text_col), _scan(known, names, COVERAGE, SPREAD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], ["id", "text"])
            licensed = {i for found in scan(iter([numbered])) for i in found.column("doc_id").to_pylist()}
            yield batch.filter(pa.array([i not in licensed for i in range(batch.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
