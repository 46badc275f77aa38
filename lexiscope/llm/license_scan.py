"""License scans by patience alignment.

A template is a license text or notice, as words. Where a document may hold one
is found by the template's runs of three words: each tells where the template
would begin, and beginnings near each other make a region as long as the template
with some slack to either side. Region and
template are then aligned: words that occur once in both are anchors, the
longest increasing run of anchors is kept, and the gaps between them are aligned
in the same way; where no word is unique, equal words at either end of a gap are
paired. The coverage is the part of the template's words that were paired; the
words that tell licenses and versions apart (``TELLING``) must be among them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiscope.llm.arrow_rows import map_texts, table, utf8
from lexiscope.llm.decontaminate import find_words, hash_words

COVERAGE = 0.8
RUN = 3
SLACK = 0.25

_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
    INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
    DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
    IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
    PERFORMANCE OF THIS SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
    the following conditions are met: Redistributions of source code must retain the above copyright notice, this
    list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
    copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
    materials provided with the distribution. """
_BSD_THIRD = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission. """
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
    WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
    ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
    SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
    LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
    CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
    SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str, title: str) -> list[str]:
    """Short notice, notice of a source file, and how the license text begins."""
    thing = "library" if version == "2.1" else "program"
    return [
        f"This work is licensed under the {name}, version {version}.",
        f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the
        {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any
        later version. This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.""",
        f"""{name} Version {title} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim
        copies of this license document, but changing it is not allowed.""",
    ]


def _creative_commons(code: str, version: str) -> list[str]:
    words = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives" if version == "4.0" else "NoDerivs"}
    name = "-".join(words[c] for c in code.split("-"))
    port = "International" if version == "4.0" else "Unported"
    return [f"Licensed under CC {code} {version}.",
            f"This work is licensed under a Creative Commons {name} {version} {port} License."]


#: Words that tell versions and variants apart: those of a template must all be found.
TELLING = frozenset("""1 2 3 4 mit apache isc bsd unlicense mozilla mpl gnu lesser affero cc0 by nc sa nd attribution noncommercial
    sharealike noderivatives noderivs endorse substantial appear unencumbered neighboring misrepresented""".split())

# The wording of common licenses and of the notices that name them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations
        under the License.""",
        """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION,
        AND DISTRIBUTION""",
    ],
    "MIT": [
        "Released under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""",
        _gnu("GNU General Public License", "3", "3, 29 June 2007 Copyright (C) 2007")[2],
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY,
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        "Released under the ISC License.",
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. " + _ISC_WARRANTY,
    ],
    "BSD-2-Clause": [_BSD_CONDITIONS, _BSD_CONDITIONS + _BSD_DISCLAIMER, "Released under the BSD 2-Clause License."],
    "BSD-3-Clause": [_BSD_CONDITIONS + _BSD_THIRD, _BSD_CONDITIONS + _BSD_THIRD + _BSD_DISCLAIMER,
                     "Released under the BSD 3-Clause License."],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author
        or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
        this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend
        this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
        under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
        EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
        SOFTWARE.""",
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would
        be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. This notice may not be removed or altered from any source
        distribution.""",
    ],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
    ],
    "CC0-1.0": [
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is licensed under a Creative Commons CC0 1.0 Universal License.",
    ],
    "GPL-2.0": _gnu("GNU General Public License", "2", "2, June 1991 Copyright (C) 1989, 1991"),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1", "2.1, February 1999 Copyright (C) 1991, 1999"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3", "3, 29 June 2007 Copyright (C) 2007"),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3", "3, 19 November 2007 Copyright (C) 2007"),
    **{f"CC-{code}-{v}": _creative_commons(code, v) for v in ("3.0", "4.0")
       for code in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND") if (code, v) != ("BY-NC", "4.0")},
    "all-rights-reserved": ["All rights reserved."],
}


def longest_increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[k], ends[k] = v, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of equal words (place in text, place in template), both rising."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        mine, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {template[k]: k for k in range(c, d) if theirs[template[k]] == 1}
        anchors = [(k, place[text[k]]) for k in range(a, b) if mine[text[k]] == 1 and text[k] in place]
        kept = [anchors[k] for k in longest_increasing([t for _, t in anchors])]
        if not kept:
            continue
        edges = [(a - 1, c - 1), *kept, (b, d)]
        pairs += kept
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(pairs)


class Templates:
    """The templates as word hashes, and their runs of ``RUN`` words."""

    def __init__(self, templates: dict[str, list[str]]):
        self.names: list[str] = []
        self.words: list[list[int]] = []
        self.telling: list[set[int]] = []
        raw = np.frombuffer(" ".join(sorted(TELLING)).encode(), dtype=np.uint8)
        telling = set(hash_words(*find_words(np.array([0, len(raw)]), raw)[:3]).tolist())
        runs: dict[int, list[tuple[int, int]]] = {}
        for name, texts in templates.items():
            for text in texts:
                raw = np.frombuffer(text.encode(), dtype=np.uint8)
                folded, starts, ends, _ = find_words(np.array([0, len(raw)]), raw)
                words = hash_words(folded, starts, ends)
                if len(words) < RUN:
                    raise ValueError(f"a template needs {RUN} words: {text!r}")
                for place, h in enumerate(self._runs(words).tolist()):
                    runs.setdefault(h, []).append((len(self.words), place))
                self.names.append(name)
                self.words.append(words.tolist())
                self.telling.append(telling & set(words.tolist()))
        self.runs = runs
        self.hashes = np.array(sorted(runs), dtype=np.uint64)

    @staticmethod
    def _runs(words: np.ndarray) -> np.ndarray:
        n = max(len(words) - RUN + 1, 0)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(RUN if n else 0):
                out = out * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
        return out

    def scan(self, offsets: np.ndarray, data: np.ndarray, least: float):
        """For each text its findings: (license, coverage, start, end), bytes,
        by place; of findings that overlap the one with most paired words."""
        folded, starts, ends, first = find_words(offsets, data)
        words = hash_words(folded, starts, ends)
        runs = self._runs(words)
        at = np.minimum(np.searchsorted(self.hashes, runs), len(self.hashes) - 1)
        hits = np.flatnonzero(self.hashes[at] == runs)
        doc = np.searchsorted(first, hits, side="right") - 1
        hits, doc = hits[hits + RUN <= first[doc + 1]], doc[hits + RUN <= first[doc + 1]]
        found: list[list] = [[] for _ in range(len(offsets) - 1)]
        held = np.unique(doc)
        for d, s, e in zip(held.tolist(), np.searchsorted(doc, held).tolist(), np.searchsorted(doc, held, side="right").tolist(), strict=True):
            places: dict[int, list[int]] = {}
            for i in hits[s:e].tolist():
                for t, place in self.runs[int(runs[i])]:
                    places.setdefault(t, []).append(i - place)
            best = []
            for t, own in places.items():
                size = len(self.words[t])
                slack = int(SLACK * size) + RUN
                own.sort()
                k = 0
                while k < len(own):
                    m = k
                    while m + 1 < len(own) and own[m + 1] - own[k] <= slack:
                        m += 1
                    lo = max(int(first[d]), own[k] - slack)
                    hi = min(int(first[d + 1]), own[m] + size + slack)
                    pairs = align(words[lo:hi].tolist(), self.words[t])
                    if len(pairs) >= least * size and self.telling[t] <= {self.words[t][p] for _, p in pairs}:
                        best.append((len(pairs), self.names[t], len(pairs) / size, lo + pairs[0][0], lo + pairs[-1][0] + 1))
                    k = m + 1
            taken: list[tuple] = []  # by place, none overlapping
            for b in sorted(best, key=lambda b: (-b[0], -b[2], b[3], b[1])):
                k = bisect_left(taken, b[3], key=lambda x: x[3])
                if (k == 0 or taken[k - 1][4] <= b[3]) and (k == len(taken) or b[4] <= taken[k][3]):
                    taken.insert(k, b)
            found[d] = [(name, cover, int(starts[s] - offsets[d]), int(ends[e - 1] - offsets[d])) for _, name, cover, s, e in taken]
        return found


FINDING = T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
                        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = COVERAGE,
                  keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of it the columns ``keep``, all if None) with ``findings``:
    license, coverage, start and end byte, by place.

    Null, empty and clean texts have no findings; repeated rows have the same; a
    long text is scanned as a whole; an empty table gives an empty table; a column named ``findings`` is
    replaced. The templates are a parameter of a few texts and are shipped with
    the function."""
    index = Templates(TEMPLATES if templates is None else templates)

    def scan(arr: pa.Array) -> list:
        return [[[dict(zip(FINDING.names, f, strict=True)) for f in found] for found in index.scan(*utf8(arr), least)]]

    return map_texts(docs, "text", [T.StructField("findings", T.ArrayType(FINDING))], scan, keep=keep)


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licenses that each document states, with coverage and place."""
    return scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", F.size("findings").cast("long").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct("findings.license")), ",").alias("licenses"), "findings")
