"""Find license texts and notices in documents by patience alignment.

A template and a stretch of text are aligned on the words that are unique to each and common to both. The longest
increasing subsequence of those anchors splits both into gaps, which are aligned the same way in turn, after common
words at their ends are matched. The share of a template's words that are aligned is its coverage.

A text is held against a template in stretches of two, four and eight template lengths, each half of itself apart, so
an occurrence that foreign words widen up to SPREAD times lies whole in one of them wherever it begins. A stretch is left
out if its words can't reach the coverage even if all were in order; that bound is a sum over word counts, so it discards
nothing that could pass. Notices of under SHORT words are found word by word, without foreign words between.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Numbers, as_bytes, plain_words, ready, words

#: The least coverage of a text; a notice of under SHORT words has to be there in full.
COVERAGE, SHORT = 0.8, 12
#: Template lengths that an occurrence may span with foreign words between.
SPREAD = 4

# License texts, headers and notices. Long texts stand whole in the folder license_texts.
LONG = ("Apache-2.0", "BSL-1.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    **{name: files(__package__).joinpath("license_texts", f"{name}.txt").read_text("utf-8") for name in LONG},
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "GPL-2.0 header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-2.1 header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "AGPL-3.0 header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
}
#: Licenses as notices name them.
NAMED = {
    "MIT": ("the MIT License", "the MIT license (MIT)", "MIT"), "ISC": ("the ISC License",), "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"), "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"), "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"), "Unlicense": ("the Unlicense",),
    "Zlib": ("the zlib License",), "BSL-1.0": ("the Boost Software License, Version 1.0",), "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    **{f"{x}GPL-{v}": (f"the GNU {name}General Public License, version {v.removesuffix('.0')}", f"the GNU {name}General Public License v{v}", f"the GNU {x}GPL v{v.removesuffix('.0')}", f"{x}GPL-{v}", f"the {x}GPLv{v.removesuffix('.0')}") for x, name, v in (("", "", "2.0"), ("", "", "3.0"), ("L", "Lesser ", "2.1"), ("L", "Lesser ", "3.0"), ("A", "Affero ", "3.0"))},
    **{f"CC-{k}-{v}": (f"CC {k} {v}", f"CC-{k}-{v}", f"a Creative Commons {name} {v} {where} License") for k, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v, where in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic"))},
}
for _id, _names in NAMED.items():
    TEMPLATES[f"{_id} notice (SPDX)"] = f"SPDX-License-Identifier: {_id}"
    for _name in _names:
        for _way in ("Licensed under", "Released under", "Distributed under", "Available under", "This work is licensed under"):
            if not any(_given.strip(".").lower() == f"{_way} {_name}".lower() for _given in TEMPLATES.values()):
                TEMPLATES[f"{_id} notice ({_way.lower()} {_name})"] = f"{_way} {_name}."


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (in a, in b) of aligned words, both rising; a and b hold word numbers, and 0 aligns with nothing."""
    a, b = a.tolist(), b.tolist()
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        p, q, r, s = todo.pop()
        while p < q and r < s and a[p] == b[r] != 0:
            out.append((p, r))
            p, r = p + 1, r + 1
        while p < q and r < s and a[q - 1] == b[s - 1] != 0:
            q, s = q - 1, s - 1
            out.append((q, s))
        if p >= q or r >= s:
            continue
        in_a: dict[int, int] = {}
        for i in range(p, q):
            in_a[a[i]] = -1 if a[i] in in_a else i
        in_b: dict[int, int] = {}
        for j in range(r, s):
            if b[j] in in_a:
                in_b[b[j]] = -1 if b[j] in in_b else j
        anchors = sorted((j, in_a[w]) for w, j in in_b.items() if w and j >= 0 and in_a[w] >= 0)
        if not anchors:
            continue
        # The longest rising subsequence by piles, each top with what stood before it.
        tops, ends, before = [], [], {}
        for n, (_, i) in enumerate(anchors):
            at = bisect_left(tops, i)
            tops[at : at + 1], ends[at : at + 1] = [i], [n]
            before[n] = ends[at - 1] if at else None
        chain, n = [], ends[-1]
        while n is not None:
            chain.append(anchors[n])
            n = before[n]
        last_a, last_b = p, r
        for j, i in reversed(chain):
            out.append((i, j))
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        todo.append((last_a, q, last_b, s))
    return sorted(out)


class Templates:
    """Templates as word numbers, with the number of each word in each."""

    def __init__(self, texts: dict[str, str]):
        self.vocabulary: dict[bytes, int] = {}
        self.names, self.numbers = [], []
        for name, text in texts.items():
            if found := plain_words(text):
                self.names.append(name)
                self.numbers.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.int32))
        self.counts = np.stack([np.bincount(x, minlength=len(self.vocabulary) + 1) for x in self.numbers], 1) if self.names else np.zeros((1, 0), int)
        self.sizes = np.array([len(x) for x in self.numbers])


def _stretches(size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all stretches in which a template of a size is sought."""
    starts, ends, step = [], [], size
    while step <= SPREAD * size:
        at = np.arange(0, max(1, length - step), step)
        starts.append(at)
        ends.append(np.minimum(at + 2 * step, length))
        if 2 * step >= length:
            break
        step *= 2
    return np.concatenate(starts), np.concatenate(ends)


def _runs(numbers: np.ndarray, own: np.ndarray) -> list[int]:
    """Where a short template stands word by word."""
    found = np.flatnonzero(own[: max(0, len(own) - len(numbers) + 1)] == numbers[0])
    for i, w in enumerate(numbers[1:], 1):
        found = found[own[found + i] == w]
    return found.tolist()


def scan(own: np.ndarray, t: Templates, least: float = COVERAGE) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, first word, word after the last, words aligned) of the best stretch for each template found.

    A word of the text speaks for one template: stretches are taken by the words that they align, most first, then by
    coverage, and one with half of its words taken before it tells of no license of its own. Foreign words between count
    against a stretch, so that a stray word far off doesn't widen it.
    """
    present = np.unique(own)
    needed = np.ceil(np.where(t.sizes < SHORT, 1.0, least) * t.sizes - 1e-9).astype(int)
    passed = []
    for i in np.flatnonzero(t.counts[present[present > 0]].sum(0) >= needed):
        size, numbers, most = int(t.sizes[i]), t.numbers[i], t.counts[:, i]
        if size < SHORT:
            for start in _runs(numbers, own):
                passed.append((-size, -1.0, int(i), start, np.arange(start, start + size)))
            continue
        inside = np.concatenate(([0], np.cumsum(most[own] > 0)))
        starts, ends = _stretches(size, len(own))
        for start, end in zip(starts[(maybe := inside[ends] - inside[starts] >= needed[i])].tolist(), ends[maybe].tolist(), strict=True):
            stretch = own[start:end]
            if np.minimum(np.bincount(stretch, minlength=len(most)), most)[1:].sum() < needed[i]:
                continue
            found = align(numbers, stretch)
            if len(found) >= needed[i]:
                places = np.array([j for _, j in found]) + start
                foreign = max(0, int(places[-1] - places[0]) + 1 - size)
                passed.append((foreign / (2 * SPREAD) - len(found), -len(found) / size, int(i), int(places[0]), places))
    taken, best = np.zeros(len(own), bool), {}
    for _, coverage, i, _, places in sorted(passed, key=lambda x: x[:4]):
        if 2 * np.count_nonzero(taken[places]) < len(places):
            taken[places] = True
            best.setdefault(i, (t.names[i], -coverage, int(places[0]), int(places[-1]) + 1, len(places)))
    return [best[i] for i in sorted(best)]


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """(key, license, coverage, first_word, end_word, aligned_words): the best stretch of each document and template.

    Words are compared in lower case (A-Z) without ASCII punctuation at their ends; places count those words. Between
    equal stretches the first is told. Null and empty texts hold none; texts may be of any length; repeated rows are
    each reported; extra columns play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ready(spark)
    sent = spark.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        numbers = Numbers(t.vocabulary)
        for b in batches:
            at, rows = [], []
            for i, raw in enumerate(as_bytes(b.column("text"))):
                own = numbers.of(words(raw))
                for row in scan(own[own >= 0], t, least):
                    at.append(i)
                    rows.append(row)
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["id", "license", "coverage", "first_word", "end_word", "aligned_words"])

    return docs.mapInArrow(work, f"id {dict(docs.dtypes)['id']}, license string, coverage double, first_word long, end_word long, aligned_words int").withColumnRenamed("id", key)
