"""License scans: MinHash bands over overlapping text windows, then exact containment.

Words are runs of letters and digits in lower case; a text is its sequence of 5-word
shingles.  For a template of S shingles the text is cut into windows of S + step - 1
shingles, one every ``step`` = max(1, S // 2) shingles, so each place where the template
stands lies whole in a window.  A window that holds 3/4 of the template has a Jaccard
similarity of 3/7 or more with it, so of ``BANDS`` bands of one MinHash value each at
least one agrees with probability 1 - (4/7)^BANDS > 0.9998; for a verbatim template
(similarity 2/3) it is over 1 - 1e-7.  Retrieved windows, widened by S shingles on both
sides, are verified: the share of the template's distinct shingles in them must be
``CONTAINMENT`` or more.

Templates are a small table, broadcast after a check of its size.  Texts or templates of
fewer than five words match nothing, null text likewise.  Repeated rows give repeated
results; doc_id may be null.  Very long texts are scanned whole.  Columns other than doc_id and text are not read.  Empty
table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import PrefixHash, batches_by_bytes, mix, string_buffer

N, BANDS, CONTAINMENT = 5, 16, 0.75
MOST_BYTES = 8 << 20

#: Fixed template texts: public license notices, and the texts of short licenses (long ones in
#: parts, so that a document that carries one part is found).
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Apache-2.0 header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "CC0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
}


def shingle_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every shingle in the order of the texts."""
    raw, offsets = string_buffer(pc.utf8_lower(texts.fill_null("").cast(pa.large_string())))
    word = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    # each run of other characters counts as one space
    keep = word | before
    place = np.concatenate([[0], np.cumsum(keep)])
    text = raw[keep]
    text[~word[keep]] = 32
    s, e = place[starts], place[ends]
    of = np.searchsorted(offsets, starts, "right") - 1
    full = np.arange(max(len(starts) - N + 1, 0))
    full = full[of[full] == of[full + N - 1]]
    return of[full], PrefixHash(text)(s[full], e[full + N - 1])


def seeds() -> np.ndarray:
    return mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Templates:
    """Templates with a common number of shingles: their sets and band values."""

    def __init__(self, size: int, names: list[str], sets: list[np.ndarray]):
        self.size, self.names, self.sets = size, names, sets
        self.step = max(1, size // 2)
        self.values = [[int(mix(s ^ seed).min()) for s in sets] for seed in seeds()]

    def windows(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[from, to) of the windows of each row's shingles; the last one may be shorter."""
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        n = np.diff(np.append(first, len(row)))
        each = -(-n // self.step)
        k = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        begin = np.repeat(first, each) + k * self.step
        return begin, np.minimum(begin + self.size + self.step - 1, np.repeat(first + n, each))


def prepare(templates: dict[str, str]) -> list[Templates]:
    groups: dict[int, tuple[list, list]] = {}
    row, h = shingle_stream(pa.array(list(templates.values()), pa.large_string()))
    for i, name in enumerate(templates):
        own = np.unique(h[row == i])
        if len(own):
            names, sets = groups.setdefault(int((row == i).sum()), ([], []))
            names.append(name)
            sets.append(own)
    return [Templates(size, *g) for size, g in sorted(groups.items())]


def retrieve(row: np.ndarray, h: np.ndarray, groups: list[Templates]) -> Iterator[tuple[Templates, int, int, int]]:
    """(group, template, from, to) of windows that share a band with a template."""
    if not len(row):
        return
    hashed = [mix(h ^ seed) for seed in seeds()]
    for g in groups:
        begin, end = g.windows(row)
        pairs = np.empty(2 * len(begin), np.int64)
        pairs[0::2], pairs[1::2] = begin, end
        hits = set()
        for k, x in enumerate(hashed):
            # a window's end may be the array's: one value more, that is never read alone
            least = np.minimum.reduceat(np.append(x, np.uint64(0)), pairs)[0::2]
            for t, value in enumerate(g.values[k]):
                hits |= {(t, int(w)) for w in np.flatnonzero(least == np.uint64(value))}
        for t, w in sorted(hits):
            yield g, t, int(begin[w]), int(end[w])


def scanner(shared):
    """mapInArrow: (doc_id, text) to (doc_id, license, containment, regions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = prepare(shared.value)
        for batch in batches_by_bytes(batches, "text"):
            row, h = shingle_stream(batch.column(1))
            found: dict[tuple[int, str], list] = {}
            bounds = np.searchsorted(row, np.arange(batch.num_rows + 1))
            for g, t, lo, hi in retrieve(row, h, groups):
                r = int(row[lo])
                a, b = max(lo - g.size, int(bounds[r])), min(hi + g.size, int(bounds[r + 1]))
                share = float(np.isin(g.sets[t], h[a:b]).mean())
                if share >= CONTAINMENT:
                    best = found.setdefault((r, g.names[t]), [0.0, 0, -1])
                    # windows that overlap the one before are the same region
                    best[1] += lo > best[2]
                    best[0], best[2] = max(best[0], share), max(best[2], hi + g.size)
            if found:
                keys = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r for r, _ in keys])), pa.array([n for _, n in keys]), pa.array([found[k][0] for k in keys]), pa.array([found[k][1] for k in keys], pa.int64())],
                    ["doc_id", "license", "containment", "regions"],
                )

    return run


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each document and template found in it."""
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.encode()) for t in templates.values()) > MOST_BYTES:
        raise ValueError("templates are too many to broadcast; scan them in parts")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(templates)
    return rows.mapInArrow(scanner(shared), "doc_id long, license string, containment double, regions long")
